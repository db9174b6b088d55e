"""BM25: corpus statistics, index tables and exact top-k search.

Search is exact and touches few postings of frequent terms:

* equal documents and equal questions are scored once and expanded afterwards;
* a few known good documents per question give a floor for its k-th score;
* terms that cannot lift a document over that floor, most frequent first, are
  not read at all, or only down to a minimum impact;
* what is left is added up, cut by its best possible score, and only the
  survivors are scored in full.

Scores are added up where a block of texts meets a chunk of questions, both of bounded
size, and a meeting returns k rows per question: pairs of questions and texts are never
shuffled. The postings of a large index lie in folders by term bucket and, for long lists, by
impact band. A search reads the buckets of its terms, and of long lists only the bands
that reach the impact some question asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lorequery.functions.text import tokens
from lorequery.operators.ranking import number_rows, top_k
from lorequery.session import joined, materialize, side_by_side, spread
from lorequery.sources.versions import commit, new_segment, read_version, segment_tables, united

# Parameters of the scoring formula, and the places scores are rounded to
# before they are ranked.
K1 = 1.5
B = 0.75
EPSILON = 0.25
SCORE_DIGITS = 6

# Missing keys are indexed as this token.
MISSING_KEY = "nan"

# Rounding can lift a score by half a unit of the last digit on both sides of a comparison.
_MARGIN = 2e-6
CHAMPIONS = 4
SEED_TERMS = 8
POSTINGS_PER_BUCKET = 64_000_000
MAX_BUCKETS = 4096
# Lists longer than this are kept in bands of equal width of their impact; short ones are read whole.
BANDED_POSTINGS = 1_000_000
MAX_BANDED_TERMS = 10_000
BANDS = 8
_BAND_WIDTH = (K1 + 1) / BANDS
POSTINGS_PER_SALT = 1_000_000
MAX_SALTED_TERMS = 10_000
# So many top positions are broadcast; more are joined by shuffle.
BROADCAST_POSITIONS = 200_000
# Up to this many posting hits scoring all texts is cheaper than pruning.
DIRECT_HITS = 50_000_000
# Postings of a block of texts, questions of a chunk, and rows that one meeting of the two may return.
BLOCK_POSTINGS = 2_000_000
CHUNK_QUESTIONS = 16_384
MEETING_ROWS = 4_000_000
_PACKED = "text_id long, n_copies long, dl long, words string, tfs array<int>"


def key_tokens(key: Column) -> Column:
    return tokens(F.coalesce(key, F.lit(MISSING_KEY)))


def token_positions(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per token with its place in the text."""
    words = key_tokens(F.col(text_col))
    # outer with a filter, see _exploded
    return corpus.select(id_col, F.posexplode_outer(words).alias("pos", "token")).filter("token is not null")


def term_frequencies(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How often each term occurs in each document."""
    rows = corpus.select(id_col, key_tokens(F.col(text_col)).alias("tokens"))
    return (
        _exploded(rows)
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_lengths(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Token count per document, 0 for documents without tokens."""
    return corpus.select(id_col, F.size(key_tokens(F.col(text_col))).cast("long").alias("dl"))


def document_stats(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Token count per document and the mean over all documents."""
    lengths = document_lengths(corpus, id_col, text_col)
    return lengths.withColumn("avgdl", lengths.agg(F.avg("dl")).scalar())


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def inverse_document_frequencies(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document frequency and idf per term; negative idf is lifted to a share of the mean."""
    counts = (
        term_frequencies(corpus, id_col, text_col)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    n_docs = corpus.agg(F.count(F.lit(1))).scalar()
    raw = counts.withColumn("idf", _idf(n_docs.cast("double"), F.col("df")))
    floor = raw.agg(F.avg("idf") * EPSILON).scalar()
    return raw.withColumn("idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))


def _exploded(rows: DataFrame) -> DataFrame:
    """Replace ``tokens`` by its length and one row per token; the array itself is not carried along.

    The outer form with a filter keeps Spark from testing for empty arrays
    in the scan, which would split every text twice.
    """
    sized = rows.withColumn("dl", F.size("tokens").cast("long"))
    kept = [c for c in sized.columns if c != "tokens"]
    return sized.select(*kept, F.explode_outer("tokens").alias("term")).filter("term is not null")


def posting_rows(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Term frequency and document length per (document, term)."""
    rows = corpus.select(id_col, key_tokens(F.col(text_col)).alias("tokens"))
    return _exploded(rows).groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def packed_texts(rows: DataFrame) -> DataFrame:
    """Replace ``tokens`` by the text's length, its distinct terms and how often it has each: row by row, no shuffle.

    The terms are one string, which takes less room than a list; no term has a blank.
    """
    kept = [c for c in rows.columns if c != "tokens"]
    ordered = rows.select(*kept, F.size("tokens").cast("long").alias("dl"), F.sort_array("tokens").alias("ordered"))
    # where a term begins; of two columns, so that neither is worked out again for each element
    begins = F.filter(
        F.transform("ordered", lambda w, i: F.when((i == 0) | (w != F.get(F.col("ordered"), i - 1)), i)), lambda i: i.isNotNull()
    )
    begun = ordered.withColumn("begins", begins)
    ends = lambda i: F.coalesce(F.get(F.col("begins"), i + 1), F.col("dl").cast("int"))
    return begun.select(
        *kept,
        "dl",
        F.array_join(F.transform("begins", lambda b: F.get(F.col("ordered"), b)), " ").alias("words"),
        F.transform("begins", lambda b, i: ends(i) - b).alias("tfs"),
    )


def unpacked(packed: DataFrame, *kept: str) -> DataFrame:
    """One row per text and term: ``kept, term, tf``."""
    listed = packed.filter("words <> ''").select(*kept, F.split("words", " ").alias("terms"), "tfs")
    pairs = listed.select(*kept, F.explode(F.arrays_zip("terms", "tfs")).alias("of"))
    return pairs.select(*kept, F.col("of.terms").alias("term"), F.col("of.tfs").cast("long").alias("tf"))


def _gain(tf, dl, avgdl: float):
    """The part of a term's score that does not depend on its weight; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class LexicalIndex:
    """Index tables. A text is a group of documents of a segment with equal tokens, named by its highest position."""

    docs: DataFrame  # doc_pos, digest, dl, segment
    positions: DataFrame  # doc_pos, from_top (0 for the highest position of the segment), segment
    texts: DataFrame  # text_id, digest, n_copies, dl, segment
    packed: DataFrame  # text_id, n_copies, dl, words, tfs: a row per text
    postings: DataFrame  # term_bucket, band (BANDS for a list that is kept whole), term, text_id, tf, dl, gain
    terms: DataFrame  # term_bucket, term, df, n_texts, idf, max_gain, champions
    n_docs: int
    n_texts: int
    n_buckets: int
    avgdl: float
    floor: float
    longest_list: int
    n_postings: int
    segment_docs: tuple[int, ...]
    version: int
    banded_over: int  # lists with more texts may be in bands
    growth: float  # the largest gain of a band is at most so many times its upper end

    @property
    def weights_may_be_negative(self) -> bool:
        return self.floor < 0


def _bucket(term: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def _write_segment(source: DataFrame, folder: str, n_buckets: int | None, before: dict | None) -> dict:
    """Write the tables of a segment: ``docs``, ``positions``, ``texts``, ``postings``, ``terms``; its entry.

    ``before`` has the document and token counts of the other segments. Scores depend on
    figures of the whole corpus, so they are not stored; a term keeps its largest gain at
    the mean length of this moment, from which a bound for any other mean length follows.
    """
    spark = source.sparkSession
    source.select(
        "doc_pos",
        F.sha2(F.array_join("tokens", " "), 256).alias("digest"),
        F.size("tokens").cast("long").alias("dl"),
    ).write.parquet(f"{folder}/docs")
    docs_t = spark.read.parquet(f"{folder}/docs")

    def positions() -> None:
        numbered = number_rows(docs_t.select("doc_pos"), [F.col("doc_pos").desc()], "positions", "from_top")
        numbered.write.parquet(f"{folder}/positions")

    def texts() -> dict:
        docs_t.groupBy("digest").agg(
            F.max("doc_pos").alias("text_id"), F.count(F.lit(1)).alias("n_copies"), F.max("dl").alias("dl")
        ).write.parquet(f"{folder}/texts")
        texts_t = spark.read.parquet(f"{folder}/texts")
        n_texts, n_docs, n_tokens = texts_t.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum("n_copies"), F.lit(0)),
            F.coalesce(F.sum(F.col("dl") * F.col("n_copies")), F.lit(0)),
        ).first()
        buckets = n_buckets or min(MAX_BUCKETS, max(1, -(-n_tokens // POSTINGS_PER_BUCKET)))
        all_docs = n_docs + (before["n_docs"] if before else 0)
        avgdl = (n_tokens + (before["n_tokens"] if before else 0)) / all_docs if all_docs else 0.0
        repeated = docs_t.groupBy("doc_pos").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_pos").alias("again"))
        packed = _packed_rows(source, texts_t, n_texts == n_docs)
        _merged_rows(packed, materialize(repeated, "repeated")).write.parquet(f"{folder}/packed")
        packed_t = spark.read.schema(_PACKED).parquet(f"{folder}/packed")
        figures = {"n_texts": n_texts, "n_docs": n_docs, "n_tokens": n_tokens, "avgdl": avgdl, "n_buckets": buckets}
        rows = unpacked(packed_t, "text_id", "n_copies", "dl").withColumn("term_bucket", _bucket(F.col("term"), buckets))
        _write_terms(rows, folder, avgdl)
        if before is None and buckets > 1:
            return figures | {"banded_over": _write_banded(packed_t, folder, avgdl, buckets)}
        rows.drop("n_copies").withColumn("band", F.lit(BANDS)).write.parquet(f"{folder}/postings")
        return figures

    _, figures = side_by_side(positions, texts)
    return figures


def _packed_rows(source: DataFrame, texts_t: DataFrame, single: bool) -> DataFrame:
    """``text_id, n_copies, dl, words, tfs`` of each text once."""
    packed = packed_texts(source).withColumnRenamed("doc_pos", "text_id")
    if single:
        packed = packed.withColumn("n_copies", F.lit(1).cast("long"))
    else:
        # texts are hashed by their number, so that the long side is not sorted
        packed = packed.join(texts_t.select("text_id", "n_copies").hint("shuffle_hash"), "text_id")
    return packed.select("text_id", "n_copies", "dl", "words", "tfs")


def _merged_rows(packed: DataFrame, repeated: DataFrame) -> DataFrame:
    """``packed`` with the counts of rows that share a position, copies and length added up; ``repeated`` has such positions."""
    if repeated.isEmpty():
        return packed
    packed = materialize(packed, "packed")
    same, keys = F.col("text_id").eqNullSafe(F.col("again")), ["text_id", "n_copies", "dl"]
    counted = unpacked(joined(packed, repeated, same, "left_semi"), *keys).groupBy(*keys, "term").agg(F.sum("tf").cast("int").alias("tf"))
    # a group has the distinct terms of a few texts
    merged = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("of"))
    merged = merged.select(*keys, F.array_join("of.term", " ").alias("words"), F.col("of.tf").alias("tfs"))
    return joined(packed, repeated, same, "left_anti").unionByName(merged)


def _lists(avgdl: float, long_terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts to pieces of posting lists: a row per term and band of a batch, so that terms are shuffled once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch["words"], ""))
            terms = pc.split_pattern(batch["words"], " ").flatten().dictionary_encode()
            if not len(terms):
                continue
            codes, tf = terms.indices.to_numpy(), batch["tfs"].flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["tfs"]).to_numpy())
            dl = batch["dl"].to_numpy()[row]
            is_long = pc.is_in(terms.dictionary, value_set=pa.array(long_terms, pa.string())).to_numpy(zero_copy_only=False)
            band = np.minimum(BANDS - 1, (_gain(tf, dl, avgdl) / _BAND_WIDTH).astype(np.int64))
            key = codes.astype(np.int64) * (BANDS + 1) + np.where(is_long[codes], band, BANDS)
            order = key.argsort(kind="stable")
            key, row = key[order], row[order]
            begins = np.flatnonzero(np.diff(key, prepend=-1))
            offsets = pa.array(np.append(begins, len(key)), pa.int32())
            listed = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            yield pa.record_batch({
                "term": terms.dictionary.take(pa.array(key[begins] // (BANDS + 1))),
                "band": pa.array(key[begins] % (BANDS + 1), pa.int32()),
                "text_id": listed(batch["text_id"].to_numpy()[row], pa.int64()),
                "tf": listed(tf[order], pa.int32()),
                "dl": listed(dl[order], pa.int32()),
            })

    return run


def _write_banded(packed_t: DataFrame, folder: str, avgdl: float, n_buckets: int) -> int:
    """Write postings in folders by bucket and band; the length beyond which lists are in bands."""
    spark = packed_t.sparkSession
    terms_t = spark.read.parquet(f"{folder}/terms")
    n_postings = terms_t.agg(F.sum("n_texts")).first()[0]
    over = max(BANDED_POSTINGS, n_postings // MAX_BANDED_TERMS)
    # fewer than MAX_BANDED_TERMS lists can be longer than that
    long_terms = [r["term"] for r in terms_t.filter(F.col("n_texts") > over).select("term").collect()]
    form = "term string, band int, text_id array<long>, tf array<int>, dl array<int>"
    lists = packed_t.mapInArrow(_lists(avgdl, long_terms), form).withColumn("term_bucket", _bucket(F.col("term"), n_buckets))
    # balances the files of a folder by size, so that a frequent term fills several
    placed = lists.hint("rebalance", "term_bucket", "band").sortWithinPartitions("term_bucket", "band", "term")
    rows = placed.select("term_bucket", "band", "term", F.explode(F.arrays_zip("text_id", "tf", "dl")).alias("of"))
    longs = [F.col(f"of.{c}").cast("long").alias(c) for c in ("text_id", "tf", "dl")]
    rows.select("term_bucket", "band", "term", *longs).write.partitionBy("term_bucket", "band").parquet(f"{folder}/postings")
    return over


def _write_terms(postings_t: DataFrame, folder: str, avgdl: float) -> None:
    """``term_bucket, term, df, n_texts, max_gain, champions``: what merges over segments."""
    # one strong text from each of a few slices of the corpus: plain aggregates, no sort
    slice_no = F.pmod(F.xxhash64("text_id"), F.lit(CHAMPIONS))
    postings_t.withColumn("gain", _gain(F.col("tf"), F.col("dl"), avgdl)).groupBy("term_bucket", "term").agg(
        F.sum("n_copies").alias("df"),
        F.count(F.lit(1)).alias("n_texts"),
        F.max("gain").alias("max_gain"),
        F.array_compact(
            F.array(*[F.max_by("text_id", F.when(slice_no == i, F.col("gain"))) for i in range(CHAMPIONS)])
        ).alias("champions"),
    ).write.parquet(f"{folder}/terms")


def _merged_terms(spark: SparkSession, path: str, segments: list[dict], n_docs: int, avgdl: float) -> DataFrame:
    """Terms of all segments with idf; gains grow at most like the mean length."""
    frames = []
    for segment, frame in zip(segments, segment_tables(spark, path, segments, "terms"), strict=True):
        grown = max(1.0, avgdl / segment["avgdl"]) if segment["avgdl"] else 1.0
        frames.append(frame.withColumn("max_gain", F.col("max_gain") * grown) if grown > 1 else frame)
    terms = united(frames)
    if len(frames) > 1:
        terms = terms.groupBy("term_bucket", "term").agg(
            F.sum("df").alias("df"),
            F.sum("n_texts").alias("n_texts"),
            F.max("max_gain").alias("max_gain"),
            # CHAMPIONS of each segment
            F.flatten(F.collect_list("champions")).alias("champions"),
        )
    return terms.withColumn("idf", _idf(F.lit(float(n_docs)), F.col("df")))


def _totals(segments: list[dict]) -> tuple[int, int, float]:
    """Documents, tokens and mean length of all segments."""
    n_docs, n_tokens = sum(s["n_docs"] for s in segments), sum(s["n_tokens"] for s in segments)
    return n_docs, n_tokens, n_tokens / n_docs if n_docs else 0.0


def _commit(spark: SparkSession, path: str, segments: list[dict], n_buckets: int, after: int) -> None:
    n_docs, _, avgdl = _totals(segments)
    mean_idf, longest, n_postings = (
        _merged_terms(spark, path, segments, n_docs, avgdl).agg(F.avg("idf"), F.max("n_texts"), F.sum("n_texts")).first()
    )
    content = {
        "parameters": {"k1": K1, "b": B, "epsilon": EPSILON},
        "n_buckets": n_buckets,
        "floor": EPSILON * (mean_idf or 0.0),
        "longest_list": longest or 0,
        "n_postings": n_postings or 0,
        "segments": segments,
    }
    commit(spark, path, content, after)


def _tokenised(corpus: DataFrame, id_col: str, key_col: str) -> DataFrame:
    # spread by position, a small corpus needs no further shuffle to count terms per text
    keyed = spread(corpus.select(F.col(id_col).cast("long").alias("doc_pos"), F.col(key_col).alias("key")), "doc_pos")
    return keyed.select("doc_pos", key_tokens(F.col("key")).alias("tokens"))


def build_lexical_index(
    corpus: DataFrame,
    path: str,
    key_col: str = "question",
    id_col: str = "doc_pos",
    overwrite: bool = False,
) -> LexicalIndex:
    """Write the index tables under ``path`` unless they are there, and open them."""
    spark = corpus.sparkSession
    held = read_version(spark, path)
    if held is None or overwrite:
        folder = new_segment()
        figures = _write_segment(_tokenised(corpus, id_col, key_col), f"{path}/{folder}", None, None)
        _commit(spark, path, [{"folder": folder, **figures}], figures["n_buckets"], held["version"] if held else 0)
    return open_lexical_index(spark, path)


def add_to_lexical_index(corpus: DataFrame, path: str, key_col: str = "question", id_col: str = "doc_pos") -> LexicalIndex:
    """Add the documents with new positions as a segment; no old file changes.

    Document frequencies, document and token counts of the segments add up; weights and
    scores follow from the sums when the index is read.
    """
    spark = corpus.sparkSession
    held = read_version(spark, path)
    known = open_lexical_index(spark, path, held["version"]).docs.select(F.col("doc_pos").alias(id_col))
    folder = new_segment()
    n_docs, n_tokens, _ = _totals(held["segments"])
    source = _tokenised(joined(corpus, known, id_col, "left_anti"), id_col, key_col)
    figures = _write_segment(source, f"{path}/{folder}", held["n_buckets"], {"n_docs": n_docs, "n_tokens": n_tokens})
    if figures["n_docs"]:
        _commit(spark, path, [*held["segments"], {"folder": folder, **figures}], held["n_buckets"], held["version"])
    return open_lexical_index(spark, path)


def open_lexical_index(spark: SparkSession, path: str, version: int | None = None) -> LexicalIndex:
    """Open the newest version or the given one; reads its version file only."""
    held = read_version(spark, path, version)
    segments = held["segments"]
    n_docs, _, avgdl = _totals(segments)

    def tables(name: str) -> DataFrame:
        frames = segment_tables(spark, path, segments, name)
        return united([frame.withColumn("segment", F.lit(i)) for i, frame in enumerate(frames)])

    postings = tables("postings").withColumn("gain", _gain(F.col("tf"), F.col("dl"), avgdl))
    return LexicalIndex(
        docs=tables("docs"),
        positions=tables("positions"),
        texts=tables("texts"),
        packed=united([spark.read.schema(_PACKED).parquet(f"{path}/{s['folder']}/packed") for s in segments]),
        postings=postings.select("term_bucket", "band", "term", "text_id", "tf", "dl", "gain"),
        terms=_merged_terms(spark, path, segments, n_docs, avgdl),
        n_docs=n_docs,
        n_texts=sum(s["n_texts"] for s in segments),
        n_buckets=held["n_buckets"],
        avgdl=avgdl,
        floor=held["floor"],
        longest_list=held["longest_list"],
        n_postings=held["n_postings"],
        segment_docs=tuple(s["n_docs"] for s in segments),
        version=held["version"],
        banded_over=segments[0].get("banded_over", 0),
        growth=max(1.0, avgdl / segments[0]["avgdl"]) if segments[0]["avgdl"] else 1.0,
    )


def _in_buckets(index: LexicalIndex, terms: DataFrame) -> LexicalIndex:
    """The index with the postings of the buckets that ``terms`` are in."""
    if index.n_buckets == 1:
        return index
    buckets = sorted(r["term_bucket"] for r in terms.select("term_bucket").distinct().collect())  # MAX_BUCKETS at most
    return replace(index, postings=index.postings.filter(F.col("term_bucket").isin(buckets)))


def _in_bands(index: LexicalIndex, read: DataFrame) -> LexicalIndex:
    """The index with the postings of ``read`` that can have an impact over ``miss``: whole folders are left out.

    A list that is kept whole is read whole. Of the long lists of a bucket those bands are read that
    one of its terms needs: a band's gains are below its upper end, grown with the mean length.
    """
    if index.n_buckets == 1:
        return index
    # a band more than needed where rounding could matter
    lowest = F.floor(F.col("miss") / (F.col("weight") * index.growth * _BAND_WIDTH) - 1e-6).cast("int")
    lowest = F.when(F.col("n_texts") > index.banded_over, F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), lowest))).otherwise(BANDS)
    # MAX_BUCKETS rows at most
    rows = read.groupBy("term_bucket").agg(F.min(lowest).alias("lowest")).collect()
    wanted = F.lit(False)
    for band in sorted({r["lowest"] for r in rows}):
        buckets = sorted(r["term_bucket"] for r in rows if r["lowest"] == band)
        wanted = wanted | (F.col("term_bucket").isin(buckets) & (F.col("band") >= band))
    return replace(index, postings=index.postings.filter(wanted))


def _rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def _question_terms(index: LexicalIndex, asked: DataFrame) -> DataFrame:
    """Known terms of each distinct question with weight and largest possible contribution."""
    counted = (
        _exploded(asked.select("ask", "tokens"))
        .groupBy("ask", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    weight = F.when(F.col("idf") < 0, F.lit(index.floor)).otherwise(F.col("idf"))
    return (
        joined(counted, index.terms, "term")
        .withColumn("weight", F.col("qtf") * weight)
        .withColumn("most", F.col("weight") * F.col("max_gain"))
        .select("ask", "term_bucket", "term", "weight", "most", "n_texts", "champions")
    )


def _matching_postings(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted terms; the lists of frequent terms are spread over salted keys."""
    # spread by text, small postings need no further shuffle to sum up a text's score
    postings = spread(index.postings.select("term_bucket", "term", "text_id", "gain"), "text_id")
    salt_rows = max(POSTINGS_PER_SALT, -(-index.n_postings // MAX_SALTED_TERMS))
    if index.longest_list <= salt_rows:
        return joined(postings, wanted, ["term_bucket", "term"])
    # at most MAX_SALTED_TERMS lists can be longer than salt_rows
    frequent = F.broadcast(
        index.terms.filter(F.col("n_texts") > salt_rows).select(
            "term_bucket", "term", F.ceil(F.col("n_texts") / salt_rows).cast("int").alias("n_salts")
        )
    )
    keys = ["term_bucket", "term"]
    n_salts = F.coalesce("n_salts", F.lit(1))
    salted = (
        postings.join(frequent, keys, "left")
        .withColumn("salt", F.pmod(F.xxhash64("text_id"), n_salts).cast("int"))
        .drop("n_salts")
    )
    spread_terms = (
        wanted.join(frequent, keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .drop("n_salts")
    )
    return joined(salted, spread_terms, [*keys, "salt"])


def _score_all(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Score of every (question, text) that share a term."""
    return (
        _matching_postings(index, terms.select("ask", "term_bucket", "term", "weight"))
        .groupBy("ask", "text_id")
        .agg(F.sum(F.col("weight") * F.col("gain")).alias("score"))
    )


def _asked_terms(terms: DataFrame, columns: list[str]) -> DataFrame:
    """A row per question with the list ``asked`` of its terms and their ``columns``."""
    return terms.groupBy("ask").agg(F.collect_list(F.struct("term", *columns)).alias("asked"))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column, and where the list of each row begins and the last one ends."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return whole.flatten(), np.append(0, np.cumsum(pc.list_value_length(whole).to_numpy()))


class _Block:
    """The postings of a block of texts, by term."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, terms: pa.Array, gain: np.ndarray, repeats: bool) -> None:
        self.repeats = repeats
        words = terms.dictionary_encode()
        codes = words.indices.to_numpy()
        order = codes.argsort(kind="stable")
        self.ids, self.words, self.row, self.gain = ids, words.dictionary, row[order], gain[order]
        self.begins = np.append(0, np.cumsum(np.bincount(codes, minlength=len(self.words))))
        self.size = len(ids)

    def add(self, total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """Add the values of one term's rows; a position that repeats may be in a list more than once."""
        if self.repeats:
            np.add.at(total, rows, values)
        else:
            total[rows] += values

    def questions(self, chunk: pa.Table) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
        """Each question with its place, its terms that the block has (as places in its list) and their postings."""
        asked, ends = _flat(chunk["asked"])
        code = pc.fill_null(pc.index_in(pc.struct_field(asked, "term"), value_set=self.words), -1).to_numpy()
        for i in range(chunk.num_rows):
            own = np.flatnonzero(code[ends[i] : ends[i + 1]] >= 0) + ends[i]
            if len(own):
                spans = [slice(self.begins[c], self.begins[c + 1]) for c in code[own]]
                yield i, own, [(self.row[s], self.gain[s]) for s in spans], ends


def _pairs_table(chunk: pa.Table, schema: pa.Schema, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    if not found:
        return schema.empty_table()
    place = np.repeat([i for i, _, _ in found], [len(ids) for _, ids, _ in found])
    ids, scores = (np.concatenate(column) for column in ([x for _, x, _ in found], [x for _, _, x in found]))
    return pa.table([chunk["ask"].take(pa.array(place)), pa.array(ids), pa.array(scores)], schema=schema)


def _best_of_block(k: int, avgdl: float, ask_type: pa.DataType):
    """The k best texts of one block for each question of one chunk, by rounded score, then position."""
    schema = pa.schema([("ask", ask_type), ("text_id", pa.int64()), ("score", pa.float64())])

    def run(texts: pa.Table, chunk: pa.Table) -> pa.Table:
        if not texts.num_rows or not chunk.num_rows:
            return schema.empty_table()
        texts = texts.filter(pc.not_equal(texts["words"], ""))
        terms, ends = _flat(pc.split_pattern(texts["words"], " "))
        if not len(terms):
            return schema.empty_table()
        row = np.repeat(np.arange(texts.num_rows), np.diff(ends))
        gain = _gain(_flat(texts["tfs"])[0].to_numpy(), texts["dl"].to_numpy()[row], avgdl)
        ids, place = np.unique(texts["text_id"].to_numpy(), return_inverse=True)
        block, found = _Block(ids, place[row], terms, gain, len(ids) < texts.num_rows), []
        weights = pc.struct_field(_flat(chunk["asked"])[0], "weight").to_numpy()
        score, n = np.zeros(block.size), min(k, block.size)
        for i, own, postings, _ in block.questions(chunk):
            score[:] = 0.0
            for weight, (rows, gains) in zip(weights[own], postings, strict=True):
                block.add(score, rows, weight * gains)
            limit = np.partition(score, block.size - n)[block.size - n] - _MARGIN
            near = np.flatnonzero((score >= limit) & (score > 0))
            ids, scores = block.ids[near], score[near]
            best = np.lexsort((-ids, -np.floor(scores * 10**SCORE_DIGITS + 0.5)))[:n]
            found.append((i, ids[best], scores[best]))
        return _pairs_table(chunk, schema, found)

    return run


def _survivors_of_block(ask_type: pa.DataType):
    """The texts of one block whose best possible score reaches the floor of a question of one chunk."""
    schema = pa.schema([("ask", ask_type), ("text_id", pa.int64()), ("score", pa.float64())])

    def run(postings: pa.Table, chunk: pa.Table) -> pa.Table:
        if not postings.num_rows or not chunk.num_rows:
            return schema.empty_table()
        ids, row = np.unique(postings["text_id"].to_numpy(), return_inverse=True)
        terms = pa.concat_arrays(postings["term"].chunks)
        block, found = _Block(ids, row, terms, postings["gain"].to_numpy(), True), []
        flat = _flat(chunk["asked"])[0]
        weight, miss, missed, floor = (pc.struct_field(flat, c).to_numpy() for c in ("weight", "miss", "missed", "floor"))
        partial, hit = np.zeros(block.size), np.zeros(block.size, bool)
        for i, own, lists, _ in block.questions(chunk):
            partial[:], hit[:] = 0.0, False
            for w, m, (rows, gains) in zip(weight[own], miss[own], lists, strict=True):
                over = w * gains > m
                block.add(partial, rows[over], w * gains[over] - m)
                hit[rows[over]] = True
            near = np.flatnonzero(hit & (partial + missed[own[0]] >= floor[own[0]]))
            found.append((i, block.ids[near], partial[near]))
        return _pairs_table(chunk, schema, found)

    return run


def _meet(rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, most: int, kernel) -> DataFrame:
    """``kernel`` on each block of texts with each chunk of questions; ``rows`` have ``n_rows`` postings of ``text_id``."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n_rows // BLOCK_POSTINGS))
    n_chunks = max(1, -(-n_asked // max(1, min(CHUNK_QUESTIONS, MEETING_ROWS // most))))
    # small tables are cut finer, so that every core has a share: the side whose copies cost less
    while n_blocks * n_chunks < 2 * cores and (n_rows > 20_000 * n_blocks or n_asked > 64 * n_chunks):
        if n_rows * n_chunks > 32 * n_asked * n_blocks and n_rows > 20_000 * n_blocks or n_asked <= 64 * n_chunks:
            n_blocks *= 2
        else:
            n_chunks *= 2
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(n_blocks)).cast("int")).withColumn("chunk", every(n_chunks))
    chunks = asked.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.lit(n_chunks)).cast("int")).withColumn("block", every(n_blocks))
    ask = StructField("ask", asked.schema["ask"].dataType)
    schema = StructType([ask, StructField("text_id", LongType()), StructField("score", DoubleType())])
    keys = ["block", "chunk"]
    return blocks.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(kernel(to_arrow_type(ask.dataType)), schema)


def _score_blocks(index: LexicalIndex, terms: DataFrame, k: int, n_asked: int, only: DataFrame | None = None) -> DataFrame:
    """The best texts per question, k of each block, with their full scores; ``only`` the texts named there, if given."""
    texts, n_rows = index.packed.select("text_id", "dl", "words", "tfs"), index.n_postings
    if only is not None:
        only = materialize(only.select("text_id").distinct(), "texts")
        texts, n_rows = joined(texts, only, "text_id", "left_semi"), only.count() * max(1, index.n_postings // max(1, index.n_texts))
    kernel = lambda kind: _best_of_block(k, index.avgdl, kind)
    return _meet(texts, n_rows, _asked_terms(terms, ["weight"]), n_asked, k, kernel)


def _score_promising(index: LexicalIndex, terms: DataFrame, k: int, n_asked: int) -> DataFrame:
    """Scores of all texts that can be among a question's best k; needs weights of at least 0."""
    # a floor for the k-th score: full scores of the best texts of the strongest terms
    seeds = (
        top_k(terms, SEED_TERMS, "ask", [F.desc("most"), F.asc("term")])
        .select(F.explode("champions").alias("text_id"))
    )
    floors = (
        top_k(_score_blocks(index, terms, k, n_asked, seeds), k, "ask", [F.desc("score"), F.desc("text_id")])
        .filter(F.col("rank") == k)
        .select("ask", (F.col("score") - _MARGIN).alias("floor"))
    )
    # allowances: what a text may miss from each term, together below the floor
    frequent_first = Window.partitionBy("ask").orderBy(F.desc("n_texts"), F.asc("term"))
    whole = Window.partitionBy("ask")
    # a question of frequent words only is best served by reading the peaks of their lists;
    # otherwise half the floor is kept back to sort out texts by their partial score
    share = F.when(F.min("n_texts").over(whole) > F.lit(max(1000, index.n_texts // 100)), 1.0).otherwise(0.5)
    before = F.coalesce(F.sum("most").over(frequent_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    budget = F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(0.0))
    planned = (
        terms.select("ask", "term_bucket", "term", "weight", "most", "n_texts")
        .join(floors, "ask", "left")
        .withColumn("floor", budget)
        .withColumn("before", before)
        .withColumn("share", share)
        .withColumn(
            "miss",
            F.greatest(F.lit(0.0), F.least(F.col("most"), F.col("share") * F.col("floor") - F.col("before"))),
        )
        .withColumn("missed", F.sum("miss").over(whole))
    )
    read = materialize(
        planned.filter(F.col("most") > F.col("miss")).select(
            "ask", "term_bucket", "term", "weight", "n_texts", "miss", "missed", "floor"
        ),
        "read_terms",
    )
    # a posting is of use if its impact is over the allowance of some question; where no term has an allowance, all are
    least = read.groupBy("term_bucket", "term").agg(F.min(F.col("miss") / F.col("weight")).alias("least"), F.max("n_texts").alias("n_texts"))
    least = materialize(least, "least_gains")
    n_rows = least.agg(F.coalesce(F.sum("n_texts"), F.lit(0))).first()[0]
    wanted = _matching_postings(_in_bands(index, read), least.drop("n_texts")).filter(F.col("gain") >= F.col("least") * (1 - 1e-9))
    asked = _asked_terms(read, ["weight", "miss", "missed", "floor"])
    rows = wanted.select("text_id", "term", "gain")
    survivors = materialize(_meet(rows, n_rows, asked, n_asked, 1, _survivors_of_block).select("text_id"), "survivors")
    return _score_blocks(index, terms, k, n_asked, survivors)


def _all_copies(index: LexicalIndex, scored: DataFrame, k: int | None) -> DataFrame:
    """From texts to documents: every copy, or the k highest positions of each text."""
    if index.n_texts == index.n_docs:
        return scored.withColumnRenamed("text_id", "doc_pos")
    keys = ["segment", "digest"]
    named = joined(scored, index.texts.filter("n_copies > 1").select("text_id", *keys), "text_id", "left")
    single = named.filter(F.col("digest").isNull()).select("ask", F.col("text_id").alias("doc_pos"), "score")
    many = named.filter(F.col("digest").isNotNull()).select("ask", *keys, "score")
    copies = joined(index.docs.select(*keys, "doc_pos"), many.select(*keys).distinct(), keys, "left_semi")
    if k is not None:
        copies = top_k(copies, k, keys, [F.desc("doc_pos")]).drop("rank")
    return single.unionByName(joined(many, copies, keys).select("ask", "doc_pos", "score"))


def _with_zero_rows(index: LexicalIndex, asks: DataFrame, nonzero: DataFrame, k: int) -> DataFrame:
    """Fill questions with fewer than k positive documents with zero scores, highest positions first.

    Among the first n + k positions from the top of a segment at least k are free, or all that are
    left, when n documents have a score of their own.
    """
    counts = nonzero.groupBy("ask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("n_positive")
    )
    step = 1000
    sizes = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(n).cast("long").alias("size")) for i, n in enumerate(index.segment_docs)]))
    short = joined(asks, counts, "ask", "left").filter(F.coalesce("n_positive", F.lit(0)) < k).withColumn("of", sizes)
    short = short.select(
        "ask", F.col("of.segment").alias("segment"), F.least("of.size", F.coalesce("n", F.lit(0)) + k).cast("long").alias("reach")
    ).filter("reach > 0")
    slots = short.select(
        "ask", "segment", "reach", F.explode(F.expr(f"sequence(0L, (reach - 1) div {step})")).alias("chunk")
    ).select(
        "ask", "segment",
        F.explode(F.expr(f"sequence(chunk * {step}, least(reach, (chunk + 1) * {step}) - 1)")).alias("from_top"),
    )
    ranks, by_place = index.positions, joined
    if not index.weights_may_be_negative and 2 * k * len(index.segment_docs) <= BROADCAST_POSITIONS:
        # nonzero scores are positive here, so a short question has fewer than k of them
        ranks, by_place = F.broadcast(ranks.filter(F.col("from_top") < 2 * k)), DataFrame.join
    place = ["segment", "from_top"]
    taken = by_place(joined(nonzero, short.select("ask").distinct(), "ask", "left_semi"), ranks, "doc_pos").select("ask", *place)
    free = by_place(joined(slots, taken, ["ask", *place], "left_anti"), ranks, place)
    zeros = top_k(free, k, "ask", [F.desc("doc_pos")]).select("ask", "doc_pos", F.lit(0.0).alias("score"))
    return nonzero.unionByName(zeros)


def bm25_search(
    index: LexicalIndex,
    questions: DataFrame,
    k: int = 3,
    id_col: str = "query_id",
    text_col: str = "question",
    direct_hits: int = DIRECT_HITS,
) -> DataFrame:
    """The k best documents per question: ``id_col, rank, doc_pos, score``; question ids are unique.

    Higher score first, then higher position; every question gets
    min(k, documents) rows, with score 0 where nothing matches.
    """
    words = tokens(F.coalesce(F.col(text_col), F.lit("")))
    asked_all = materialize(
        questions.select(F.col(id_col).alias("query_id"), words.alias("tokens")).withColumn(
            "digest", F.sha2(F.array_join("tokens", " "), 256)
        ),
        "questions",
    )
    groups = asked_all.groupBy("digest").agg(F.min("query_id").alias("ask"))
    asked = joined(asked_all, groups.select("ask"), F.col("query_id") == F.col("ask"), "left_semi").select(
        F.col("query_id").alias("ask"), "digest", "tokens"
    )
    terms = materialize(_question_terms(index, asked), "question_terms")
    index = _in_buckets(index, terms)
    order = [F.desc("score"), F.desc("text_id")]
    if k < 1:
        raise ValueError("k must be at least 1")
    if index.weights_may_be_negative:
        scored = _score_all(index, terms).withColumn("score", _rounded(F.col("score")))
        nonzero = materialize(_all_copies(index, scored.filter("score <> 0"), None), "scored")
    else:
        hits, n_asked = terms.agg(F.coalesce(F.sum("n_texts"), F.lit(0)), F.count_distinct("ask")).first()
        # allowances pay where few questions meet many texts
        if hits <= direct_hits or n_asked > CHUNK_QUESTIONS:
            scored = _score_blocks(index, terms, k, n_asked)
        else:
            scored = _score_promising(index, terms, k, n_asked)
        scored = scored.withColumn("score", _rounded(F.col("score"))).filter("score > 0")
        best = materialize(top_k(scored, k, "ask", order).drop("rank"), "best_texts")
        nonzero = _all_copies(index, best, k)
        if index.n_texts != index.n_docs:
            nonzero = materialize(
                top_k(nonzero, k, "ask", [F.desc("score"), F.desc("doc_pos")]).drop("rank"), "best_docs"
            )
    filled = _with_zero_rows(index, asked.select("ask"), nonzero, k)
    ranked = top_k(filled, k, "ask", [F.desc("score"), F.desc("doc_pos")])
    answered = joined(ranked, asked.select("ask", "digest"), "ask").drop("ask")
    return (
        joined(asked_all.select("query_id", "digest"), answered, "digest")
        .select(F.col("query_id").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_pos", "score")
    )
