"""Benchmark items inside training documents, through a distributed positional inverted index.

The index keeps the token sequence of every document and, for each term that a test text
has, its postings: document row and position. A phrase is looked up from its rarest terms:
the list of the rarest one gives possible starts, which are intersected with the
offset-adjusted list of the second rarest; what is left is compared with the stored
tokens. Proximity asks for the rarest terms of an item within a span of words.
Column expressions and joins only.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import materialize
from lorequery.session import tidied

#: A word is a run of letters a-z, digits and characters beyond ASCII, after lower-casing A-Z.
#: Stated by what it holds: the same class stated by what it lacks is matched five times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Words of a window.
WINDOW = 10
#: Rarest terms of an item that must stand together, and the words of the span that holds them.
NEAR_TERMS, NEAR_SPAN = 3, 20
#: Bytes of test terms or windows that are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20

#: Characters that both kinds of lower case leave as they are.
_PLAIN = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Z}]"


def words_of(text: Column) -> Column:
    """The words of a whole text; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # the general lower case is several times faster; it differs only beyond these characters
    low = F.when(text.rlike(_PLAIN), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


@dataclass
class PositionalIndex:
    """``documents`` (row, id, n_words, words), ``terms`` (term, number, n) and ``postings`` (row, pos, number)."""

    documents: DataFrame
    terms: DataFrame
    postings: DataFrame


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a small written table, by the bytes of its rows; a larger one is left to a shuffle join."""
    row = F.lit(8 * len(df.columns) + 32)
    for column, kind in df.dtypes:
        if kind == "string":
            row = row + F.octet_length(column)
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else df


def build_index(docs: DataFrame, terms: DataFrame | None, id_col: str, text_col: str) -> PositionalIndex:
    """Index the words of ``docs`` that are in the ``term`` column of ``terms``, or all words.

    Every row is a document of its own, whatever its id. Terms that no document has are left out.
    """
    documents = materialize(
        docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).select(
            F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), "words"
        ),
        "token-sequences",
    )
    if terms is None:
        terms = documents.select(F.explode("words").alias("term"))
    numbered = materialize(
        terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "terms"
    )
    tokens = documents.select("row", F.posexplode("words").alias("pos", "term"))
    postings = materialize(tokens.join(_bounded(numbered), "term").select("row", "pos", "number"), "postings")
    counts = postings.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    return PositionalIndex(documents, materialize(numbered.join(counts, "number"), "term-counts"), postings)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, words`` of the items that have words; equal rows once, a null id is the empty string."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    return own.filter(F.size("words") > 0).distinct()


def item_windows(words: DataFrame, size: int) -> DataFrame:
    """``item, phrase, size``: each run of ``size`` words of an item, or all its words where it has fewer."""
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    phrase = F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " ")))
    return words.select("item", phrase.alias("phrase"), length.alias("size")).distinct()


@tidied
def _starts(postings: DataFrame, lookups: DataFrame) -> DataFrame:
    """``row, start, window`` where the two rarest terms of a window stand at their offsets."""
    rarest, next_one = F.get("lists", F.lit(0)), F.get("lists", F.lit(1))
    first = lookups.select(
        "window", rarest["number"].alias("number"), rarest["offset"].alias("offset"),
        next_one["number"].alias("second"), next_one["offset"].alias("ahead"),
    )
    found = (
        postings.join(_bounded(materialize(first, "rarest")), "number")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .filter("start >= 0")
        .select("row", "start", "window", "second", (F.col("start") + F.col("ahead")).alias("place"))
    )
    seconds = materialize(first.select(F.col("second").alias("number")).filter("number is not null").distinct(), "second-rarest")
    lists = postings.join(_bounded(seconds), "number", "left_semi").select(
        "row", F.col("pos").alias("place"), F.col("number").alias("second")
    )
    both = found.filter("second is not null").join(lists, ["row", "place", "second"])
    columns = ["row", "start", "window"]
    return materialize(both.select(columns).unionByName(found.filter("second is null").select(columns)), "phrase-starts")


def phrase_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """``row, found``: the exact occurrences (start, size, window) of ``phrases`` (window, phrase, size) by document.

    A document's occurrences are one array, as long as the text allows.
    """
    terms = phrases.select("window", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    lookups = (
        terms.join(index.terms, "term")
        .groupBy("window", "size")
        # as many as a window has words
        .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "number"))).alias("lists"))
        .filter(F.size("lists") == F.col("size"))
    )
    starts = _starts(index.postings, materialize(lookups, "lookups"))
    named = starts.join(_bounded(phrases), "window")
    by_row = named.groupBy("row").agg(F.collect_list(F.struct("start", "size", "window", "phrase")).alias("starts"))
    checked = F.filter("starts", lambda s: F.array_join(F.slice("words", s["start"] + 1, s["size"]), " ") == s["phrase"])
    found = F.transform(checked, lambda s: F.struct(s["start"], s["size"], s["window"]))
    matches = index.documents.select("row", "words").join(by_row, "row").select("row", found.alias("found"))
    return materialize(matches.filter(F.size("found") > 0), "phrase-matches")


def proximity_matches(index: PositionalIndex, words: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """``row, item`` where the rarest ``terms`` terms of an item stand within ``span`` consecutive words.

    The rarest are among the item's different terms that documents have, ties by term; an
    item with a single one is not looked for.
    """
    different = words.select("item", F.explode("words").alias("term")).distinct().join(index.terms, "term")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))
    rarest = different.withColumn("place", rank).filter(F.col("place") <= terms)
    wanted = materialize(
        rarest.select("item", "number", "place", F.count(F.lit(1)).over(Window.partitionBy("item")).alias("asked")).filter("asked > 1"),
        "near-terms",
    )
    lists = index.postings.join(_bounded(wanted), "number").select("item", "row", "pos", "place", "asked")
    # only documents on the rarest list can match
    pairs = lists.filter("place = 1").select("item", "row").distinct()
    so_far = Window.partitionBy("item", "row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = [F.last(F.when(F.col("place") == i + 1, F.col("pos")), ignorenulls=True).over(so_far) for i in range(terms)]
    latest = lists.join(pairs, ["item", "row"], "left_semi").withColumn("seen", F.array(*seen))
    asked = F.slice("seen", F.lit(1), F.col("asked").cast("int"))
    near = F.forall(asked, lambda x: x.isNotNull()) & (F.col("pos") - F.array_min(asked) < span)
    return materialize(latest.filter(near).select("row", "item").distinct(), "near-matches")


@tidied
def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items, n_near`` per row of ``docs``.

    ``n_hit`` counts the document's words inside an occurrence of a window of some item, ``items`` are the
    ids of those items as sorted strings, ``n_near`` the items whose rarest terms stand close together. Null and wordless
    texts have no words and hit nothing; rows of one id, also equal rows, each have their result; items of one id are
    one item, and a null item id is the empty string. Without documents there are no rows, without items no hits.
    """
    words = materialize(item_words(items, item_id_col, item_text_col), "item-words")
    windows = materialize(item_windows(words, window), "item-windows")
    phrases = materialize(
        windows.select("phrase", "size").distinct().withColumn("window", F.monotonically_increasing_id()), "windows"
    )
    index = build_index(docs, words.select(F.explode("words").alias("term")), id_col, text_col)
    matches = phrase_matches(index, phrases)
    covered = F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["size"] - 1)))
    hits = matches.select("row", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    named = windows.join(phrases, ["phrase", "size"]).select("item", "window")
    occurring = matches.select("row", F.explode(F.array_distinct(F.transform("found", lambda f: f["window"]))).alias("window"))
    listed = occurring.join(named, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    near = proximity_matches(index, words).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    result = (
        index.documents.select("row", "id", "n_words")
        .join(hits.join(listed, "row").join(near, "row", "full"), "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )
    return materialize(result.withColumn("n_items", F.size("items").cast("long")), "contamination")
