"""Exact removal of long byte strings that occur earlier in the corpus.

Strings that are equal have the same anchor: the gram with the smallest hash in them. So only places
whose anchor occurs twice can matter, and where the whole context of an anchor
has occurred before, all its strings have. What stays open are contexts that share an anchor but
differ, at the borders of repeated passages. Those are indexed in bounded groups: the
contexts' Burrows-Wheeler transform is compressed into runs, suffix positions and match lengths
are sampled where runs start, and streaming over the text fills in the match lengths
in between. Strings with a match of full length to an earlier position are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequery.llm.common import free_name, materialize, materialize_texts
from lorequery.llm.hashing import hash_ranges, mix
from lorequery.session import tidied

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes of an anchor gram, and grams in a string of LENGTH bytes.
GRAM = 24
GRAMS = LENGTH - GRAM + 1

_SLICE = 1 << 18
_BITS = 19  # positions in a slice, which reaches LENGTH bytes into the next
_MASK = np.uint64((1 << _BITS) - 1)



#: Contexts that one index holds, about; those of an anchor with more of them are split by what stands beside it.
GROUP = 1000
_NO_ID = -(1 << 63)


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hashes, context hashes, and the first and last start and the anchor offset of each.

    Each string of LENGTH bytes belongs to its gram with the smallest hash, the leftmost
    of equals, so equal strings have equal anchors at equal offsets. Consecutive strings of
    one anchor form its context.
    """
    found = []
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, _SLICE):
        codes = whole[at : at + _SLICE + LENGTH - 1].astype(np.uint64) + np.uint64(1)
        n = len(codes)
        grams = mix(hash_ranges(codes, 0, slice(0, n - GRAM + 1), slice(GRAM, n + 1)))
        keys = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
        # minima of all runs of GRAMS keys, from prefix and suffix minima of blocks
        blocks = -(-len(keys) // GRAMS)
        padded = np.full(blocks * GRAMS, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        padded = padded.reshape(blocks, GRAMS)
        prefix = np.minimum.accumulate(padded, axis=1).ravel()
        suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - LENGTH + 1
        place = (np.minimum(suffix[:starts], prefix[GRAMS - 1 : GRAMS - 1 + starts]) & _MASK).astype(np.int64)
        change = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], change))
        last = np.concatenate((change - 1, [starts - 1]))
        own = place[first]
        context = hash_ranges(codes, 1, first, last + LENGTH)
        shape = ((last - first) * LENGTH + own - first).astype(np.uint64)
        context = mix(context + mix(shape))
        found.append((grams[own].view(np.int64), context.view(np.int64), at + first, at + last, own - first))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of separated texts, with samples at run heads."""

    def __init__(self, texts: list[bytes]) -> None:
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        codes = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        codes[self.starts[1:] - 1] = 0
        codes[-1] = 0
        self.codes, n = codes, len(codes)
        self.ranks = [self._first_ranks(codes)]
        self.order = np.argsort(self.ranks[0], kind="stable")
        self.step = 7
        while self.ranks[-1].max() < n - 1:
            ahead = np.zeros(n, dtype=np.int64)
            width = self.step << (len(self.ranks) - 1)
            ahead[: n - width] = self.ranks[-1][width:]
            keys = self.ranks[-1] * n + ahead
            self.order = np.argsort(keys)
            ranks = np.empty(n, dtype=np.int64)
            ranks[self.order] = np.concatenate(([0], np.cumsum(np.diff(keys[self.order]) != 0)))
            self.ranks.append(ranks)
        # symbols before each suffix; separators differ from each other, so each is a run of its own
        before = codes[self.order - 1]
        change = np.flatnonzero((np.diff(before) != 0) | (before[1:] == 0)) + 1
        self.heads = np.concatenate(([0], change))
        self.symbols = before[self.heads]
        self.head_samples = self.order[self.heads]
        self.above_samples = self.order[self.heads - 1]

    @staticmethod
    def _first_ranks(codes: np.ndarray) -> np.ndarray:
        """Ranks by seven symbols; a suffix that reaches its separator is told apart by its place."""
        n = len(codes)
        packed, ended = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for ahead in range(7):
            own = np.zeros(n, dtype=np.int64)
            own[: n - ahead] = codes[ahead:]
            ended |= own == 0
            packed = packed * 512 + np.where(ended, 0, own)
        place = np.where(ended, np.arange(n), 0)
        order = np.lexsort((place, packed))
        differs = (np.diff(packed[order]) != 0) | (np.diff(place[order]) != 0)
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(differs)))
        return ranks

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffix pairs."""
        done, n = np.zeros(len(a), dtype=np.int64), len(self.codes)
        for level in range(len(self.ranks) - 1, -1, -1):
            width, ranks = self.step << level, self.ranks[level]
            x, y = a + done, b + done
            inside = (x < n) & (y < n)
            same = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
            done += np.where(same, width, 0)
        for _ in range(self.step):
            x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
            same = (self.codes[x] == self.codes[y]) & (self.codes[x] != 0)
            done += same
        return done

    def match_lengths(self) -> np.ndarray:
        """For every suffix in sorted order, how much it has in common with the one above.

        Computed at run heads only; along the text a length falls by one per position
        until the next head.
        """
        n = len(self.codes)
        at = np.argsort(self.head_samples)
        positions = self.head_samples[at]
        lengths = self._common(positions, self.above_samples[at])
        lengths[positions == self.order[0]] = 0
        last = np.searchsorted(positions, np.arange(n), side="right") - 1
        streamed = lengths[last] - (np.arange(n) - positions[last])
        return streamed[self.order]

    def earlier(self, length: int) -> np.ndarray:
        """True at text positions whose next ``length`` symbols also start at a smaller position."""
        cuts = np.flatnonzero(self.match_lengths() < length)
        if not len(cuts) or cuts[0] != 0:
            cuts = np.concatenate(([0], cuts))
        first = np.minimum.reduceat(self.order, cuts)
        sizes = np.diff(np.concatenate((cuts, [len(self.order)])))
        out = np.zeros(len(self.codes), dtype=bool)
        out[self.order] = np.repeat(first, sizes) != self.order
        return out


def _repeated_starts(texts: list[bytes]) -> list[np.ndarray]:
    """Per context, which of its strings also start earlier; contexts are in order of their place."""
    flags = [np.zeros(len(t) - LENGTH + 1, dtype=bool) for t in texts]
    sizes = np.array([len(f) for f in flags])
    starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
    codes = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    # strings whose hash is unique here cannot match; the index holds the stretches of the others
    _, inverse, counts = np.unique(
        hash_ranges(codes, 0, place, place + LENGTH), return_inverse=True, return_counts=True
    )
    open_ = np.split(counts[inverse] > 1, np.cumsum(sizes)[:-1])
    pieces, where = [], []
    for i, own in enumerate(open_):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        for first, end in zip(edges[::2], edges[1::2], strict=True):
            pieces.append(texts[i][first : end - 1 + LENGTH])
            where.append((i, first, end))
    if pieces:
        index = RunIndex(pieces)
        earlier = index.earlier(LENGTH)
        for (i, first, end), start in zip(where, index.starts, strict=True):
            flags[i][first:end] = earlier[start : start + end - first]
    return flags


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True where one of the spans covers a byte."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _spans(flags: np.ndarray, offset: int) -> list[tuple[int, int]]:
    """Byte spans covered by the flagged starts."""
    return [(offset + first, offset + end - 1 + LENGTH) for first, end in _runs(flags)]


_PLACE = 14  # bits of a place for the number of starts and the anchor offset


def _own(text: str) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
    """Distinct contexts of a document, the spans that its own repeats settle, and anchors that repeat.

    Contexts and spans are ``anchor, context, place``; a span has its start as place and its end as
    context, and the anchor of a context in it.
    """
    anchor, context, first, last, offset = anchors(text.encode("utf-8", "surrogatepass"))
    again = np.zeros(len(anchor), dtype=bool)
    order = np.lexsort((first, context, anchor))
    again[order[1:]] = (np.diff(anchor[order]) == 0) & (np.diff(context[order]) == 0)
    place = (first << _PLACE) | ((last - first) << (_PLACE // 2)) | offset
    kept = ~again
    spans = (np.zeros(0, dtype=np.int64),) * 3
    if again.any():
        gone = _covered(first[again], last[again] + LENGTH, int(last.max()) + LENGTH)
        runs = np.array(_runs(gone), dtype=np.int64).reshape(-1, 2)
        heads = np.searchsorted(first[again], runs[:, 0])
        spans = (anchor[again][heads], runs[:, 1], runs[:, 0])
    return (anchor[kept], context[kept], place[kept]), spans, anchor[again]


def _anchor_counts(rows: DataFrame) -> DataFrame:
    """``anchor, n`` per batch: in how many documents it is, one more where it repeats inside one."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [_own(text) for text in part["text"]]
            every = np.concatenate([a for (a, _, _), _, _ in found] + [again for _, _, again in found])
            anchor, n = np.unique(every, return_counts=True)
            yield pd.DataFrame({"anchor": anchor, "n": n.astype(np.int32)})

    return rows.select("text").mapInPandas(scan, "anchor long, n int")


def _scan(rows: DataFrame) -> DataFrame:
    """Anchors of every document, each distinct context of it once; ``here`` rows are spans settled inside it."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [_own(text)[:2] for text in part["text"]]
            out = []
            for which in range(2):
                sizes = [len(own[which][0]) for own in found]
                columns = [np.concatenate([own[which][i] for own in found]) for i in range(3)]
                keys = {c: np.repeat(part[c].to_numpy(), sizes) for c in ("doc", "tag")}
                out.append(
                    pd.DataFrame(keys | {"here": which == 1} | dict(zip(("anchor", "context", "place"), columns, strict=True)))
                )
            yield pd.concat(out)

    return rows.mapInPandas(scan, "doc long, tag long, here boolean, anchor long, context long, place long")


def _key(id_col: str, text_col: str, tagged: bool) -> tuple[Column, Column]:
    """A document's number and, where ids repeat, a hash of its text."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    return number, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if tagged else F.lit(0).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, tagged: bool) -> DataFrame:
    number, tag = _key(id_col, text_col, tagged)
    return docs.filter(F.octet_length(text_col) >= LENGTH).select(
        number.alias("doc"), tag.alias("tag"), F.col(text_col).alias("text")
    )


#: Bytes of a string beside its anchor.
_BESIDE = LENGTH - GRAM


def _halves(contexts: DataFrame) -> DataFrame:
    """Contexts cut in two: the strings with many bytes before the anchor, and those with few.

    Strings whose anchor stands at offsets ``low`` to ``high`` share ``low`` bytes before it and
    _BESIDE - ``high`` after it, so equal strings have equal ``side`` bytes, and each half compares only
    the contexts that have them in common. Half a context is a context of fewer strings.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    ranges = F.explode(F.array(F.struct(F.col("low").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("high").alias("h"))))
    cut = contexts.withColumn("range", ranges).withColumns(
        {
            "i": F.greatest(F.col("offset") - F.col("range.h"), F.lit(0)),
            "j": F.least(F.col("offset") - F.col("range.l"), F.length("bytes") - LENGTH),
        }
    )
    cut = cut.filter("i <= j").select(
        "doc", "tag", "anchor",
        (F.col("first") + F.col("i")).alias("first"),
        (F.col("offset") - F.col("i")).alias("offset"),
        F.col("range.l").alias("low"),
        F.col("range.h").alias("high"),
        F.substring("bytes", F.col("i") + 1, F.col("j") - F.col("i") + LENGTH).alias("bytes"),
    )
    before = F.substring("bytes", F.col("offset") - F.col("low") + 1, F.col("low"))
    after = F.substring("bytes", F.col("offset") + GRAM + 1, _BESIDE - F.col("high"))
    return cut.withColumn("side", F.md5(F.concat(before, after)))


def _deal_hot(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split the contexts of anchors with more than GROUP of them until those that can hold equal strings are fewer.

    Gives the spans of halves that are equal to an earlier one, and the other halves with the group
    that settles them. The last halves hold a single string, so that no group stays too large.
    """
    spot = F.struct("doc", "tag", "first")
    group = ["anchor", "low", "high", "side"]
    spans, settled = [], []
    while True:
        halves = materialize(_halves(contexts), "half-contexts")
        heads = halves.groupBy(*group, "offset", "bytes").agg(F.min(spot).alias("head"))
        led = materialize(
            halves.join(heads, [*group, "offset", "bytes"]).withColumn("leads", spot == F.col("head")).drop("head"), "half-leaders"
        )
        followers = led.filter("not leads")
        spans.append(
            followers.select("doc", "tag", F.col("first").alias("start"), (F.col("first") + F.length("bytes")).alias("end"))
        )
        leaders = led.filter("leads").drop("leads")
        sizes = leaders.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        sized = materialize(leaders.join(sizes.filter("n > 1"), group), "half-groups")
        settled.append(sized.filter(F.col("n") <= GROUP))
        contexts = sized.filter(F.col("n") > GROUP).select("doc", "tag", "anchor", "first", "offset", "low", "high", "bytes")
        if contexts.limit(1).isEmpty():
            break
    together = settled[0]
    for own in settled[1:]:
        together = together.unionByName(own)
    every = spans[0]
    for own in spans[1:]:
        every = every.unionByName(own)
    return every, together.select("doc", "tag", "first", "bytes", F.xxhash64(*group).alias("group"))


def _open_contexts(places: DataFrame, rows: DataFrame) -> DataFrame:
    """The first places of contexts that share an anchor with others, ``n`` of them, with their bytes."""
    firsts = places.filter("leads")
    shared = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    details = materialize(firsts.join(shared, "anchor").select("doc", "tag", "anchor", "place", "n"), "open-places")
    by_doc = details.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "place", "n")).alias("places"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                data = row.text.encode("utf-8", "surrogatepass")
                for place in row.places:
                    first = place["place"] >> _PLACE
                    count, offset = (place["place"] >> (_PLACE // 2)) & 127, place["place"] & 127
                    out.append((row.doc, row.tag, place["anchor"], first, offset, place["n"], data[first : first + count + LENGTH]))
            yield pd.DataFrame(out, columns=["doc", "tag", "anchor", "first", "offset", "n", "bytes"])

    cuts = rows.join(by_doc, ["doc", "tag"]).mapInPandas(
        cut, "doc long, tag long, anchor long, first long, offset int, n long, bytes binary"
    )
    return materialize_texts(cuts, "open-contexts")


@tidied
def _open_spans(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans of the open contexts that also start earlier: ``doc, tag, start, end``."""

    def settle(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket, out = bucket.sort_values(["doc", "tag", "first"], ignore_index=True), []
        for row, flags in zip(bucket.itertuples(index=False), _repeated_starts(list(bucket["bytes"])), strict=True):
            out += [(row.doc, row.tag, first, end) for first, end in _spans(flags, row.first)]
        return pd.DataFrame(out, columns=["doc", "tag", "start", "end"])

    contexts = _open_contexts(places, rows)
    few = contexts.filter(F.col("n") <= GROUP).select("doc", "tag", "first", "bytes", F.col("anchor").alias("group"))
    hot = contexts.filter(F.col("n") > GROUP).drop("n").withColumns({"low": F.lit(0), "high": F.lit(_BESIDE)})
    spans = []
    if not hot.limit(1).isEmpty():
        same, dealt = _deal_hot(hot)
        spans, few = [same], few.unionByName(dealt)
    # groups are settled together in buckets of about GROUP contexts
    buckets = few.count() // GROUP + 1
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets))
    found = few.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(settle, "doc long, tag long, start long, end long")
    for own in spans:
        found = found.unionByName(own)
    return materialize(found, "open-spans")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Byte spans that go (``doc, tag, start, end``), and whether tags tell rows of one id apart."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc"))
    tagged = not ids.groupBy("doc").count().filter("count > 1").limit(1).isEmpty()
    rows = _rows(docs, id_col, text_col, tagged)
    twice = _anchor_counts(rows).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    found = materialize_texts(_scan(rows).join(twice, "anchor", "left_semi"), "repeated-anchors")
    places = found.filter("not here").drop("here")
    here = found.filter("here").select("doc", "tag", F.col("place").alias("start"), F.col("context").alias("end"))
    spot = F.struct("doc", "tag", "place")
    heads = places.groupBy("anchor", "context").agg(F.min(spot).alias("head"))
    placed = materialize(
        places.join(heads, ["anchor", "context"]).select(
            "doc", "tag", "anchor", "place", (spot == F.col("head")).alias("leads")
        ),
        "placed-anchors",
    )
    start = F.shiftright("place", _PLACE)
    count = F.shiftright("place", _PLACE // 2).bitwiseAND(F.lit(127))
    followers = placed.filter("not leads").select(
        "doc", "tag", start.alias("start"), (start + count + LENGTH).alias("end")
    )
    return here.unionByName(followers).unionByName(_open_spans(placed, rows)), tagged


_CUT = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")]
    + [T.StructField(name, T.StringType()) for name in ("kept_sha256", "kept")]
)


@F.pandas_udf(_CUT)
def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """What is left of each text without its byte spans."""
    out = []
    for text, first, end in zip(texts, starts, ends, strict=True):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if first is None:
            first = end = np.zeros(0, dtype=np.int64)
        gone = _covered(np.asarray(first, dtype=np.int64), np.asarray(end, dtype=np.int64), len(data))
        kept = data[~gone].tobytes()
        out.append(
            (len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
        )
    return pd.DataFrame(out, columns=_CUT.names)


def _with_cut(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """``docs`` with the struct ``out`` of what is left of each text."""
    spans, tagged = repeated_spans(docs, id_col, text_col)
    names = [free_name(docs, name) for name in ("doc", "tag", "starts", "ends")]
    doc, tag, starts, ends = names
    by_doc = spans.groupBy(F.col("doc").alias(doc), F.col("tag").alias(tag)).agg(
        F.collect_list("start").alias(starts), F.collect_list("end").alias(ends)
    )
    number, mark = _key(id_col, text_col, tagged)
    joined = docs.withColumns({doc: number, tag: mark}).join(by_doc, [doc, tag], "left")
    return joined.withColumn(out, _cut(F.col(text_col), F.col(starts), F.col(ends))).drop(*names)


@tidied
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row.

    Removed is every byte inside a string of LENGTH bytes that also starts earlier: in a document
    with a smaller id, or before in the same one. Null texts are empty. A null id comes before all others;
    texts of one id are ordered by a hash, and rows with equal id and text count as one document, each with
    its result. ``kept`` is the rest as text: characters that lose some of their bytes go with them.
    """
    cut = _with_cut(docs.select(id_col, text_col), id_col, text_col, "cut")
    return materialize_texts(cut.select(id_col, "cut.*"), "kept")


@tidied
def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text in place of each text, same columns, as a written table.

    Documents of which nothing is left go; null and empty texts, which lose nothing, stay.
    """
    name = free_name(docs, "cut")
    cut = _with_cut(docs, id_col, text_col, name)
    kept = F.when(F.col(text_col).isNotNull(), F.col(f"{name}.kept"))
    gone = (F.col(f"{name}.n_removed") > 0) & (F.col(f"{name}.n_removed") == F.col(f"{name}.n_bytes"))
    return materialize_texts(cut.filter(~gone).withColumn(text_col, kept).select(docs.columns), "unrepeated")
