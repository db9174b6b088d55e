"""Join of documents by the Jaccard similarity of their word n-grams, with signature trees.

Documents with equal n-gram sets are one set. Two sets that link share an n-gram among the
first quarter of each in the order of hashes, so every such n-gram that two sets share
gives a list of sets that are compared with each other. A list is indexed by a
signature tree: nodes hold the union and the intersection of their sets' token bitmaps
and the range of their sizes, and a traversal of node pairs drops those whose largest possible overlap is too
small. What survives falls into candidate clusters, to which the n-grams of each set are
sent once; the same tree and exact intersections then decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import free_name, materialize, materialize_texts, running_total
from lorequery.llm.hashing import hash_ranges, mix
from lorequery.session import tidied

WORDS = 5
#: Linked from an intersection of NEAR / OUT_OF of the union.
NEAR, OUT_OF = 75, 100
#: Sets in one tree; longer lists and larger clusters are compared in blocks of this size.
BLOCK = 1500
#: Sets in a leaf, and children of a node.
LEAF, FANOUT = 16, 8
#: N-grams in the prefixes of more documents come last in the order, so many of them at most (they are broadcast).
HOT, HOT_GRAMS = 1000, 100_000
#: Members of lists that are handed to a worker together, about.
TOGETHER = 4000
#: Bits of a bitmap per n-gram, at least.
_BITS_EACH = 2
_PAIRS = 1 << 15

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text; the whole sequence where it is shorter."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    words = mix(hash_ranges(_LOWER[data] + np.uint64(1), 0, first, last) + (last - first).astype(np.uint64))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(out)


def set_key(grams: np.ndarray) -> int:
    """A 64-bit fingerprint of a set; with the set's size it stands for the set."""
    both = np.array([grams.sum(dtype=np.uint64), np.bitwise_xor.reduce(grams)]) if len(grams) else np.zeros(2, np.uint64)
    return int(mix(both * np.array([3, 5], dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def prefix_size(n: int) -> int:
    """So many first n-grams: sets that link share one of them."""
    return n - -(-NEAR * n // OUT_OF) + 1 if n else 0


def bitmap_width(n: int) -> int:
    return max(64, 1 << (max(1, _BITS_EACH * n) - 1).bit_length())


def bitmap(grams: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, dtype=np.uint8)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def _fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of the given width from wider ones: a bit stands for all bits that are equal to it modulo the width."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, width // 64), axis=1)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection at which sets of these sizes link."""
    return -(-NEAR * (a + b) // (NEAR + OUT_OF))


class SignatureTree:
    """Sets of one bitmap width in nodes that know what their sets hold at most and at least."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((maps[:, 0], sizes))
        self.maps, self.sizes = maps[self.order], sizes[self.order]
        # per level: unions, intersections, smallest and largest size; the sets themselves are level 0
        self.levels = [(self.maps, self.maps, self.sizes, self.sizes)]
        self.fans: list[int] = []
        while len(self.levels[-1][0]) > 1:
            fan = FANOUT if self.fans else LEAF
            union, common, least, most = self.levels[-1]
            cuts = np.arange(0, len(union), fan)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(union, cuts),
                    np.bitwise_and.reduceat(common, cuts),
                    np.minimum.reduceat(least, cuts),
                    np.maximum.reduceat(most, cuts),
                )
            )
            self.fans.append(fan)

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Node pairs that may hold a link: bits that one side surely has and the other cannot have are missed."""
        union, common, least, most = self.levels[level]
        fits = (OUT_OF * most[a] >= NEAR * least[b]) & (OUT_OF * most[b] >= NEAR * least[a])
        at = np.flatnonzero(fits)
        for start in range(0, len(at), _PAIRS):
            own = at[start : start + _PAIRS]
            x, y = a[own], b[own]
            missed_x = np.bitwise_count(common[x] & ~union[y]).sum(axis=1, dtype=np.int64)
            missed_y = np.bitwise_count(common[y] & ~union[x]).sum(axis=1, dtype=np.int64)
            overlap = np.minimum(most[x] - missed_x, most[y] - missed_y)
            fits[own] = overlap >= _needed(least[x], least[y])
        return fits

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the bounds leave, in batches, as positions in the input."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            fan, below = self.fans[level - 1], len(self.levels[level - 1][0])
            step = max(1, _PAIRS // fan**2)
            for start in range(0, len(a), step):
                x, y = a[start : start + step], b[start : start + step]
                left = (x[:, None] * fan + np.arange(fan)).repeat(fan, axis=1).ravel()
                right = np.tile(y[:, None] * fan + np.arange(fan), (1, fan)).ravel()
                ok = (left < below) & (right < below) & (left < right if level == 1 else left <= right)
                left, right = left[ok], right[ok]
                fits = self._possible(level - 1, left, right)
                if fits.any():
                    stack.append((level - 1, left[fits], right[fits]))


def candidate_pairs(maps: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may link. Sets that may link have equal widths, or one twice the other: then it is folded."""
    widths = np.array([len(m) * 64 for m in maps])
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) < 2:
            continue
        folded = np.concatenate([_fold(maps[i][None, :], width) for i in at])
        for a, b in SignatureTree(folded, sizes[at]).pairs():
            here = (widths[at[a]] == width) | (widths[at[b]] == width)
            yield at[a[here]], at[b[here]]


class _Union:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def _few(maps: list[np.ndarray], sizes: np.ndarray, union: _Union) -> None:
    """The bounds for the pairs of a single leaf."""
    n = sizes.tolist()
    for i in range(len(n)):
        for j in range(i):
            if OUT_OF * n[i] < NEAR * n[j] or OUT_OF * n[j] < NEAR * n[i] or union.root(i) == union.root(j):
                continue
            a, b = maps[i], maps[j]
            if len(a) != len(b):
                width = 64 * min(len(a), len(b))
                a, b = _fold(a[None, :], width)[0], _fold(b[None, :], width)[0]
            only_a, only_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
            if (NEAR + OUT_OF) * min(n[i] - only_a, n[j] - only_b) >= NEAR * (n[i] + n[j]):
                union.join(i, j)


def candidate_clusters(maps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The smallest member of each set's cluster, where surviving pairs connect."""
    union = _Union(len(maps))
    if len(maps) <= LEAF:
        _few(maps, sizes, union)
        return union.roots()
    for a, b in candidate_pairs(maps, sizes):
        roots = union.roots()
        apart = roots[a] != roots[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            union.join(x, y)
    return union.roots()


def linked_clusters(sets: list[np.ndarray]) -> np.ndarray:
    """Connected sets by exact intersections; pairs that are connected already are not compared."""
    sizes = np.array([len(s) for s in sets])
    union = _Union(len(sets))
    for a, b in candidate_pairs([bitmap(s, bitmap_width(len(s))) for s in sets], sizes):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if union.root(x) != union.root(y):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if OUT_OF * common >= NEAR * (len(sets[x]) + len(sets[y]) - common):
                    union.join(x, y)
    return union.roots()


@tidied
def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root``: the smallest node that each node of the edges ``a, b`` is connected to.

    Every round hooks each node and its root to the smallest neighbouring root and then
    shortens paths; all tables are narrow and written, and the rounds grow with the logarithm
    of the longest path.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name
    )
    roots = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        seen = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("best"))
        hooked = seen.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("up"))
        lowered = seen.join(hooked.withColumnRenamed("node", "root"), "root").select(
            "node", "root", F.least("best", "up").alias("low")
        )
        jump = lowered.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = materialize(
            lowered.join(jump, "low", "left").select(
                "node",
                F.least("low", F.coalesce("lower", "low")).alias("root"),
                (F.col("root") != F.least("low", F.coalesce("lower", "low"))).alias("moved"),
            ),
            name,
        )
        roots = after.select("node", "root")
        if after.filter("moved").limit(1).isEmpty():
            return roots


def _in(hot: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which n-grams are among the sorted ``hot`` ones."""
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def _scan(rows: DataFrame) -> DataFrame:
    """``id, digest, n, key, bits, grams`` per document: its set's size, key, bitmap and prefix n-grams by hash."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                grams = shingles(text)
                n = len(grams)
                key, bits = set_key(grams), bitmap(grams, bitmap_width(n)).tobytes()
                out.append((n, key, bits, grams[: prefix_size(n)].view(np.int64)))
            frame = pd.DataFrame(out, columns=["n", "key", "bits", "grams"])
            yield pd.concat([part[["id", "digest"]].reset_index(drop=True), frame], axis=1)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(scan, f"id {kind}, digest long, n long, key long, bits binary, grams array<long>")


def _without_hot(scanned: DataFrame, rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """``key, grams``: prefixes in the order that has the ``hot`` n-grams last.

    A prefix without hot n-grams stays the same in that order; only the others are made and written anew.
    """

    @F.pandas_udf("boolean")
    def stays(grams: pd.Series) -> pd.Series:
        return pd.Series([not _in(hot, own.view(np.uint64)).any() for own in grams])

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                grams = shingles(text)
                last = _in(hot, grams)
                size = prefix_size(len(grams))
                if last[:size].any():
                    moved = np.concatenate((grams[~last], grams[last]))[:size]
                    out.append((set_key(grams), moved.view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "grams"])

    moved = materialize_texts(rows.select("text").mapInPandas(scan, "key long, grams array<long>"), "prefixes")
    return scanned.select("key", "grams").filter(stays("grams")).unionByName(moved)


def _routes(scanned: DataFrame) -> DataFrame:
    """``gram, key`` of the prefix n-grams."""
    return scanned.select(F.explode("grams").alias("gram"), "key")


def _frequent(scanned: DataFrame) -> np.ndarray:
    """Sorted n-grams that stand in the prefixes of more than HOT documents, the HOT_GRAMS most frequent at most.

    Which n-grams come last in the order is a matter of speed only: any order is right.
    """
    counts = _routes(scanned).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    top = counts.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in top], dtype=np.int64).view(np.uint64))


@tidied
def _lists(scanned: DataFrame) -> DataFrame:
    """``list, key, members``: the sets that share a prefix n-gram; n-grams with equal lists count once."""
    shared = _routes(scanned).groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = shared.filter("low != high").select("gram")
    routes = materialize(_routes(scanned).join(shared, "gram", "left_semi").distinct(), "routes")
    marks = routes.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    kept = marks.groupBy("n", "x", "y").agg(F.min("gram").alias("gram")).select("gram", F.col("n").alias("members"))
    return materialize(routes.join(kept, "gram").select(F.col("gram").alias("list"), "key", "members"), "lists")


def _blocks(frame: DataFrame, group: str, total: str, name: str) -> DataFrame:
    """Rows of each group with the tasks that compare them: ``task`` holds every pair of blocks of BLOCK rows once.

    Blocks are by size, so that similar sizes come together; block pairs of sizes too far apart are not made.
    """
    number = free_name(frame, "number")
    small = frame.filter(F.col(total) <= BLOCK).withColumn("task", F.lit(0).cast("long"))
    large = frame.filter(F.col(total) > BLOCK)
    if large.limit(1).isEmpty():
        return small
    placed = running_total(large, [group], ["n", "key"], F.lit(1), number, name)
    placed = placed.withColumn("block", F.floor(F.col(number) / BLOCK).cast("long"))
    reach = placed.groupBy(group, "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    ahead = reach.select(group, F.col("block").alias("other"), F.col("least").alias("from"))
    pairs = reach.join(ahead, group).filter((F.col("other") >= F.col("block")) & (OUT_OF * F.col("most") >= NEAR * F.col("from")))
    task = F.col("block") * (1 << 31) + F.col("other") + 1
    sides = pairs.select(group, task.alias("task"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return small.unionByName(placed.join(sides, [group, "block"]).select(small.columns))


@tidied
def _candidates(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges ``a, b`` from each set to the smallest set of its candidate cluster in a list."""
    members = lists.join(sets.select("key", "n", "bits"), "key")
    tasks = _blocks(members, "list", "members", "list-blocks")

    # short lists go to a worker together; each block pair of a long one goes alone
    groups = lists.count() // TOGETHER + 1
    bucket = F.when(F.col("task") == 0, F.pmod(F.xxhash64("list"), F.lit(groups))).otherwise(F.col("list"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["list", "key"], ignore_index=True)
        maps = [np.frombuffer(b, dtype=np.uint64) for b in group["bits"]]
        sizes, keys, lists = (group[c].to_numpy() for c in ("n", "key", "list"))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]))
        first, second = [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            roots = candidate_clusters(maps[start:end], sizes[start:end])
            moved = np.flatnonzero(roots != np.arange(end - start))
            first.append(keys[start + roots[moved]])
            second.append(keys[start + moved])
        return pd.DataFrame({"a": np.concatenate(first), "b": np.concatenate(second)}).drop_duplicates()

    dealt = tasks.select(bucket.alias("bucket"), "task", "list", "key", "n", "bits")
    return materialize(dealt.groupBy("bucket", "task").applyInPandas(compare, "a long, b long").distinct(), "candidates")


@tidied
def _exact(clusters: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect linked sets, from candidate clusters ``key, root``."""
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    wanted = clusters.join(sizes, "root").join(reps, "key")

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [shingles(text) for text in part["text"]]
            own = np.array([set_key(grams) for grams in found], dtype=np.int64) == part["key"].to_numpy()
            part = part[["key", "root", "members"]].assign(
                n=[len(grams) for grams in found], grams=[grams.tobytes() for grams in found]
            )
            yield part[own]

    texts = rows.select(F.col("id").alias("rep"), F.col("digest").alias("rep_digest"), "text")
    same = F.col("rep").eqNullSafe(F.col("least.id")) & (F.col("rep_digest") == F.col("least.digest"))
    loaded = texts.join(wanted, same).select("key", "root", "members", "text").mapInPandas(
        load, "key long, root long, members long, n long, grams binary"
    )
    loaded = materialize_texts(loaded.dropDuplicates(["key"]), "grams")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        roots = linked_clusters([np.frombuffer(g, dtype=np.uint64) for g in group["grams"]])
        keys = group["key"].to_numpy()
        moved = roots != np.arange(len(roots))
        return pd.DataFrame({"a": keys[roots[moved]], "b": keys[moved]})

    tasks = _blocks(loaded, "root", "members", "cluster-blocks")
    return materialize(tasks.groupBy("root", "task").applyInPandas(decide, "a long, b long").distinct(), "links")


@tidied
def _clusters(scanned: DataFrame, sets: DataFrame) -> DataFrame:
    found = components(_candidates(_lists(scanned), sets), "clusters")
    return materialize(found.select(F.col("node").alias("key"), "root"), "clusters")


@tidied
def _links(scanned: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect linked sets."""
    return _exact(_clusters(scanned, sets), sets.select("key", "least"), rows)


@tidied
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, n_shingles, component_id, stays`` per row of ``docs``.

    ``component_id`` is the smallest id that a chain of links reaches. Null, empty and wordless texts
    have no n-grams and link with nothing. Null ids do not count as smallest: a component of null
    ids only has a null ``component_id``. ``stays`` marks one document of each component, and every document
    without n-grams; rows with equal id and text are marked alike. ``digest`` is a hash of the text.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.col(text_col).alias("text"),
    )
    scanned = materialize_texts(_scan(rows), "sets")
    base = scanned.drop("grams")
    hot = _frequent(scanned)
    if len(hot):
        scanned = _without_hot(scanned, rows, hot)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    sets = materialize(
        base.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(place).alias("least")),
        "distinct-sets",
    )
    linked = components(_links(scanned, sets, rows), "linked").select(F.col("node").alias("key"), "root")
    rooted = materialize(
        base.drop("bits").join(linked, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted"
    )
    full = rooted.filter("n > 0")
    first = full.groupBy("root").agg(F.min(place).alias("least"))
    joined = full.join(first, "root").select(
        "id", "digest", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (place == F.col("least")).alias("stays")
    )
    alone = rooted.filter("n = 0").select(
        "id", "digest", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("stays")
    )
    return joined.unionByName(alone).withColumnRenamed("id", id_col)


@tidied
def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component and all without n-grams, with the columns of ``docs``, as a written table.

    Of rows with equal id and text that have n-grams one stays; equal rows without n-grams all stay. Empty
    tables give no rows.
    """
    marked = materialize(near_duplicates(docs, id_col, text_col), "near-duplicates")
    own_id, own_digest, grams = (free_name(docs, name) for name in ("kept_id", "kept_digest", "kept_grams"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    staying = marked.filter("stays").select(
        F.col(id_col).alias(own_id), F.col("digest").alias(own_digest), F.col("n_shingles").alias(grams)
    )
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_digest))
    kept = docs.join(staying.distinct(), same)
    full = staying.filter(F.col(grams) > 0)
    if full.count() != full.distinct().count():
        # rows with equal id and text: one stays, unless they have no n-grams
        again = kept.filter(F.col(grams) > 0).dropDuplicates([id_col, text_col])
        kept = again.unionByName(kept.filter(F.col(grams) == 0))
    return materialize(kept.select(docs.columns), "deduplicated")
