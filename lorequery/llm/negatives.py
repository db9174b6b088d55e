"""Hard negatives for contrastive training, from rotated one-bit codes.

Every vector is rotated and kept as the signs of its coordinates, its length and its alignment:
the cosine between the rotated vector and its sign vector. An anchor is quantised to a few bit planes, so that
popcounts give its product with a sign vector. What the code does not hold is a residual of known length, so
Cauchy-Schwarz puts every inner product into an interval that surely holds it. Pairs whose interval
cannot matter are dropped; the others are scored in integers. A first search gives the
positives of each anchor, a second one the negatives in the band below each positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import batches_of, materialize
from lorequery.operators.ranking import number_rows, top_k
from lorequery.session import tidied

#: Values in a packed block of vectors, and blocks that meet all anchors in one task.
BLOCK_VALUES, BLOCKS_EACH = 1 << 16, 8
#: Bits of a quantised anchor coordinate.
PLANES = 8
#: Band of negative scores, in hundredths of the positive score.
LEAST, MOST = 30, 90
#: Products below this are exact as doubles.
_EXACT = float(1 << 52)
_SEED = 20
#: Relative error of the bounds' own arithmetic, far above what doubles lose.
_SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dims, dims)))[0]


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


class Codes:
    """One-bit codes of vectors with their lengths and alignments."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, self.dims = vectors.shape
        rotated = vectors.astype(np.float64) @ rotation(self.dims)
        self.length = _lengths(vectors)
        positive = rotated >= 0
        along = np.abs(rotated).sum(axis=1) / np.sqrt(self.dims)
        self.alignment = np.clip(np.divide(along, self.length, out=np.zeros(n), where=self.length > 0), 0, 1)
        width = -(-self.dims // 64) * 64
        bits = np.zeros((n, width), dtype=np.uint8)
        bits[:, : self.dims] = positive
        self.bits = np.packbits(bits, axis=1).view(np.uint64)


class Anchors:
    """Anchors as bit planes, with what quantisation loses."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, self.dims = vectors.shape
        rotated = vectors.astype(np.float64) @ rotation(self.dims)
        self.length = _lengths(vectors)
        self.least = rotated.min(axis=1, initial=0.0)
        span = rotated.max(axis=1, initial=0.0) - self.least
        self.step = np.where(span > 0, span / ((1 << PLANES) - 1), 1.0)
        levels = np.rint((rotated - self.least[:, None]) / self.step[:, None]).astype(np.int64)
        self.total = levels.sum(axis=1)
        held = self.least[:, None] + self.step[:, None] * levels
        self.lost = _lengths(rotated - held)
        self.held_length = _lengths(held)
        width = -(-self.dims // 64) * 64
        planes = np.zeros((PLANES, n, width), dtype=np.uint8)
        for j in range(PLANES):
            planes[j, :, : self.dims] = (levels >> j) & 1
        self.planes = np.packbits(planes, axis=2).view(np.uint64).reshape(PLANES, n, -1)

    def intervals(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on the inner product of every anchor with every vector."""
        ones = np.zeros((len(self.length), len(codes.length)), dtype=np.int64)
        for plane, own in enumerate(self.planes):
            for word in range(own.shape[1]):
                ones += np.bitwise_count(codes.bits[None, :, word] & own[:, None, word]).astype(np.int64) << plane
        positive = np.bitwise_count(codes.bits).sum(axis=1, dtype=np.int64)
        # sum over signs of the held coordinates, as a product with the unit sign vector
        signed = self.step[:, None] * (2 * ones - self.total[:, None]) + np.outer(self.least, 2 * positive - self.dims)
        along = signed / np.sqrt(self.dims)
        estimate = along * codes.alignment * codes.length
        # the parts of both that are at a right angle to the sign vector, and the anchor's quantisation error
        across = np.sqrt(np.maximum(self.held_length[:, None] ** 2 - along**2, 0))
        error = across * (np.sqrt(1 - codes.alignment**2) * codes.length) + np.outer(self.lost, codes.length)
        error += _SLACK * np.sqrt(self.dims) * np.outer(self.length + 1, codes.length + 1)
        return estimate - error, estimate + error


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(anchor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; vectors are bounded so that longs hold them."""
    if np.sqrt(float((anchor.astype(np.float64) ** 2).sum())) * _lengths(vectors).max(initial=0.0) < _EXACT:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return vectors @ anchor


def _packed(rows: DataFrame, dims: int, name: str, extra: str = "") -> DataFrame:
    """Rows ``id, label, vector`` (and lists of longs ``extra``) in written blocks with consecutive numbers."""
    size = max(1, BLOCK_VALUES // dims)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for at in range(0, len(frame), size):
                own = frame.iloc[at : at + size]
                yield pd.DataFrame(
                    {
                        "ids": [own["id"].to_numpy(np.int64).tobytes()],
                        "labels": [own["label"].to_numpy(np.int64).tobytes()],
                        "vectors": [_matrix(own["vector"], dims).tobytes()],
                        "extra": [[x for xs in own[extra] for x in xs] if extra else []],
                        "held": [[len(xs) for xs in own[extra]] if extra else []],
                    }
                )

    schema = "ids binary, labels binary, vectors binary, extra array<long>, held array<int>"
    with batches_of(rows.sparkSession, size):
        return number_rows(rows.mapInPandas(pack, schema), None, name, "block")


def _ids(block: bytes) -> np.ndarray:
    return np.frombuffer(block, dtype=np.int64)


def _meet(anchors: DataFrame, blocks: DataFrame, scan, schema: str, name: str) -> DataFrame:
    """Every block of anchors next to every block of vectors.

    Blocks are dealt to parts of BLOCKS_EACH; every part gets the anchors, whose number
    is that of the queries asked, and scans them one anchor block after the other.
    """
    parts = blocks.count() // BLOCKS_EACH + 1
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("block").alias("query"),
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "vectors", "extra", "held")],
    )
    dealt = blocks.select(F.pmod("block", F.lit(parts)).alias("part"), "block", "ids", "labels", "vectors")
    pairs = asked.repartition(parts, "part", "query").join(dealt, "part").sortWithinPartitions("part", "query", "block")
    with batches_of(blocks.sparkSession, 4):
        return materialize(pairs.mapInPandas(scan, schema), name)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class _Found:
    """The best rows so far of each key of the anchors at hand."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def floor(self, key) -> float:
        """What a score must reach to count."""
        own = self.rows.get(key)
        return -np.inf if own is None or len(own[0]) < self.k else own[0][-1]

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        before = self.rows.get(key)
        if before is not None:
            scores, ids = np.concatenate((before[0], scores)), np.concatenate((before[1], ids))
        best = _best(scores, ids, self.k)
        self.rows[key] = scores[best], ids[best]

    def frame(self, names: list[str]) -> pd.DataFrame:
        """A row for each score, with the columns ``names`` of its key."""
        held = [len(scores) for scores, _ in self.rows.values()]
        keys = np.repeat(np.array(list(self.rows), dtype=np.int64).reshape(-1, len(names)), held, axis=0)
        out = pd.DataFrame(keys, columns=names)
        out["id"] = np.concatenate([ids for _, ids in self.rows.values()])
        out["score"] = np.concatenate([scores for scores, _ in self.rows.values()])
        return out


def _scanner(visit, k: int, names: list[str]):
    """A task: ``visit`` each pair of blocks; the best rows of an anchor block are handed out once it has met the part's vectors."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, at = _Found(k), None
        for frame in parts:
            for pair in frame.itertuples():
                if at != (pair.part, pair.query):
                    if found.rows:
                        yield found.frame(names)
                    found, at = _Found(k), (pair.part, pair.query)
                visit(pair, found)
        if found.rows:
            yield found.frame(names)

    return scan


def _positives(anchors: DataFrame, blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the k best other rows of an anchor's label."""

    def visit(pair, found: _Found) -> None:
        vectors, ids, labels = _ids(pair.vectors).reshape(-1, dims), _ids(pair.ids), _ids(pair.labels)
        asked, q_ids, q_labels = _ids(pair.q_vectors).reshape(-1, dims), _ids(pair.q_ids), _ids(pair.q_labels)
        _, upper = Anchors(asked).intervals(Codes(vectors))
        floors = np.array([found.floor((q,)) for q in q_ids.tolist()])
        maybe = (labels == q_labels[:, None]) & (ids != q_ids[:, None]) & (upper >= floors[:, None])
        for i in np.flatnonzero(maybe.any(axis=1)).tolist():
            at = np.flatnonzero(maybe[i])
            found.add((int(q_ids[i]),), _scores(asked[i], vectors[at]), ids[at])

    scan = _scanner(visit, k, ["anchor_id"])
    found = _meet(anchors, blocks, scan, "anchor_id long, id long, score long", "positives")
    best = top_k(found, k, "anchor_id", [F.desc("score"), F.asc("id")])
    return best.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def _negatives(anchors: DataFrame, blocks: DataFrame, dims: int, k: int, least: int, most: int) -> DataFrame:
    """``anchor_id, positive_score, id, score``: the k best rows of other labels in the band of each positive score."""

    def visit(pair, found: _Found) -> None:
        vectors, ids, labels = _ids(pair.vectors).reshape(-1, dims), _ids(pair.ids), _ids(pair.labels)
        asked, q_ids, q_labels = _ids(pair.q_vectors).reshape(-1, dims), _ids(pair.q_ids), _ids(pair.q_labels)
        bands = np.split(np.asarray(pair.q_extra, dtype=np.int64), np.cumsum(pair.q_held)[:-1])
        lower, upper = Anchors(asked).intervals(Codes(vectors))
        for i, anchor in enumerate(asked):
            keys = [(int(q_ids[i]), positive) for positive in bands[i].tolist()]
            lows = np.array([max(least * p / 100 - 1, found.floor((q, p))) for q, p in keys])
            highs = np.array([most * p / 100 + 1 for _, p in keys])
            # scored once for all bands that may hold it
            at = np.flatnonzero((labels != q_labels[i]) & (upper[i] >= lows.min()) & (lower[i] <= highs.max()))
            if not len(at):
                continue
            scores = _scores(anchor, vectors[at])
            for (q, positive), low in zip(keys, lows.tolist(), strict=True):
                # the ends of the band in integers, whatever their size
                inside = (scores >= -(-least * positive // 100)) & (scores <= most * positive // 100) & (scores >= low)
                if inside.any():
                    found.add((q, positive), scores[inside], ids[at[inside]])

    scan = _scanner(visit, k, ["anchor_id", "positive_score"])
    found = _meet(anchors, blocks, scan, "anchor_id long, positive_score long, id long, score long", "negatives")
    return top_k(found, k, ["anchor_id", "positive_score"], [F.desc("score"), F.asc("id")])


@tidied
def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` in integer inner products.

    ``vectors`` has ``id, label, vector`` (an array of longs), ``anchors`` has ``id``: those of its rows that
    are anchors. An anchor's positives are the best ``positives`` other rows of its label; each is given the
    best ``negatives`` rows of other labels whose score is from ``least`` to ``most`` hundredths of the positive's.
    Ties go to the smaller id. Rows with a null id, label or vector take no part; equal rows count once, and an
    id should not repeat with different vectors. Vectors of different lengths meet as if padded with zeros. A
    negative positive score has an empty band. Empty inputs give no rows.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select("id", F.col("label").cast("long").alias("label"), "vector").dropna().distinct()
    rows = materialize(rows, "labelled-vectors")
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = max(1, dims)
    blocks = _packed(rows, dims, "vector-blocks")
    asked = materialize(rows.join(anchors.select("id").distinct(), "id", "left_semi"), "anchors")
    found = materialize(_positives(_packed(asked, dims, "anchor-blocks"), blocks, dims, positives), "anchor-positives")
    # equal scores have one band; as many per anchor as it has positives
    bands = found.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_set("positive_score")).alias("bands")
    )
    banded = _packed(asked.join(bands, "id"), dims, "band-blocks", "bands")
    near = _negatives(banded, blocks, dims, negatives, least, most)
    ranked = found.join(near, ["anchor_id", "positive_score"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    return materialize(ranked, "hard-negatives")
