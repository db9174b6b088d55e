"""Exact search for the largest inner products of integer vectors.

Candidates are processed in blocks of descending length. A query skips every
partition and block whose longest vector cannot reach its k-th best score (Cauchy-
Schwarz). Inside a block the vectors are rotated by the right singular vectors of
all candidates, so that a sum over the first few coordinates plus the product of
the remaining lengths bounds the score; only what passes that bound is multiplied out, in
exact arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import batches_of, materialize
from lorequery.operators.ranking import top_k
from lorequery.session import tidied

#: Values in a packed block of candidates, and the share of it that a block of queries takes.
BLOCK_VALUES = 1 << 16
QUERY_SHARE = 4
#: Share of the rotated coordinates in the partial sums.
HEAD_SHARE = 4
#: Squared lengths from here on could give scores that a long cannot hold; the distance to 2^63 covers rounding.
MAX_SQUARE = float((1 << 63) - (1 << 30))
_EXACT = float(1 << 52)


def quantize(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part.

    Those are null or hold a null or non-finite component, or are so long that scores would
    not fit a long.
    """
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    square = F.aggregate(ints, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(finite & (square < MAX_SQUARE), ints)


def _matrix(vectors, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors are padded with zeros, which leaves products unchanged."""
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Exact integer products; ``limit`` bounds their absolute values and partial sums."""
    if limit < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors, by descending singular value, from one dims x dims sum per task."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for part in parts:
            rows = _matrix(part["vector"], dims).astype(np.float64)
            total += rows.T @ rows
        yield pd.DataFrame({"moments": [total.ravel()]})

    sums = (
        vectors.select("vector")
        .mapInPandas(moments, "moments array<double>")
        .select(F.posexplode("moments").alias("at", "value"))
        .groupBy("at")
        .agg(F.sum("value").alias("value"))
        .collect()  # dims squared numbers, whatever the number of vectors
    )
    square = np.zeros(dims * dims)
    for row in sums:
        square[row["at"]] = row["value"]
    _, basis = np.linalg.eigh(square.reshape(dims, dims))
    return np.ascontiguousarray(basis[:, ::-1])


def _blocks(vectors: DataFrame, dims: int, rows: int, copies: int) -> DataFrame:
    """Packed blocks of ``rows`` vectors by descending length, with the ids of each vector's copies.

    ``part`` counts the ranges of length, the longest vectors being in part 0.
    """

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = 0
        for frame in parts:
            for at in range(0, len(frame), rows):
                piece = frame.iloc[at : at + rows]
                ids = np.full((len(piece), copies), -1, dtype=np.int64)
                held = np.zeros(len(piece), dtype=np.int64)
                for i, own in enumerate(piece["ids"]):
                    ids[i, : len(own)] = own
                    held[i] = len(own)
                yield pd.DataFrame(
                    {
                        "part": piece["part"].iloc[:1].to_numpy(),
                        "seq": [first],
                        "length": [float(piece["length"].max())],
                        "ids": [ids.tobytes()],
                        "held": [held.tobytes()],
                        "vectors": [_matrix(piece["vector"], dims).tobytes()],
                    }
                )
                first += 1

    ranged = (
        vectors.repartitionByRange(F.desc("length"))
        .sortWithinPartitions(F.desc("length"))
        .withColumn("part", F.spark_partition_id())
    )
    packed = ranged.mapInPandas(
        pack, "part int, seq int, length double, ids binary, held binary, vectors binary"
    )
    return materialize(packed, "topk-blocks")


def _distinct(vectors: DataFrame, copies: int | None) -> DataFrame:
    """Distinct vectors with their ``copies`` smallest ids (all of them in the ids of queries are kept apart)."""
    rows = vectors.distinct() if copies is None else top_k(vectors.distinct(), copies, "vector", [F.asc("id")])
    length = F.sqrt(
        F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    # at most ``copies`` ids meet in a group
    return rows.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("length", length)


def _first_rows(scores: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one query, each vector standing for its copies."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
        order = keep[np.lexsort((ids[keep, 0], -scores[keep]))][:k]
    else:
        order = np.arange(len(scores))
    ids, held = ids[order], held[order]
    there = np.arange(ids.shape[1])[None, :] < held[:, None]
    flat_ids, flat_scores = ids[there], np.repeat(scores[order], held)
    best = np.lexsort((flat_ids, -flat_scores))[:k]
    return flat_ids[best], flat_scores[best]


@tidied
def largest_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates with the largest inner product per query: ``query_id, rank, vec_id, score``.

    Both inputs have ``id, vector``, the vector an array of longs. A candidate with
    the query's own id is left out; ties go to the smaller id; a query with fewer candidates gets
    all. Rows with a null id or vector take no part, equal rows count once, and ids should not repeat
    with different vectors. Vectors of different lengths meet as if padded with zeros. Empty inputs
    give no rows.
    """
    spark = candidates.sparkSession
    take = k + 1  # the query itself may be among the best
    pool = candidates.filter("id is not null and vector is not null").select("id", "vector")
    asked = queries.filter("id is not null and vector is not null").select("id", "vector").distinct()
    distinct = materialize(_distinct(pool, take), "topk-candidates")
    # queries with equal vectors are searched once
    asked = materialize(
        asked.withColumn("key", F.min("id").over(Window.partitionBy("vector"))), "topk-queries"
    )
    bounds = distinct.agg(F.max(F.size("vector")), F.max("length")).first()
    wide = asked.agg(F.max(F.size("vector"))).first()[0]
    if bounds[0] is None or wide is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, longest = max(bounds[0], wide, 1), bounds[1]
    basis = _rotation(distinct, dims)
    rows = max(1, BLOCK_VALUES // dims)
    head = max(1, dims // HEAD_SHARE)
    with batches_of(spark, 4096):
        blocks = _blocks(distinct, dims, rows, take)
        single = asked.filter("id = key").groupBy("key").agg(F.first("vector").alias("vector"))
        length = F.sqrt(
            F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        )
        query_blocks = _blocks(
            single.select("vector", F.array("key").alias("ids"), length.alias("length")),
            dims,
            max(1, rows // QUERY_SHARE),
            1,
        )
    # one packed block of the longest vectors gives every query a first floor
    seed = blocks.orderBy("part", "seq").limit(1).select("vectors").first()
    seed_vectors = np.frombuffer(seed["vectors"], dtype=np.int64).reshape(-1, dims)
    # one row per range partition
    reach = {r["part"]: r["reach"] for r in blocks.groupBy("part").agg(F.max("length").alias("reach")).collect()}

    def floors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for block in frame.itertuples():
                vectors = np.frombuffer(block.vectors, dtype=np.int64).reshape(-1, dims)
                lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
                floor = np.full(len(vectors), -np.inf)
                if len(seed_vectors) >= take:
                    scores = _products(vectors, seed_vectors, float(lengths.max()) * longest)
                    floor = np.partition(scores, -take, axis=1)[:, -take].astype(np.float64)
                slack = 1e-9 * lengths * longest + 1e-6
                needed = [p for p, far in reach.items() if (lengths * far + slack >= floor).any()]
                yield pd.DataFrame(
                    {
                        "part": needed,
                        "q_ids": [block.ids] * len(needed),
                        "q_vectors": [block.vectors] * len(needed),
                        "floor": [floor.tobytes()] * len(needed),
                    }
                )

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for pair in frame.itertuples():
                q = np.frombuffer(pair.q_vectors, dtype=np.int64).reshape(-1, dims)
                x = np.frombuffer(pair.vectors, dtype=np.int64).reshape(-1, dims)
                floor = np.frombuffer(pair.floor, dtype=np.float64)
                keys = np.frombuffer(pair.q_ids, dtype=np.int64)
                ids = np.frombuffer(pair.ids, dtype=np.int64).reshape(len(x), take)
                held = np.frombuffer(pair.held, dtype=np.int64)
                q_rotated, x_rotated = q @ basis, x @ basis
                q_length = np.sqrt((q_rotated**2).sum(axis=1))
                slack = 1e-9 * q_length * longest + 1e-6
                live = np.flatnonzero(q_length * pair.length + slack >= floor)
                if not len(live):
                    continue
                rest_q = np.sqrt((q_rotated[live, head:] ** 2).sum(axis=1))
                rest_x = np.sqrt((x_rotated[:, head:] ** 2).sum(axis=1))
                bound = q_rotated[live, :head] @ x_rotated[:, :head].T + np.outer(rest_q, rest_x)
                passing = bound + slack[live, None] >= floor[live, None]
                columns = np.flatnonzero(passing.any(axis=0))
                live = live[passing.any(axis=1)]
                if not len(live):
                    continue
                scores = _products(q[live], x[columns], float(q_length.max()) * pair.length)
                out = []
                for row, own in zip(live, scores, strict=True):
                    near = np.flatnonzero(own >= floor[row])
                    found, values = _first_rows(own[near], ids[columns[near]], held[columns[near]], take)
                    out.append(pd.DataFrame({"key": keys[row], "id": found, "score": values}))
                yield pd.concat(out)

    with batches_of(spark, 8):
        wanted = query_blocks.select("ids", "vectors").mapInPandas(
            floors, "part int, q_ids binary, q_vectors binary, floor binary"
        )
        pairs = wanted.join(blocks, "part")
        found = materialize(pairs.mapInPandas(meet, "key long, id long, score long"), "topk-found")
    best = top_k(found, take, "key", [F.desc("score"), F.asc("id")], "place").select("key", "id", "score")
    named = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").filter("query_id != id")
    ranked = top_k(named, k, "query_id", [F.desc("score"), F.asc("id")])
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
