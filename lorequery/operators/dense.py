"""Nearest neighbours by squared Euclidean distance, exact and approximate.

Equal vectors are searched once. The distinct ones are grouped into cells
around pivot vectors. A question first visits its nearest cells; the distance
of its k-th neighbour there, with the triangle inequality, rules out most other
cells when the data has clusters, and the rest is visited in a second round. A
cell meets its questions in blocks of bounded size on both sides, and each
meeting returns k rows per question, never all pairs. Where many questions visit many
small cells, cells that lie together are visited as one. The cells of an index are
folders: a round reads the cells that some question visits and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from lorequery.operators.ranking import top_k
from lorequery.session import delete_tables, joined, materialize
from lorequery.sources.tables import require_columns
from lorequery.sources.versions import commit, new_segment, read_version, segment_tables, united

CELL_ROWS = 4096
MAX_CELLS = 4096
BLOCK_ROWS = 16384
CHUNK_ROWS = 16384
# questions compared at once with a block, and distances to pivots worked out at once: bounds the matrix of distances
SLICE_ROWS = 128
PIVOT_DISTANCES = 1_000_000
# visits that Spark may send to all workers
SENT_VISITS = 100_000
# Distances are ranked in units of the sixth decimal.
_UNITS = 1e6
_MARGIN = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # doc_pos, embedding, segment
    points: DataFrame  # vec_id (lowest position of equal vectors of a segment), embedding, n_copies, cell, radius, segment
    cells: DataFrame  # cell, pivot, size, near, far
    n_vectors: int
    n_points: int
    n_cells: int
    version: int
    groups: tuple[tuple[int, int], ...] | None = None  # (cell, group) where a search visits cells together


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks)
    return arrays.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(arrays), -1)


def _slack(left: np.ndarray, right: np.ndarray, scale: float) -> float:
    """Room for rounding to six decimals and for the error of ``_squared``, which grows with the vectors."""
    return _MARGIN + scale * max((left**2).sum(1).max(initial=0.0), (right**2).sum(1).max(initial=0.0))


def _squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    away = -2.0 * left @ right.T
    away += (left**2).sum(1)[:, None]
    away += (right**2).sum(1)[None, :]
    return np.maximum(away, 0.0, out=away)


def _slices(batches: Iterator[pa.RecordBatch], n_pivots: int) -> Iterator[pa.Table]:
    """The batches in slices that have at most PIVOT_DISTANCES distances to the pivots."""
    rows = max(1, PIVOT_DISTANCES // max(1, n_pivots))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(i, rows)])


def _assign(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, len(pivots)):
            vectors = _matrix(table["embedding"])
            cell = _squared(vectors, pivots).argmin(1)
            radius = np.sqrt(((vectors - pivots[cell]) ** 2).sum(1))
            table = table.append_column("cell", pa.array(cell, pa.int32()))
            yield from table.append_column("radius", pa.array(radius, pa.float64())).to_batches()

    return run


def build_vector_index(
    vectors: DataFrame,
    path: str,
    id_col: str = "doc_pos",
    overwrite: bool = False,
    cell_rows: int = CELL_ROWS,
) -> VectorIndex:
    """Write the search tables under ``path`` unless they are there, and open them.

    An index that is there keeps the cells it was built with, whatever ``cell_rows``. With
    ``overwrite`` the new tables are written beside the old ones.
    """
    require_columns(vectors, id_col, "embedding")
    spark = vectors.sparkSession
    held = read_version(spark, path)
    if held is None or overwrite:
        folder = new_segment()
        distinct_t = _write_vectors(vectors, f"{path}/{folder}", id_col)
        n_cells = min(MAX_CELLS, max(1, -(-distinct_t.count() // cell_rows)))
        # at most MAX_CELLS vectors, picked by a hash of their id
        chosen = distinct_t.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_cells).select("embedding").collect()
        rows = [(i, [float(x) for x in row["embedding"]]) for i, row in enumerate(chosen)]
        spark.createDataFrame(rows, "cell int, pivot array<double>").write.parquet(f"{path}/{folder}/pivots")
        segment = _write_points(distinct_t, path, folder, n_cells, f"{folder}/pivots", by_cell=True)
        content = {"n_cells": n_cells, "cell_rows": cell_rows, "pivots": f"{folder}/pivots", "segments": [segment]}
        commit(spark, path, content, held["version"] if held else 0)
    return open_vector_index(spark, path)


def add_vectors(vectors: DataFrame, path: str, id_col: str = "doc_pos") -> VectorIndex:
    """Add the vectors with new ids as a segment, in the cells that are there; no old file changes."""
    require_columns(vectors, id_col, "embedding")
    spark = vectors.sparkSession
    held = read_version(spark, path)
    known = open_vector_index(spark, path, held["version"]).vectors.select(F.col("doc_pos").alias(id_col))
    folder = new_segment()
    distinct_t = _write_vectors(joined(vectors, known, id_col, "left_anti"), f"{path}/{folder}", id_col)
    segment = _write_points(distinct_t, path, folder, held["n_cells"], held["pivots"], by_cell=False)
    if segment["n_points"]:
        commit(spark, path, {**held, "segments": [*held["segments"], segment]}, held["version"])
    return open_vector_index(spark, path)


def _write_vectors(vectors: DataFrame, folder: str, id_col: str) -> DataFrame:
    """Write the vectors of a segment, once per id, and the distinct ones among them."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("doc_pos"), "embedding").filter("embedding is not null")
    kept.write.parquet(f"{folder}/vectors")
    distinct = (
        spark.read.parquet(f"{folder}/vectors")
        .groupBy("embedding")
        .agg(F.min("doc_pos").alias("vec_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    distinct.write.parquet(f"{folder}/distinct")
    return spark.read.parquet(f"{folder}/distinct")


def _write_points(distinct_t: DataFrame, path: str, folder: str, n_cells: int, pivots: str, by_cell: bool) -> dict:
    """Assign the distinct vectors of a segment to their cells; the segment's entry.

    The cells of the first segment are folders. An addition is small beside it: its files are
    sorted by cell, so that parts of them are skipped.
    """
    spark = distinct_t.sparkSession
    if n_cells == 1:
        points = distinct_t.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)})
    else:
        # at most MAX_CELLS rows
        centres = np.array([row["pivot"] for row in spark.read.parquet(f"{path}/{pivots}").orderBy("cell").collect()])
        schema = StructType([*distinct_t.schema.fields]).add("cell", "integer").add("radius", "double")
        points = distinct_t.mapInArrow(_assign(centres), schema)
    if n_cells > 1:
        # balances the files of a cell by size, so that a large one fills several
        points = points.hint("rebalance", "cell") if by_cell else points
        points = points.sortWithinPartitions("cell")
    if n_cells > 1 and by_cell:
        points.write.partitionBy("cell").parquet(f"{path}/{folder}/points")
    else:
        points.write.parquet(f"{path}/{folder}/points")
    delete_tables(spark, [f"{path}/{folder}/distinct"])
    points_t = spark.read.parquet(f"{path}/{folder}/points")
    points_t.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.min("radius").alias("near"), F.max("radius").alias("far")
    ).write.parquet(f"{path}/{folder}/cells")
    n_points, n_vectors = points_t.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_copies"), F.lit(0))).first()
    return {"folder": folder, "n_points": n_points, "n_vectors": n_vectors}


def open_vector_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """Open the newest version or the given one, as it was built."""
    held = read_version(spark, path, version)
    segments = held["segments"]

    def tables(name: str) -> DataFrame:
        frames = segment_tables(spark, path, segments, name)
        return united([frame.withColumn("segment", F.lit(i)) for i, frame in enumerate(frames)])

    cells = tables("cells").drop("segment")
    if len(segments) > 1:
        cells = cells.groupBy("cell").agg(F.sum("size").alias("size"), F.min("near").alias("near"), F.max("far").alias("far"))
    return VectorIndex(
        vectors=tables("vectors"),
        points=tables("points"),
        cells=cells.join(spark.read.parquet(f"{path}/{held['pivots']}"), "cell", "left"),
        n_vectors=sum(s["n_vectors"] for s in segments),
        n_points=sum(s["n_points"] for s in segments),
        n_cells=held["n_cells"],
        version=held["version"],
    )


@dataclass(frozen=True)
class _Map:
    """The cells as arrays: at most MAX_CELLS entries."""

    ids: np.ndarray
    pivots: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between pivots, worked out once per task."""
        return np.sqrt(_squared(self.pivots, self.pivots))

    def first(self, away: np.ndarray, k: int, n_probe: int) -> np.ndarray:
        """Mask of each question's nearest cells: ``n_probe`` of them, more until they hold k vectors."""
        # a cell holds a vector at least, so that no more than these are wanted
        n = min(len(self.ids), max(k, n_probe))
        order = away.argsort(axis=1, kind="stable")[:, :n] if n > 32 else self._lowest(away, n)
        held = self.size[order].cumsum(1)
        held_before = held - self.size[order]
        wanted = (held_before < k) | (np.arange(n) < n_probe)
        mask = np.zeros(away.shape, bool)
        np.put_along_axis(mask, order, wanted, 1)
        return mask

    def _lowest(self, away: np.ndarray, n: int) -> np.ndarray:
        """The columns of the ``n`` lowest values, in order; ties take the first."""
        left, columns = away.copy(), []
        for _ in range(n):
            columns.append(left.argmin(1))
            left[np.arange(len(left)), columns[-1]] = np.inf
        return np.stack(columns, axis=1)

    def groups(self, rows: int) -> np.ndarray:
        """Cells that lie together, about ``rows`` vectors in each group; a group has the number of one of its cells."""
        n = min(len(self.ids), max(1, -(-int(self.size.sum()) // rows)))
        away = _squared(self.pivots, self.pivots[:n])
        order = np.lexsort((away.min(1), away.argmin(1)))
        place = (self.size[order].cumsum() - self.size[order]) // rows
        _, first, number = np.unique(place, return_index=True, return_inverse=True)
        out = np.empty(len(order), dtype=self.ids.dtype)
        out[order] = self.ids[order[first]][number]
        return out

    def reachable(self, away: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Mask of the cells that can hold a vector within ``limit`` of the question."""
        least = np.maximum(away - self.far, self.near - away)
        # a member of a cell is nearer to its own pivot than to the question's nearest one
        home = away.argmin(1)
        between = self.apart[home]
        gap = away**2 - (away[np.arange(len(away)), home] ** 2)[:, None]
        split = np.where(between > 1e-3, gap / np.maximum(2.0 * between, 1e-3), 0.0)
        return np.maximum(least, split) <= limit[:, None]


def _cell_map(index: VectorIndex) -> _Map:
    rows = sorted(index.cells.collect(), key=lambda r: r["cell"])
    return _Map(
        ids=np.array([r["cell"] for r in rows], dtype="int32"),
        pivots=np.array([r["pivot"] for r in rows], dtype="float64"),
        size=np.array([r["size"] for r in rows], dtype="int64"),
        near=np.array([r["near"] for r in rows], dtype="float64"),
        far=np.array([r["far"] for r in rows], dtype="float64"),
    )


def _visits(cell_map: _Map, groups: np.ndarray, k: int, n_probe: int, second_round: bool):
    """Groups of cells each question visits: the first round's, or those it still has to see."""
    names, member = np.unique(groups, return_inverse=True)
    by_group = member.argsort(kind="stable")
    begins = np.flatnonzero(np.diff(member[by_group], prepend=-1))

    def grouped(mask: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(mask[:, by_group], begins, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, len(cell_map.ids)):
            asked = _matrix(table["embedding"])
            away = np.sqrt(_squared(asked, cell_map.pivots))
            mask = grouped(cell_map.first(away, k, n_probe))
            if second_round:
                slack = _slack(asked, cell_map.pivots, 1e-12)
                limit = np.sqrt(table["limit"].to_numpy() + slack) + 2 * np.sqrt(slack)
                mask = grouped(cell_map.reachable(away, limit)) & ~mask
            row, cell = mask.nonzero()
            out = {"ask": table["ask"].take(pa.array(row)), "cell": pa.array(names[cell], pa.int32())}
            yield from pa.table(out).to_batches()

    return run


def _nearest(k: int, ask_type: pa.DataType):
    """The k nearest vectors of one block for each question of one chunk; none beyond its ``limit``, if it has one."""
    schema = pa.schema([("ask", ask_type), ("vec_id", pa.int64()), ("units", pa.int64())])

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not block.num_rows or not chunk.num_rows:
            return schema.empty_table()
        ids = block["vec_id"].to_numpy()
        vectors, asked = _matrix(block["embedding"]), _matrix(chunk["embedding"])
        n = min(k, len(ids))
        slack = _slack(asked, vectors, 1e-12)
        known = chunk["limit"].to_numpy() if "limit" in chunk.column_names else None
        picked, units, found = [], [], []
        for start in range(0, len(asked), SLICE_ROWS):
            part = asked[start : start + SLICE_ROWS]
            away = _squared(part, vectors)
            if known is None:
                limit = np.partition(away, n - 1, axis=1)[:, n - 1] + slack
            else:
                limit = known[start : start + SLICE_ROWS] + slack
            within = away <= limit[:, None]
            for i in np.flatnonzero(within.any(1)):
                near = np.flatnonzero(within[i])
                exact = ((vectors[near] - part[i]) ** 2).sum(1)
                rounded = np.floor(exact * _UNITS + 0.5).astype("int64")
                best = np.lexsort((ids[near], rounded))[:n]
                picked.append(ids[near[best]])
                units.append(rounded[best])
                found.append((start + i, len(best)))
        if not found:
            return schema.empty_table()
        rows = np.repeat(*np.array(found).T)
        out = [
            chunk["ask"].take(pa.array(rows)),
            pa.array(np.concatenate(picked), pa.int64()),
            pa.array(np.concatenate(units), pa.int64()),
        ]
        return pa.table(out, schema=schema)

    return run


def _meet(index: VectorIndex, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Top k per question within each visited block: ``ask, vec_id, units``."""
    spark = index.points.sparkSession
    cores = spark.sparkContext.defaultParallelism
    per_group = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n_asked"))
    visited = {r["cell"]: r["n_asked"] for r in per_group.collect()}  # at most MAX_CELLS rows
    group_of = dict(index.groups) if index.groups else {}
    cells = {r["cell"]: (group_of.get(r["cell"], r["cell"]), r["size"]) for r in index.cells.select("cell", "size").collect()}
    sizes = dict.fromkeys(visited, 0)
    for group, size in cells.values():
        if group in visited:
            sizes[group] += size
    points = index.points.select("cell", "vec_id", "embedding")
    if len(visited) < len({group for group, _ in cells.values()}):
        points = points.filter(F.col("cell").isin(sorted(cell for cell, (group, _) in cells.items() if group in visited)))
    # small question sets are cut finer, so that every core has a share
    total = sum(visited.values())
    rows = max(64, min(CHUNK_ROWS, -(-total // cores)))
    shares = [(group, -(-sizes[group] // BLOCK_ROWS), -(-n // rows)) for group, n in visited.items() if sizes[group]]
    # at most MAX_CELLS rows
    layout = F.broadcast(spark.createDataFrame(shares, "cell int, n_blocks int, n_chunks int"))
    members = F.broadcast(
        spark.createDataFrame(
            [(c, g, -(-sizes[g] // BLOCK_ROWS), -(-visited[g] // rows)) for c, (g, _) in cells.items() if g in visited],
            "cell int, of int, n_blocks int, n_chunks int",
        )
    )
    blocks = (
        points.join(members, "cell")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), "n_blocks").cast("int"))
        .withColumn("chunk", F.explode(F.expr("sequence(0, n_chunks - 1)")))
        .select(F.col("of").alias("cell"), "block", "chunk", "vec_id", "embedding")
    )
    limit = [c for c in asked.columns if c == "limit"]
    # regular pairs of numbers: next to nothing on disk, however many
    by_ask = visits.hint("merge").join(asked, "ask") if total > SENT_VISITS else joined(visits, asked, "ask")
    chunks = (
        by_ask.join(layout, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("ask"), "n_chunks").cast("int"))
        .withColumn("block", F.explode(F.expr("sequence(0, n_blocks - 1)")))
        .select("cell", "block", "chunk", "ask", "embedding", *limit)
    )
    keys = ["cell", "block", "chunk"]
    ask_field = StructField("ask", asked.schema["ask"].dataType)
    schema = StructType([ask_field, StructField("vec_id", LongType()), StructField("units", LongType())])
    kernel = _nearest(k, to_arrow_type(ask_field.dataType))
    return blocks.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(kernel, schema)


def _with_copies(index: VectorIndex, best: DataFrame, k: int) -> DataFrame:
    """From distinct vectors to positions: the k lowest positions of each vector."""
    if index.n_points == index.n_vectors:
        return best.withColumnRenamed("vec_id", "doc_pos")
    # copies are told apart by segment: a vector of two segments has a point in each
    keys = ["segment", "shared"]
    repeated = index.points.filter("n_copies > 1").select("vec_id", "segment", F.col("embedding").alias("shared"))
    named = joined(best, repeated, "vec_id", "left")
    single = named.filter("shared is null").select("ask", F.col("vec_id").alias("doc_pos"), "units")
    many = named.filter("shared is not null").select("ask", *keys, "units")
    placed = index.vectors.select("segment", F.col("embedding").alias("shared"), "doc_pos")
    copies = joined(placed, many.select(*keys).distinct(), keys, "left_semi")
    copies = top_k(copies, k, keys, [F.asc("doc_pos")]).drop("rank")
    return single.unionByName(joined(many, copies, keys).select("ask", "doc_pos", "units"))


def dense_search(
    index: VectorIndex,
    questions: DataFrame,
    k: int = 3,
    id_col: str = "query_id",
    n_probe: int | None = None,
) -> DataFrame:
    """The k nearest vectors per question: ``id_col, rank, doc_pos, score``.

    ``questions`` holds the question vectors in ``embedding``. The score is the
    squared distance, lowest first, then lowest position. With ``n_probe`` only
    that many nearest cells are visited: an approximate search.
    """
    # written first: an embedder must not run again for every use
    embedded = materialize(questions.select(F.col(id_col).alias("query_id"), "embedding"), "embedded")
    asked_all = embedded.filter("embedding is not null")
    asked = materialize(
        asked_all.groupBy("embedding").agg(F.min("query_id").alias("ask")).select("ask", "embedding"), "asked"
    )
    order = [F.asc("units"), F.asc("vec_id")]
    if index.n_cells == 1:
        visits = asked.select("ask", F.lit(0).alias("cell"))
        best = top_k(_meet(index, asked, visits, k), k, "ask", order).drop("rank")
    else:
        cell_map = _cell_map(index)
        # an exact search may visit more than it must: taking a question along costs as much as a few vectors
        together = min(BLOCK_ROWS * 3 // 4, asked.count()) if n_probe is None else 1
        groups = cell_map.groups(max(1, together)) if together > 1 else cell_map.ids
        index = replace(index, groups=tuple(zip(cell_map.ids.tolist(), groups.tolist(), strict=True)))
        schema = StructType([asked.schema["ask"]]).add("cell", "integer")
        first = materialize(asked.mapInArrow(_visits(cell_map, groups, k, n_probe or 1, False), schema), "visits")
        best = top_k(_meet(index, asked, first, k), k, "ask", order)
        if n_probe is None:
            best = materialize(best, "near")
            limits = best.groupBy("ask").agg(F.max(F.col("units") / _UNITS).alias("limit"))
            bounded = joined(asked, limits, "ask")
            rest = materialize(bounded.mapInArrow(_visits(cell_map, groups, k, 1, True), schema), "visits")
            far = _meet(index, bounded, rest, k)
            best = top_k(best.drop("rank").unionByName(far), k, "ask", order)
        best = best.drop("rank")
    if index.n_points != index.n_vectors:
        best = materialize(best, "best_vectors")
    placed = top_k(_with_copies(index, best, k), k, "ask", [F.asc("units"), F.asc("doc_pos")])
    answered = joined(placed, asked, "ask").drop("ask")
    return (
        joined(asked_all, answered, "embedding")
        .select(
            F.col("query_id").alias(id_col),
            F.col("rank").cast("int").alias("rank"),
            "doc_pos",
            (F.col("units") / _UNITS).alias("score"),
        )
    )
