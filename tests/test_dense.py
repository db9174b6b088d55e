import numpy as np
import pytest

from brute import nearest
from lorequery.operators import dense
from lorequery.operators.embedding import hash_embedder, model_embedder
from lorequery.session import materialize
from pyspark.sql import functions as F


def frame(spark, vectors, name):
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def search(spark, vectors, questions, k, path, cell_rows=4096, **options):
    index = dense.build_vector_index(frame(spark, vectors, "doc_pos"), path, cell_rows=cell_rows)
    found = dense.dense_search(index, frame(spark, questions, "query_id"), k, **options)
    return index, {(r.query_id, r["rank"], r.doc_pos, r.score) for r in found.collect()}


def clustered(seed, n, dim=6, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 5
    sizes = rng.choice(clusters, size=n, p=[0.4] + [0.6 / (clusters - 1)] * (clusters - 1))
    # coarse steps make equal vectors and equal distances common
    return {int(i * 3 + 1): np.round(centres[c] + rng.normal(size=dim) * 0.4, 1).astype("float32")
            for i, c in enumerate(sizes)}


@pytest.mark.parametrize("cell_rows, blocks, k", [(4096, 4096, 5), (20, 4096, 1), (20, 7, 5)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, cell_rows, blocks, k):
    monkeypatch.setattr(dense, "BLOCK_ROWS", blocks)
    vectors = clustered(1, 260)
    third = vectors[1]
    vectors = {i: (third if i // 3 % 3 == 0 else v) for i, v in vectors.items()}
    questions = dict(list(clustered(2, 40).items())) | {1000: third, 1001: third, 1002: vectors[7]}
    index, got = search(spark, vectors, questions, k, str(tmp_path / "v"), cell_rows)
    assert index.n_points < index.n_vectors
    assert got == nearest(vectors, questions, k)


def test_only_visited_cells_are_read(spark, tmp_path, monkeypatch):
    vectors, path = clustered(5, 900), str(tmp_path / "v")
    one = {1: list(vectors.values())[5]}
    plans, nearest_of = [], dense._meet

    def spy(index, asked, visits, k):
        out = nearest_of(index, asked, visits, k)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(dense, "_meet", spy)
    index, got = search(spark, vectors, one, 3, path, 30)
    assert got == nearest(vectors, one, 3) and index.n_cells == 30
    assert len(list(tmp_path.glob("v/**/points/cell=*"))) > 20
    for plan in plans:
        assert "NestedLoopJoin" not in plan
        assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    more = {i + 1: v for i, v in clustered(6, 300).items()}
    dense.add_vectors(frame(spark, more, "doc_pos"), path)
    assert search(spark, vectors, one, 3, path)[1] == nearest(vectors | more, one, 3)


def test_more_neighbours_than_vectors(spark, tmp_path):
    vectors = {i: [float(i), 0.0] for i in range(5)}
    for rows in (4096, 2):
        _, got = search(spark, vectors, {9: [0.0, 0.0]}, 10, str(tmp_path / f"v{rows}"), rows)
        assert got == nearest(vectors, {9: [0.0, 0.0]}, 10)


def test_ties_take_the_lower_position(spark, tmp_path):
    vectors = {i: [1.0 if i % 2 else -1.0, 0.0] for i in range(40)}
    _, got = search(spark, vectors, {1: [0.0, 0.0]}, 4, str(tmp_path / "v"))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [0, 1, 2, 3]


def test_approximate_search(spark, tmp_path):
    vectors, questions = clustered(3, 600), clustered(4, 60)
    want = nearest(vectors, questions, 3)
    _, got = search(spark, vectors, questions, 3, str(tmp_path / "v"), 30, n_probe=3)
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) / len(want) > 0.8


def test_hash_embedder_is_scaled_and_counts_words(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None)], "i int, t string")
    got = {r.i: np.array(r.embedding) for r in hash_embedder(16)(df, "t").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0) and sorted(got[1])[-2:] == pytest.approx([5**-0.5, 2 * 5**-0.5])
    assert not got[2].any() and not got[3].any()


def test_model_embedder_loads_once_per_task(spark):
    def load():
        def encode(texts):
            return [[len(t), t.count("a")] for t in texts]

        return encode

    df = spark.createDataFrame([("aa",), ("b",), (None,)], "t string")
    assert [r.embedding for r in model_embedder(load)(df, "t").collect()] == [[2.0, 2.0], [1.0, 0.0], [0.0, 0.0]]


def test_cells_are_visited_together_by_many_questions(spark, tmp_path, monkeypatch):
    """As many rows are moved as there are groups for each question, not cells."""
    seen, meet = [], dense._meet

    def spy(index, asked, visits, k):
        seen.append(visits.count())
        return meet(index, asked, visits, k)

    monkeypatch.setattr(dense, "_meet", spy)
    rng = np.random.default_rng(8)
    vectors = {i: np.round(rng.normal(size=6), 2).astype("float32") for i in range(600)}
    index, got = search(spark, vectors, vectors, 3, str(tmp_path / "v"), 10)
    assert got == nearest(vectors, vectors, 3)
    assert index.n_cells == 60 and sum(seen) <= 600 * 4


def test_distances_to_pivots_are_worked_out_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dense, "PIVOT_DISTANCES", 1000)
    sizes, squared = [], dense._squared
    monkeypatch.setattr(dense, "_squared", lambda a, b: sizes.append(len(a) * len(b)) or squared(a, b))
    rows = pa.record_batch({"embedding": pa.array([[float(i), 1.0] for i in range(500)])})
    out = list(dense._assign(np.arange(20.0).reshape(10, 2))(iter([rows])))
    assert sum(b.num_rows for b in out) == 500 and max(sizes) <= 1000


def test_questions_and_visits_are_not_broadcast(spark, tmp_path):
    """Regular visits and equal vectors take next to no room on disk: their size there says nothing about memory."""
    rows = spark.range(6000).select("id", F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.rand(3).cast("float") + i).alias("embedding"))
    rows.write.parquet(str(tmp_path / "rows"))
    vectors = spark.read.parquet(str(tmp_path / "rows"))
    index = dense.build_vector_index(vectors, str(tmp_path / "v"), "id")
    found = dense.dense_search(index, vectors.withColumnRenamed("id", "query_id"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join" in line)
    asked = materialize(vectors.withColumnRenamed("id", "ask"), "asked")
    pairs = asked.select("ask", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("visit")).select("ask", (F.col("visit") % index.n_cells).alias("cell"))
    visits = materialize(pairs, "visits")
    assert visits._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 256 * 1024
    plan = dense._meet(index, asked, visits, 2)._jdf.queryExecution().executedPlan().toString()
    # the layout and the members of cells only
    assert plan.count("BroadcastHashJoin") == 2
