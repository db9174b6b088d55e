"""Versions and segments: indexes that grow, are reopened and rebuilt."""

import os
import random

import numpy as np
import pytest

from brute import bm25, nearest
from lorequery.operators import dense, lexical
from lorequery.plans.build import add_to_index, build_index, open_index
from lorequery.sources import versions

CORPUS = "doc_pos long, question string, answer string"


def documents(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_pos long, question string")


def vectors(spark, rows, name="doc_pos"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], f"{name} long, embedding array<float>")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


@pytest.mark.parametrize("seed, k, direct_hits", [(1, 3, 10**9), (2, 8, 0), (3, 40, 0)])
def test_lexical_index_in_steps_equals_the_whole(spark, tmp_path, seed, k, direct_hits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = {i: " ".join(rng.choice(words[: rng.randint(1, 30)]) for _ in range(rng.randint(0, 9))) for i in range(90)}
    rows[17] = rows[60] = rows[89] = "w1 w2 w3"  # equal texts in several segments
    rows[5] = None
    questions = {i: " ".join(rng.choice([*words, "unknown"]) for _ in range(rng.randint(0, 5))) for i in range(30)}
    path = str(tmp_path / "l")
    index = lexical.build_lexical_index(documents(spark, {i: t for i, t in rows.items() if i % 3 == 0}), path)
    for step in (1, 2):
        before = files(path)
        # known positions are left alone, whatever they hold now
        more = {i: (t if i % 3 == step else "other") for i, t in rows.items() if i % 3 <= step}
        index = lexical.add_to_lexical_index(documents(spark, more), path)
        assert before.items() <= files(path).items()
    asked = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    found = lexical.bm25_search(index, asked, k, direct_hits=direct_hits).collect()
    assert {(r.query_id, r["rank"], r.doc_pos, r.score) for r in found} == bm25({i: "nan" if t is None else t for i, t in rows.items()}, questions, k)


def test_lexical_index_of_matches_that_rank_below_zero_rows(spark, tmp_path):
    rows = {1: "a b", 2: "a b", 3: "a b", 4: "a b c", 9: "a b"}
    path = str(tmp_path / "l")
    lexical.build_lexical_index(documents(spark, {i: rows[i] for i in (1, 9)}), path)
    index = lexical.add_to_lexical_index(documents(spark, rows), path)
    asked = spark.createDataFrame([(1, "a"), (2, "c"), (3, "")], "query_id long, question string")
    got = {(r.query_id, r["rank"], r.doc_pos, r.score) for r in lexical.bm25_search(index, asked, 4).collect()}
    assert got == bm25(rows, {1: "a", 2: "c", 3: ""}, 4)


@pytest.mark.parametrize("cell_rows", [10, 4096])
def test_vector_index_reopened_with_other_parameters(spark, tmp_path, cell_rows):
    rng = np.random.default_rng(4)
    rows = {i: np.round(rng.normal(size=5) + 6 * (i % 4), 1).astype("float32") for i in range(120)}
    rows[11] = rows[50] = rows[53] = rows[0]
    path = str(tmp_path / "v")
    dense.build_vector_index(vectors(spark, {i: v for i, v in rows.items() if i < 50}), path, cell_rows=cell_rows)
    before = files(path)
    dense.add_vectors(vectors(spark, {i: (v if i >= 50 else v * 0) for i, v in rows.items() if i < 90}), path)
    dense.add_vectors(vectors(spark, rows), path)
    assert before.items() <= files(path).items()
    index = dense.build_vector_index(vectors(spark, {}), path)
    assert index.n_vectors == 120 and dense.add_vectors(vectors(spark, rows), path).version == index.version
    found = dense.dense_search(index, vectors(spark, rows, "query_id"), 4).collect()
    assert {(r.query_id, r["rank"], r.doc_pos, r.score) for r in found} == nearest(rows, rows, 4)


def test_additions_to_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    index = build_index(spark.createDataFrame([], CORPUS), path)
    assert (index.lexical.n_docs, index.vectors.n_vectors) == (0, 0)
    index = add_to_index(spark.createDataFrame([(3, "a b", "yes"), (5, "c", None)], CORPUS), path, index)
    assert (index.lexical.n_docs, index.vectors.n_vectors, index.corpus.count()) == (2, 1, 2)
    asked = spark.createDataFrame([(1, "c a")], "query_id long, question string")
    assert {r.doc_pos for r in lexical.bm25_search(index.lexical, asked, 5).collect()} == {3, 5}
    found = dense.dense_search(index.vectors, index.embedder(asked, "question"), 5).collect()
    assert [r.doc_pos for r in found] == [3]


def test_readers_survive_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "i")
    old = build_index(spark.createDataFrame([(0, "old", "was")], CORPUS), path)
    new = build_index(spark.createDataFrame([(0, "new", "is"), (1, "more", "too")], CORPUS), path, overwrite=True)
    asked = spark.createDataFrame([(1, "old")], "query_id long, question string")
    assert [r.score > 0 for r in lexical.bm25_search(old.lexical, asked, 1).collect()] == [False]
    assert [r.answer for r in old.corpus.collect()] == ["was"] and old.vectors.vectors.count() == 1
    assert {r.answer for r in new.corpus.collect()} == {"is", "too"}
    # an earlier version can still be opened, until it is removed
    assert [r.answer for r in open_index(spark, path, version=1).corpus.collect()] == ["was"]
    for part in ("", "/lexical", "/vectors", "/collection"):
        assert len(versions.remove_unused(spark, path + part)) == 1
        assert versions.versions(spark, path + part) == [2]
    assert {r.answer for r in open_index(spark, path).corpus.collect()} == {"is", "too"}
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_a_broken_off_build_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "i")
    corpus = spark.createDataFrame([(0, "a", "one")], CORPUS)

    def fails(df, column):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        build_index(corpus, path, fails)
    assert versions.versions(spark, path) == []
    assert build_index(corpus, path).vectors.n_vectors == 1


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "a")
    assert versions.commit(spark, path, {"segments": []}, 0)["version"] == 1
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark, path, {"segments": []}, 0)
    assert versions.versions(spark, path) == [1] and versions.read_version(spark, path)["segments"] == []
    assert versions.read_version(spark, str(tmp_path / "b")) is None


def test_opening_reads_version_files_only(spark, tmp_path):
    path = str(tmp_path / "i")
    index = build_index(spark.createDataFrame([(i, f"w{i}", "x") for i in range(20)], CORPUS), path)
    add_to_index(spark.createDataFrame([(90, "w1", "y")], CORPUS), path, index)
    tracker, group = spark.sparkContext.statusTracker(), "opening"
    spark.sparkContext.setJobGroup(group, group)
    open_index(spark, path)
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one for the schema of each table of each segment, none over rows
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert all(s is None or s.numTasks <= 1 for s in stages) and len(jobs) <= 20
