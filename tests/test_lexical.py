import random

import pytest

from brute import bm25
from lorequery.operators import lexical
from lorequery.operators.ranking import number_rows
from pyspark.sql import functions as F


def corpus(spark, documents):
    return spark.createDataFrame(list(documents.items()), "doc_pos long, question string")


def search(spark, documents, questions, k, path, **options):
    """Builds the index on the first call for a path."""
    index = lexical.build_lexical_index(corpus(spark, documents), path)
    asked = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    found = lexical.bm25_search(index, asked, k, **options)
    rows = [(r.query_id, r["rank"], r.doc_pos, r.score) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return index, set(rows)


def random_texts(seed, n, vocabulary, longest, copies=0.3):
    """Texts with a skewed vocabulary; one text has ``copies`` of all rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    same = " ".join(rng.choices(words, weights, k=longest))
    return {
        i * 7 + 3: same if rng.random() < copies
        else " ".join(rng.choices(words, weights, k=rng.randint(0, longest)))
        for i in range(n)
    }


def test_search_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS_PER_SALT", 20)
    monkeypatch.setattr(lexical, "POSTINGS_PER_BUCKET", 200)
    documents = random_texts(1, 150, 60, 12)
    questions = dict(enumerate(random_texts(2, 40, 80, 9, copies=0.4).values()))
    questions |= {100: "", 101: "unknown terms only", 102: "w0 w0 w1", 103: "w0", 104: "w59 w58 w57", 105: "w0"}
    for k, direct_hits in [(1, 0), (3, 0), (40, 0), (3, 10**9)]:
        index, got = search(spark, documents, questions, k, str(tmp_path / "i"), direct_hits=direct_hits)
        assert index.n_buckets > 1 and index.n_texts < index.n_docs and not index.weights_may_be_negative
        assert got == bm25(documents, questions, k)


@pytest.mark.parametrize("seed", range(2))
def test_pruning_on_frequent_terms(spark, tmp_path, seed):
    """Questions of frequent words only take the other allowance rule."""
    documents = random_texts(10 + seed, 3000, 12, 30, copies=0.0)
    questions = dict(enumerate(random_texts(20 + seed, 30, 12, 4, copies=0.0).values()))
    _, got = search(spark, documents, questions, 5, str(tmp_path / "i"), direct_hits=0)
    assert got == bm25(documents, questions, 5)


@pytest.fixture
def banded(monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS_PER_BUCKET", 4000)
    monkeypatch.setattr(lexical, "BANDED_POSTINGS", 40)
    monkeypatch.setattr(lexical, "MAX_BANDED_TERMS", 10**9)


@pytest.mark.parametrize("first", [1, 2])
def test_bands_equal_brute_force(spark, tmp_path, banded, first):
    """All at once, and every second document first; what is added makes the mean length grow."""
    documents = random_texts(5, 900, 50, 25, copies=0.1)
    documents |= {i: f"{t} {t} {t}" for i, t in documents.items() if i % 2}
    questions = dict(enumerate(random_texts(6, 40, 60, 6, copies=0.0).values())) | {100: "w0", 101: "w0 w1", 102: "w49 w0"}
    path = str(tmp_path / "i")
    lexical.build_lexical_index(corpus(spark, {i: t for i, t in documents.items() if i % first == 0}), path)
    if first > 1:
        assert lexical.add_to_lexical_index(corpus(spark, documents), path).growth > 1
    folders = {f.parent.name for f in tmp_path.glob("i/**/term_bucket=*/band=*/*.parquet")}
    assert f"band={lexical.BANDS}" in folders and len(folders) > 3
    for k in (1, 4):
        for direct_hits in (0, 10**9):
            _, got = search(spark, documents, questions, k, path, direct_hits=direct_hits)
            assert got == bm25(documents, questions, k)


def test_low_bands_are_not_read(spark, tmp_path, monkeypatch, banded):
    documents = random_texts(7, 3000, 300, 15, copies=0.0)
    seen, in_bands = [], lexical._in_bands

    def spy(index, read):
        out = in_bands(index, read)
        plan = out.postings._jdf.queryExecution().executedPlan().toString()
        long_lists = [df.filter(F.col("band") < lexical.BANDS) for df in (out.postings, index.postings)]
        seen.append((*[df.count() for df in long_lists], index.postings.count(), plan))
        return out

    monkeypatch.setattr(lexical, "_in_bands", spy)
    questions = {1: "w0", 2: "w1"}
    index, got = search(spark, documents, questions, 2, str(tmp_path / "i"), direct_hits=0)
    assert got == bm25(documents, questions, 2)
    some, asked, whole, plan = seen[0]
    assert some < asked / 2 and whole < index.postings.count()
    filters = plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
    assert "term_bucket" in filters and "band" in filters


@pytest.mark.parametrize(
    "documents",
    [
        {1: "a b", 2: "a b", 3: "a b", 4: "a b c"},  # negative mean: matches rank below zero rows
        {5: "a", 6: "a", 7: "a"},
        {1: "x", 2: "x y"},  # idf 0 where a term is in half of the documents
        {1: "", 2: "", 9: "a a b"},
        {4: "only one"},
    ],
)
def test_degenerate_corpora(spark, tmp_path, documents):
    questions = {1: "a", 2: "b c", 3: "x y", 4: "", 5: "a a only"}
    for k in (1, 10):
        _, got = search(spark, documents, questions, k, str(tmp_path / "i"))
        assert got == bm25(documents, questions, k)


def test_zero_rows_come_from_the_highest_positions(spark, tmp_path):
    documents = {i: f"t{i}" for i in range(20)} | {19: "hit", 17: "hit"}
    _, got = search(spark, documents, {1: "hit"}, 5, str(tmp_path / "i"))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [19, 17, 18, 16, 15]


def test_missing_keys_are_indexed_as_a_token(spark, tmp_path):
    documents = {1: None, 2: "word", 3: "other"}
    _, got = search(spark, documents, {1: "nan"}, 1, str(tmp_path / "i"))
    assert {(r[0], r[2]) for r in got} == {(1, 1)}


def test_statistics(spark):
    documents = {1: "a a b", 2: "b", 3: "", 4: "c b"}
    df = corpus(spark, documents)
    tf = {(r.doc_pos, r.term): r.tf for r in lexical.term_frequencies(df, "doc_pos", "question").collect()}
    assert tf == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (4, "c"): 1, (4, "b"): 1}
    stats = {r.doc_pos: (r.dl, r.avgdl) for r in lexical.document_stats(df, "doc_pos", "question").collect()}
    assert stats == {1: (3, 1.5), 2: (1, 1.5), 3: (0, 1.5), 4: (2, 1.5)}
    idf = {r.term: (r.df, r.idf) for r in lexical.inverse_document_frequencies(df, "doc_pos", "question").collect()}
    assert idf["b"][0] == 3 and idf["a"] == idf["c"]
    # the mean includes the negative value it replaces
    raw_b = -0.8472978603872037
    assert idf["b"][1] == pytest.approx(0.25 * (2 * idf["a"][1] + raw_b) / 3)


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    rows = number_rows(df, [F.desc("v")], "n", "p").orderBy("p").collect()
    assert [r.p for r in rows] == list(range(1000))
    assert [r.v for r in rows] == [3 * i for i in range(999, -1, -1)]


def test_terms_of_a_text_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["ü", "a", "A"])], "doc_pos long, tokens array<string>")
    packed = lexical.packed_texts(df)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_pos, r.dl, r.words, tuple(r.tfs)) for r in packed.collect()} == {
        (1, 3, "a b", (1, 2)), (2, 0, "", ()), (3, 3, "A a ü", (1, 1, 1)),
    }
    rows = {(r.doc_pos, r.term, r.tf) for r in lexical.unpacked(packed, "doc_pos").collect()}
    assert rows == {(1, "a", 1), (1, "b", 2), (3, "ü", 1), (3, "a", 1), (3, "A", 1)}


@pytest.mark.parametrize("direct_hits", [0, 10**9])
def test_a_meeting_returns_k_rows_per_question(spark, tmp_path, monkeypatch, direct_hits):
    """Pairs of questions and texts that share a word are not shuffled, on either way."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 900)
    monkeypatch.setattr(lexical, "CHUNK_QUESTIONS", 50)
    documents, seen, meet = random_texts(31, 400, 30, 15, copies=0.0), [], lexical._meet

    def spy(*args):
        out = meet(*args)
        seen.append((out.groupBy("ask").count().agg(F.max("count")).first()[0], args[4]))
        return out

    monkeypatch.setattr(lexical, "_meet", spy)
    index, got = search(spark, documents, documents, 2, str(tmp_path / "i"), direct_hits=direct_hits)
    assert got == bm25(documents, documents, 2)
    n_blocks = 2 ** 6  # more than are cut here
    assert seen and all(most is None or most <= k * n_blocks for most, k in seen)
    assert max(most or 0 for most, _ in seen) < index.n_texts


def test_rows_of_one_position_add_up(spark, tmp_path):
    """Equal rows, and different texts of one length at one position."""
    rows = [(1, "a b"), (1, "a b"), (2, "a c"), (2, "d c"), (3, "e"), (4, "f g h"), (5, "i j")]
    df = spark.createDataFrame(rows, "doc_pos long, question string")
    index = lexical.build_lexical_index(df, str(tmp_path / "i"))
    found = {(r.text_id, r.term, r.tf) for r in index.postings.collect()}
    assert (1, "a", 2) in found and (2, "c", 4) in found and (3, "e", 1) in found


def test_questions_are_not_broadcast(spark, tmp_path):
    documents = random_texts(31, 50, 40, 12, copies=0.0)
    index = lexical.build_lexical_index(corpus(spark, documents), str(tmp_path / "i"))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(40)))), " ")
    found = lexical.bm25_search(index, spark.range(20_000).select(F.col("id").alias("query_id"), words.alias("question")), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin [digest" in last
    assert found.count() == 40_000
