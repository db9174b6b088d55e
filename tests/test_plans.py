"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from lorequery.operators import lexical
from lorequery.operators.dense import build_vector_index, dense_search
from lorequery.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for part in re.findall(r"Window \[.*?\n.*?\n", text):
        assert "SinglePartition" not in part


@pytest.mark.parametrize("name", ["tokens", "bm25_idf", "session_history", "token_fold", "sanitize_answer"])
def test_no_cross_joins(spark, name):
    check(plan(QUERIES[name](spark, SMALL)))


def test_searches_cut_groups_before_the_shuffle(spark, tmp_path):
    rows = [(i, f"w{i % 7} w{i % 3}", [float(i % 5), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_pos long, question string, embedding array<float>")
    words = lexical.build_lexical_index(df, str(tmp_path / "l"))
    found = lexical.bm25_search(words, df.withColumnRenamed("doc_pos", "query_id"), 3)
    vectors = build_vector_index(df, str(tmp_path / "v"))
    near = dense_search(vectors, df.withColumnRenamed("doc_pos", "query_id"), 3)
    for text in (plan(found), plan(near)):
        check(text)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_lexical_index_reads_only_what_it_needs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_pos long, question string")
    index = lexical.build_lexical_index(df, str(tmp_path / "l"))
    terms = index.terms.select(F.lit(1).alias("ask"), "term_bucket", "term", F.lit(1.0).alias("weight"))
    text = plan(lexical._score_all(index, terms))
    assert re.search(r"ReadSchema: struct<text_id:bigint,dl:bigint,term:string,tf:bigint,term_bucket:int>", text)
