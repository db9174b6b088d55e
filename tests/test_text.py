import pytest
from pyspark.sql import functions as F

from lorequery.functions import text as T


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_tokens(spark):
    got = apply(spark, T.tokens, ["", "  a \t b\n", "a　b", "a\x1cb", "payslip? It's x", None])
    assert got == [[], ["a", "b"], ["a", "b"], ["a", "b"], ["payslip?", "It's", "x"], None]


def test_normalize_question(spark):
    values = [" hello THERE ", " My account is LOCKED. What now? ", "", "x", "\x1cabC"]
    assert apply(spark, T.normalize_question, values) == [
        "Hello there", "My account is locked. what now?", "", "X", "Abc",
    ]


def test_strip_keeps_inner_space(spark):
    assert apply(spark, T.strip, ["  a  b \n", None]) == ["a  b", None]


SANITIZED = {
    "q: x A: y A: z": "z",
    "Context: z": "",
    "a\nUser: b": "a",
    "a: hi  there": "hi there",
    "DATA: x": "DATA: x",
    "A: A: x": "A: x",
    "Q: is DATA: x": "x",
    "Q: no answer label": "Q: no answer label",
    "a User: b": "a User: b",
    "one\nASSISTANT: two\nUser: three": "one",
    " \n ": "",
    None: "",
}


def test_sanitize_answer(spark):
    assert apply(spark, T.sanitize_answer, list(SANITIZED)) == list(SANITIZED.values())


CLEANED = {
    "ANSWER: A: hi": "hi",
    "a: hi": "a: hi",
    "Q: x A: y A: z": "y A: z",
    "Q: x": "Q: x",
    "answer:answer: x": "answer: x",
    "A: Q: x A: y": "y",
    None: "",
}


def test_clean_answer(spark):
    assert apply(spark, T.clean_answer, list(CLEANED)) == list(CLEANED.values())


def test_render_prompt_fills_each_slot_once(spark):
    df = spark.createDataFrame([("ctx {question} {context}", "why {context}?")], "c string, q string")
    template = "{{x}} {context} | {question} | {question}"
    got = df.select(T.render_prompt(template, F.col("c"), F.col("q")).alias("p")).first().p
    assert got == "{x} ctx {question} {context} | why {context}? | why {context}?"


def test_strip_prompt_is_literal_and_removes_every_copy(spark):
    df = spark.createDataFrame([("a.b(", "a.b( yes a.b( no axb( "), ("", " x ")], "p string, g string")
    got = [r[0] for r in df.select(T.strip_prompt(F.col("g"), F.col("p"))).collect()]
    assert got == ["yes  no axb(", "x"]


@pytest.mark.parametrize(
    "left, right, want",
    [("", "", 0.0), ("A b", "a B", 1.0), ("I do", "i", 0.5), ("a b c", "c d", 0.25), ("x", "y", 0.0)],
)
def test_jaccard(spark, left, right, want):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    assert df.select(T.jaccard(T.token_set("a"), T.token_set("b"))).first()[0] == want
