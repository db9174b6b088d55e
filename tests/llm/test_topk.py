"""Exact inner-product search against brute force."""

import math
import random

from pyspark.sql import functions as F

from lorequery.llm import topk

SCHEMA = "id long, embedding array<float>, score string"


def search(rows, spark, k=5, every=3):
    table = spark.createDataFrame(rows, SCHEMA).select("id", topk.quantize(F.col("embedding"), 256).alias("vector"))
    found = topk.largest_products(table.filter(f"id % {every} = 0"), table, k)
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def brute(rows, k=5, every=3):
    ints = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(256 * x) for x in v]
    out = {}
    for q in ints:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q)
            if scores:
                out[q] = [(c, -s) for s, c in scores[:k]]
    return out


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) * (1 + i % 5) for _ in range(6)], "x") for i in range(150)]
    rows += [(200 + i, [0.5] * 6, None) for i in range(40)]
    rows += [(300, None, "a"), (303, [1.0, None], "a"), (306, [float("nan")] * 6, "a"), (309, [float("inf")] * 6, "a")]
    rows += [(312, [], "a"), (315, [1.0, 2.0], "a"), (None, [9.0] * 6, "a"), (318, [0.0] * 6, "a")]
    assert search(rows, spark) == brute(rows)
    assert search(rows + rows[:20], spark) == brute(rows)


def test_few_and_none(spark):
    assert search([], spark) == {}
    assert search([(0, [1.0], "")], spark) == {}
    rows = [(i, [float(i % 2)], "") for i in range(4)]
    assert search(rows, spark) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Many blocks and large values give the same result."""
    rng = random.Random(6)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 64)
    rows = [(i, [float(round(rng.gauss(0, 1 + i % 9), 2)) for _ in range(8)], "") for i in range(200)]
    assert search(rows, spark) == {q: v for q, v in brute([(i, [__import__("numpy").float32(x) for x in v], s) for i, v, s in rows]).items()}
    big = [(i, [float(2.0**20 * (i - 3)), 1.0], "") for i in range(12)]
    assert search(big, spark) == brute(big)
