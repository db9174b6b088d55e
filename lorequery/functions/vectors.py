"""Vector functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(left: Column, right: Column) -> Column:
    """Squared Euclidean distance of two vectors, summed in double precision."""
    diff = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda total, d: total + d * d)


def hashed_counts(token_list: Column, dim: int) -> Column:
    """How many tokens fall into each of ``dim`` buckets of their md5 hash."""
    buckets = F.transform(
        token_list, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim))
    )
    return F.aggregate(
        buckets,
        F.array_repeat(F.lit(0.0), dim),
        lambda counts, b: F.transform(counts, lambda c, i: F.when(i == b, c + 1.0).otherwise(c)),
    )


def unit_vector(values: Column, dim: int) -> Column:
    """Scale to length 1 as floats; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v))
    return F.zip_with(
        values,
        F.array_repeat(length, dim),
        lambda v, n: F.coalesce(F.try_divide(v, n), F.lit(0.0)).cast("float"),
    )
