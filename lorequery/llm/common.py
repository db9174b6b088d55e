"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequery import session

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts per Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_TEXTS = 256
#: Documents of an evaluation fold: crc32 of the id modulo this is 0.
FOLDS = 5

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that models must not learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside."""
    return _setting(spark, _BATCH, str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at a written table; shuffle files of the write go once it is done."""
    with _setting(df.sparkSession, _CLEANUP, "true"):
        return session.materialize(df, name)


def materialize_texts(df: DataFrame, name: str, rows: int = BATCH_TEXTS) -> DataFrame:
    """Write a result of a Python operator over texts, handing it few texts at a time."""
    with batches_of(df.sparkSession, rows):
        return materialize(df, name)


def running_total(
    df: DataFrame, groups: list[str], order: list[str], value: Column, out: str, name: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ranged over partitions, summed within each partition, and shifted by
    the totals of the partitions before, so that a group of any size is spread out.
    The partition totals have one row per partition and group that meet. The
    columns of ``groups`` hold no nulls; ``order`` must tell rows apart where it matters.
    """
    part, shift = free_name(df, "part"), free_name(df, "shift")
    amount = free_name(df, "amount")
    ranged = df.withColumn(amount, value.cast("long")).repartitionByRange(*groups, *order)
    ranged = materialize(ranged.withColumn(part, F.spark_partition_id()), name)
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*groups, part)
        .agg(F.sum(amount).alias(amount))
        .select(*groups, part, F.coalesce(F.sum(amount).over(before), F.lit(0)).alias(shift))
    )
    inside = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(shifts, [*groups, part])
        .withColumn(out, F.col(shift) + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop(part, shift, amount)
    )
