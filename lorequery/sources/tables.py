"""Parquet tables as artefacts: written once, skipped when complete, reopened by path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker; a broken-off write did not."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(marker)


def write_once(
    spark: SparkSession,
    path: str,
    make: Callable[[], DataFrame],
    overwrite: bool = False,
    partition_by: list[str] | None = None,
) -> bool:
    """Write the table unless a complete one is there; tells whether it wrote."""
    if not overwrite and is_complete(spark, path):
        return False
    writer = make().write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return True


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Analysis-time check that the columns exist."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}; found {', '.join(df.columns)}")
    return df


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def has_rows(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()
