"""Row numbering and top-k selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequery.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in the low 33 bits


def top_k(df: DataFrame, k: int, by: str | list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    The literal bound lets Spark cut every group to k rows before the shuffle.
    """
    groups = [by] if isinstance(by, str) else by
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, order: list[Column] | None, name: str, position: str = "position") -> DataFrame:
    """Consecutive numbers from 0 in the given order, or in scan order without one.

    Rows are numbered inside their partition and shifted by the sizes of the
    partitions before it, so no task ever sees more than its own partition.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(df.withColumn("_mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mark", _ROW_BITS)
    # one row per partition of the write
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["_size"]
    shift = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(shift), "_part")
        .withColumn(position, F.col("_offset") + F.col("_mark").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_offset", "_mark")
    )
