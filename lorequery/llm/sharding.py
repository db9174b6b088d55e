"""Jump consistent hashing of stable keys to shards, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequery.llm.common import running_total

#: Bytes that a stored row takes besides its text.
ROW_OVERHEAD = 16


def _jump_from(key: Column, bucket: Column) -> Column:
    """The bucket after ``bucket`` on the walk of ``key``: floor((bucket + 1) / u), u uniform in (0, 1]."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), bucket.cast("string"))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long") + 1).cast("double") / float(1 << 52)
    return F.floor((bucket + 1).cast("double") / uniform).cast("long")


def jump_walk(key: Column, shards: int) -> Column:
    """``here``: the shard of the key among ``shards``; ``next``: where it would go as shards are appended.

    With n + 1 shards a key either stays or moves into shard n, which it does where
    ``next`` is n. Only the buckets that the walk visits, about ln(n), are hashed.
    """
    start = F.struct(F.lit(0).cast("long").alias("here"), F.lit(0).cast("long").alias("next"))

    def visit(state: Column, bucket: Column) -> Column:
        moved = F.struct(bucket.alias("here"), _jump_from(key, bucket).alias("next"))
        return F.when(state["next"] == bucket, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), start, visit)


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", name: str = "shards"
) -> DataFrame:
    """One row per document: ``id, size, text_crc32, law, shard, slot, grown_shard``.

    The id and the number of shards alone decide (law ``key``); a null id counts as
    the empty text. ``slot`` numbers the rows of a shard from 0 by id, so repeated ids
    follow each other. A null text has no bytes. Texts never move: they are measured
    where they are read, and other columns are not read.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    walked = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        jump_walk(F.coalesce(F.col(id_col).cast("string"), F.lit("")), shards).alias("walk"),
    ).select(
        "id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("walk.here").cast("int").alias("shard"),
        F.when(F.col("walk.next") == shards, F.lit(shards)).otherwise(F.col("walk.here")).cast("int").alias("grown_shard"),
    )
    numbered = running_total(walked, ["shard"], ["id", "size", "text_crc32"], F.lit(1), "slot", name)
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
