"""Shared scratch space of a Spark session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from functools import wraps
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of files up to which Spark may send a side of a join to all workers. In memory it can take a hundred times as much.
SENT_BYTES = 256 * 1024

#: Scratch paths handed out inside the innermost ``tidied`` call.
_handed_out: ContextVar[list[str] | None] = ContextVar("handed_out", default=None)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint directory.

    Only a local session without one gets a temporary folder; on a cluster a
    machine-local folder would be invisible to the executors, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    handed_out = _handed_out.get()
    if handed_out is not None:
        handed_out.append(path)
    return path


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete the folders that exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def tidied(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Delete the scratch tables of a call that its result does not read.

    For functions of a DataFrame that return one. Tables that the result reads stay; an enclosing
    tidied call deletes them when its own result can do without. A call that fails leaves none.
    """

    @wraps(function)
    def call(df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
        outer, own, needed = _handed_out.get(), [], []
        mark = _handed_out.set(own)
        try:
            result = function(df, *args, **kwargs)
            read = {part for file in result.inputFiles() for part in file.split("/")}
            needed = [path for path in own if path.rsplit("/", 1)[-1] in read]
        finally:
            _handed_out.reset(mark)
            delete_tables(df.sparkSession, [path for path in own if path not in needed])
        if outer is not None:
            outer.extend(needed)
        return result

    return call


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A written table survives lost executors, keeps column pruning, and gives
    the next join the true size of its input.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input too small to fill one scan task per core, grouped by ``keys`` if any.

    Larger inputs are left as they are: their scan is parallel enough, and
    moving them would be a needless shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(cores, *keys) if size < cores * split else df


def _estimate(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def joined(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle, unless one side is so small on disk that it is small in memory too.

    Spark's size check takes the size of files for that of their rows, and the driver builds what is
    sent: a few megabytes of numbers, equal vectors or ids that repeat can be gigabytes there.
    """
    least = min(_estimate(side) for side in ((left, right) if how == "inner" else (right,)))
    return left.join(right.hint("merge") if least > SENT_BYTES else right, on, how)


def side_by_side(*jobs: Callable[[], Any]) -> list[Any]:
    """Run independent chains of Spark jobs at the same time, in the job group of the caller."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(copy_context().run, inherit(job)) for job in jobs]
        return [f.result() for f in running]
