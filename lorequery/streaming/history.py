"""Session histories: exchanges numbered in arrival order by keyed state, and read back as lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PAGE_ROWS = 100
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with keyed state, which need a state store on disk."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    # each micro-batch opens and commits every partition's store, however little it has for it: one per core will do
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set(_PROVIDER, _ROCKSDB)
    return session


class _Numbering(StatefulProcessor):
    """Gives the exchanges of a session consecutive numbers; one that was seen before gets none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, batch_id long, place long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, batch_id, place = self.seen.get() or (0, -1, -1)
        # two numbers per exchange of the session in this micro-batch, no texts
        own = sorted({at for at in ((r.batch_id, r.place) for r in rows) if at > (batch_id, place)})
        if own:
            self.seen.update((n + len(own), *own[-1]))
        for seq, (batch_id, place) in enumerate(own, n):
            yield Row(session_id=key[0], batch_id=batch_id, place=place, seq=seq)

    def close(self) -> None:
        pass


def number_exchanges(
    spark: SparkSession, exchanges_path: str, out_path: str, checkpoint: str, trigger: dict | None = None, files: int | None = None
) -> StreamingQuery:
    """Number the exchanges of each session as they arrive: ``session_id, batch_id, place, seq`` under ``out_path``.

    Follows the folders of ``answer_stream``; numbers start at 0 and have no gaps, also over restarts, and a
    replayed micro-batch gets no second numbers. ``files`` bounds what one micro-batch takes on.
    """
    session = stateful_session(spark)
    reader = session.readStream.schema("session_id string, place long, batch_id long")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    numbers = (
        reader.parquet(exchanges_path)
        .groupBy("session_id")
        .transformWithState(
            _Numbering(), "session_id string, batch_id long, place long, seq long", outputMode="Append", timeMode="None"
        )
    )
    return (
        numbers.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def numbered_exchanges(spark: SparkSession, exchanges_path: str, numbers_path: str) -> DataFrame:
    """The exchanges that have a number, with it as ``seq``."""
    numbers = spark.read.parquet(numbers_path).select("batch_id", "place", F.col("session_id").alias("_session"), "seq")
    exchanges = spark.read.parquet(exchanges_path).withColumn("batch_id", F.col("batch_id").cast("long"))
    same = F.col("session_id").eqNullSafe(F.col("_session"))
    return exchanges.join(numbers, ["batch_id", "place"]).filter(same).drop("_session", "batch_id", "place")


def session_history(exchanges: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Nested view: ``session_id, page, n, history`` with the exchanges of a page in arrival order.

    ``seq`` is the number of an exchange within its session. A session can be arbitrarily long, so its list
    comes in pages of ``page_rows`` numbers; reading the pages in order gives the whole list.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "user", "assistant")))
    return (
        exchanges.withColumn("page", F.expr(f"seq div {page_rows}"))
        .groupBy("session_id", "page")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.transform(
                ordered, lambda e: F.struct(e["user"].alias("user"), e["assistant"].alias("assistant"))
            ).alias("history"),
        )
    )
