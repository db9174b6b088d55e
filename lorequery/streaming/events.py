"""Answers folded from a stream of token events, with a time limit for those that never end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from lorequery.sources.events import folded_text, parsed_event
from lorequery.streaming.history import stateful_session

#: Milliseconds for which a finished answer is remembered, so that late lines do not start it again.
REMEMBERED_MS = 24 * 3600 * 1000


class _Fold(StatefulProcessor):
    """Holds the lines of an answer until its final record comes or its time is up."""

    def __init__(self, key: str, timeout_ms: int) -> None:
        self.key, self.timeout_ms = key, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "pos int, token string, final string")
        self.done = handle.getValueState("done", "done boolean", ttlDurationMs=REMEMBERED_MS)

    def _folded(self, key: tuple, complete: bool) -> pd.DataFrame:
        lines = sorted({tuple(line) for line in self.lines.get()}, key=lambda line: line[0])
        self.lines.clear()
        self.done.update((True,))
        words = [{"pos": pos, "token": token} for pos, token, _ in lines if token is not None]
        finals = [{"pos": pos, "final": final} for pos, token, final in lines if token is None and final is not None]
        return pd.DataFrame({self.key: [key[0]], "words": [words], "last": [finals[-1] if finals else None], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        ended = False
        for part in rows:
            held = [(int(r.pos), r.token, r.final) for r in part.itertuples(index=False) if r.token is not None or r.final is not None]
            ended |= any(token is None for _, token, _ in held)
            if held:
                self.lines.appendList(held)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if ended:
            yield self._folded(key, True)
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            yield self._folded(key, False)

    def close(self) -> None:
        pass


def fold_stream(
    spark: SparkSession,
    events_path: str,
    schema: StructType,
    key: str,
    out_path: str,
    checkpoint: str,
    timeout_ms: int,
    trigger: dict | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """Fold events ``key, pos, json`` that arrive as Parquet files: ``key, final, complete`` under ``out_path``.

    An answer is written once: when its final record is there, or with what has come when no line has come
    for ``timeout_ms`` (``complete`` is false then). What comes after that, also a second final record, changes
    nothing. Blank and malformed lines are skipped.
    """
    session, trigger = stateful_session(spark), trigger or {"availableNow": True}
    if trigger.get("availableNow"):
        # time limits would keep a run over what is there from ending; they are looked at when more lines come
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    reader = session.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    lines = reader.parquet(events_path).select(key, "pos", parsed_event(F.col("json")).alias("event")).select(
        key, F.col("pos").cast("int").alias("pos"), "event.token", "event.final"
    )
    kind = schema[key].dataType.simpleString()
    form = (
        f"{key} {kind}, words array<struct<pos: int, token: string>>, last struct<pos: int, final: string>, complete boolean"
    )
    folded = lines.groupBy(key).transformWithStateInPandas(
        _Fold(key, timeout_ms), form, outputMode="Append", timeMode="ProcessingTime"
    )
    return (
        folded.select(key, folded_text(F.col("words"), F.col("last")).alias("final"), "complete")
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_folded(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path)
