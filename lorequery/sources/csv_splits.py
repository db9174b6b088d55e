"""CSV tables read in splits, also where quoted values span lines.

Whether a line starts inside a quoted value depends on all lines before it in the file. Each line is a
function from the state it starts in to the state it leaves; functions compose, first over the lines of
a split, then over the splits of a file (one row each). Splits that no value crosses are then parsed line by line;
only the others move their lines, and only the lines of records that span lines are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequery.session import materialize

#: Splits whose table may be handed to every executor: at about 200 bytes each this is 100 MB.
BROADCAST_SPLITS = 500_000

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # an opening quote and what follows up to a closing one
_FIELD = rf'(?:{_QUOTED}"[^,]*+|(?:[^",][^,]*+)?+)'
_OPEN = rf"(?:{_FIELD},)*+{_QUOTED}\z"
#: A line that starts outside and ends inside a quoted value; a quote opens a value only as its first character.
LEAVES_OPEN = rf"\A{_OPEN}"
#: A line that starts inside a quoted value and ends inside one: the same, or a later one.
STAYS_OPEN = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_OPEN})'
#: Everything of a record but the commas between its fields.
_FIELDS = rf'{_QUOTED}(?:"[^,]*+|\z)|[^",][^,]*+'

_SPLIT = "file string, start long, open0 int, open1 int, opens boolean, closes boolean, head long"


def _splits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per split: the state it leaves for either state it starts in, whether it ever opens or
    closes a value, and its first line that is not blank. The lines of a split come in order."""
    held: list | None = None
    for part in parts:
        key = part["file"] + ":" + part["start"].astype(str)
        edges = np.flatnonzero(np.r_[True, key.to_numpy()[1:] != key.to_numpy()[:-1]]) if len(part) else []
        done = []
        for at, end in zip(edges, [*edges[1:], len(part)]):
            lines = part.iloc[at:end]
            place = [lines["file"].iloc[0], lines["start"].iloc[0]]
            if held is None or held[:2] != place:
                if held is not None:
                    done.append(held)
                held = [*place, 0, 1, False, False, None]
            if held[6] is None and not lines["blank"].all():
                held[6] = int(lines["row"].to_numpy()[np.argmin(lines["blank"].to_numpy())])
            first, second = (lines[c].to_numpy(dtype=np.int64) for c in ("open0", "open1"))
            index = np.arange(len(lines))
            fixed = np.maximum.accumulate(np.where(first == second, index, -1))
            turns = np.cumsum((first == 1) & (second == 0))
            since = turns - np.where(fixed >= 0, turns[fixed], 0)
            for column, flag, watched in ((2, 4, 1), (3, 5, 0)):
                states = (np.where(fixed >= 0, first[fixed], held[column]) + since) % 2
                held[column] = int(states[-1])
                held[flag] = held[flag] or bool((states == watched).any())
        if done:
            yield _rows(done)
    if held is not None:
        yield _rows([held])


def _rows(done: list) -> pd.DataFrame:
    out = pd.DataFrame(done, columns=["file", "start", "open0", "open1", "opens", "closes", "head"])
    return out.astype({"head": "Int64"})


def _state_after(first: Column, second: Column, start: Column, window) -> Column:
    """The state after the rows of ``window``, functions given by what states 0 and 1 become."""
    turn = ((first == 1) & (second == 0)).cast("int")
    turns = F.coalesce(F.sum(turn).over(window), F.lit(0))
    # a row that leaves the same state either way makes what was before it irrelevant
    fixed = F.last(F.when(first == second, F.struct(first.alias("state"), F.col("_turns").alias("turns"))), True).over(window)
    return (F.coalesce(fixed["state"], start) + turns - F.coalesce(fixed["turns"], F.lit(0))) % 2


def _with_turns(df: DataFrame, window) -> DataFrame:
    turn = ((F.col("open0") == 1) & (F.col("open1") == 0)).cast("int")
    return df.withColumn("_turns", F.sum(turn).over(window))


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _placed_splits(lines: DataFrame) -> DataFrame:
    """Per split: ``state`` it starts in, whether a value ``spans`` its lines, the split ``source`` where a
    value that is open at its start began, whether one that begins here is open at its end, the header's row."""
    narrow = lines.select("file", "start", "row", "open0", "open1", (F.trim("value") == "").alias("blank"))
    splits = narrow.mapInPandas(_splits, _SPLIT)
    window = Window.partitionBy("file").orderBy("start")
    whole = Window.partitionBy("file")
    state = _state_after(F.col("open0"), F.col("open1"), F.lit(0), _before(window))
    after = F.when(F.col("state") == 0, F.col("open0")).otherwise(F.col("open1"))
    # the last record that begins here goes on in the next split
    carries = (F.col("after") == 1) & ((F.col("state") == 0) | F.col("closes"))
    named = F.struct("start", "head")
    return (
        _with_turns(splits, _upto(window))
        .withColumn("state", state)
        .withColumn("after", after)
        .select(
            "file",
            "start",
            "state",
            "after",
            F.when(F.col("state") == 0, F.col("opens")).otherwise(True).alias("spans"),
            F.last(F.when(carries, F.col("start")), True).over(_before(window)).alias("source"),
            F.min(F.when(F.col("head").isNotNull(), named)).over(whole)["head"].alias("head"),
        )
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file or folder: ``file, start, row, record, header``, read in splits of the files.

    ``start`` and ``row`` order the records of a file. Lines end in a line feed, with or without a carriage
    return, and are kept inside values; blank lines between records are skipped, ``header`` marks the first record of each file. A quote that
    is never closed makes the rest of its file one record. The splits are examined at once, so the file settings
    of the session must be the same when the result is read; otherwise that fails.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    quoted = F.col("value").contains('"')
    lines = lines.withColumns(
        {
            "open0": (quoted & F.col("value").rlike(LEAVES_OPEN)).cast("int"),
            "open1": (~quoted | F.col("value").rlike(STAYS_OPEN)).cast("int"),
        }
    )
    splits = materialize(_placed_splits(lines), "csv-places")
    small = splits.count() <= BROADCAST_SPLITS
    placed = lines.join(F.broadcast(splits) if small else splits, ["file", "start"], "left").withColumn(
        "spans", F.coalesce("spans", F.raise_error(F.lit("files or splits have changed since they were examined")).cast("boolean"))
    )
    is_blank = F.trim(F.regexp_replace("value", r"\r\z", "")) == ""
    header = (F.col("row") == F.col("head")).alias("header")
    record = F.col("value").alias("record")
    plain = placed.filter(~F.col("spans") & ~is_blank).select("file", "start", "row", record, header)

    window = Window.partitionBy("file", "start").orderBy("row")
    crossed = _with_turns(placed.filter("spans"), _upto(window)).withColumn(
        "before", _state_after(F.col("open0"), F.col("open1"), F.col("state"), _before(window))
    )
    crossed = crossed.withColumn("ends", F.when(F.col("before") == 0, F.col("open0")).otherwise(F.col("open1")))
    begins = F.when(F.col("before") == 0, F.col("row"))
    crossed = crossed.withColumns(
        {
            "first": F.last(begins, True).over(_upto(window)),
            "latest": F.max(begins).over(Window.partitionBy("file", "start")),
        }
    )
    single = (F.col("before") == 0) & (F.col("ends") == 0)
    alone = crossed.filter(single & ~is_blank).select("file", "start", "row", record, header)
    # a record that goes on in a later split is known by the split it began in
    open_end = (F.col("after") == 1) & (F.col("first") == F.col("latest"))
    key_row = F.when(F.col("first").isNotNull() & ~open_end, F.col("first")).otherwise(-1)
    key_start = F.when(F.col("first").isNull(), F.col("source")).otherwise(F.col("start"))
    pieces = F.sort_array(F.collect_list(F.struct("start", "row", "value", header)))
    joined = (
        crossed.filter(~single)
        .groupBy("file", key_start.alias("key_start"), key_row.alias("key_row"))
        .agg(pieces.alias("lines"))
        .select(
            "file",
            F.col("lines")[0]["start"].alias("start"),
            F.col("lines")[0]["row"].alias("row"),
            F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"),
            F.col("lines")[0]["header"].alias("header"),
        )
    )
    records = plain.unionByName(alone).unionByName(joined)
    return records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def field_count(record: Column) -> Column:
    """How many fields a record has."""
    return F.length(F.regexp_replace(record, _FIELDS, "")) + 1


def read_csv_splits(spark: SparkSession, path: str, too_long: str = "fail", place: tuple[str, str, str] | None = None) -> DataFrame:
    """Scan a CSV file or folder with a header in splits; all columns are strings, short records end in nulls.

    Records with more fields than the header make the scan fail, or lose the fields beyond it with
    ``too_long="cut"``. ``place`` names three columns to add, which together order the records of the input.
    """
    if too_long not in ("fail", "cut"):
        raise ValueError(f"too_long is 'fail' or 'cut', not {too_long!r}")
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    try:
        # reads the first record only
        names = spark.read.options(header="true", **options).csv(path).columns
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such input: {path}") from err
        raise
    if not names:
        raise ValueError(f"no header in {path}")
    form = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = csv_records(spark, path).filter(~F.coalesce("header", F.lit(False)))
    parsed = F.from_csv("record", form, options)
    if too_long == "fail":
        told = F.concat(F.lit(f"more than {len(names)} fields in a record of "), F.col("file"), F.lit(": "), F.substring("record", 1, 200))
        parsed = F.when(field_count(F.col("record")) <= len(names), parsed).otherwise(F.from_csv(F.raise_error(told).cast("string"), form, options))
    wanted = [F.col(c).alias(p) for c, p in zip(("file", "start", "row"), place or ())]
    return rows.select(*wanted, parsed.alias("fields")).select(*(place or ()), "fields.*")
