"""Artefacts made of segments, with versions.

An artefact is a folder. Its segments are folders of tables that are written once and never changed. A
version is a small file that lists the segments, the parameters they were built with and figures about
them; it is written last, so whatever it names is complete. Readers open a version and keep
reading its segments while others add segments or rebuild; what no version in use names
can be removed later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_VERSIONS = "_versions"
_SEGMENTS = "segments"


class VersionConflict(RuntimeError):
    """Someone else has written the next version meanwhile."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, ascending."""
    jvm, folder, files = _files(spark, f"{path}/{_VERSIONS}")
    if not files.exists(folder):
        return []
    names = [str(status.getPath().getName()) for status in files.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdigit())


def read_version(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any] | None:
    """The newest version or the given one; None where the artefact has none."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    number = known[-1] if version is None else version
    jvm, file, files = _files(spark, f"{path}/{_VERSIONS}/{number}.json")
    stream = files.open(file)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, content: dict[str, Any], after: int) -> dict[str, Any]:
    """Write version ``after`` + 1; a VersionConflict if that one exists already."""
    entry = {**content, "version": after + 1}
    target = f"{path}/{_VERSIONS}/{after + 1}.json"
    jvm, draft, files = _files(spark, f"{path}/{_VERSIONS}/draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(json.dumps(entry, sort_keys=True).encode("utf-8"))
    finally:
        stream.close()
    file = jvm.org.apache.hadoop.fs.Path(target)
    if files.exists(file) or not files.rename(draft, file):
        files.delete(draft, False)
        raise VersionConflict(f"{path} has a version {after + 1} already")
    return entry


def new_segment() -> str:
    """A fresh segment's folder, relative to its artefact."""
    return f"{_SEGMENTS}/{uuid.uuid4().hex}"


def segment_tables(spark: SparkSession, path: str, segments: list[dict[str, Any]], name: str) -> list[DataFrame]:
    """The table ``name`` of each segment."""
    return [spark.read.parquet(f"{path}/{segment['folder']}/{name}") for segment in segments]


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def write_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> tuple[DataFrame, bool]:
    """A single table as an artefact: written where there is none or on ``overwrite``; tells whether it wrote.

    A table that is overwritten stays where it is for those who read it.
    """
    held = read_version(spark, path)
    fresh = held is None or overwrite
    if fresh:
        segment = {"folder": new_segment()}
        make().write.parquet(f"{path}/{segment['folder']}/rows")
        held = commit(spark, path, {"segments": [segment]}, held["version"] if held else 0)
    return united(segment_tables(spark, path, held["segments"], "rows")), fresh


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the segments that the last ``keep`` versions do not name, and the older versions; their folders are returned."""
    known = versions(spark, path)
    used = {s["folder"] for v in known[-keep:] for s in read_version(spark, path, v)["segments"]}
    jvm, folder, files = _files(spark, f"{path}/{_SEGMENTS}")
    for version in known[:-keep]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{_VERSIONS}/{version}.json"), False)
    gone = []
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name = f"{_SEGMENTS}/{status.getPath().getName()}"
        if name not in used:
            files.delete(status.getPath(), True)
            gone.append(name)
    return gone
