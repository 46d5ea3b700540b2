"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[str, list[str]] = {}
_OPEN = threading.local()
_LOCK = threading.Lock()
#: By application: threads that write, and CLEANUP before the first of them began.
_WRITING: dict[str, tuple[int, str]] = {}
#: Spark's setting to delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def one_machine(spark: SparkSession) -> bool:
    """The driver is the executor, so that they share its files."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local session gets one of our own; on a cluster that would be a folder of one machine, and is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def released(spark: SparkSession) -> int:
    """Delete what this session has stored, once results have been written elsewhere; the number of tables. Frames that read them are of no use after that."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread stores in the block is deleted at its end. Results are not: they belong to the block around it, or stay until released()."""
    blocks = _OPEN.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        paths = blocks.pop()
        held = _STORED.get(spark.sparkContext.applicationId, [])
        held[:] = sorted(set(held) - set(paths))
        _delete(spark, paths)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any thread of the session writes, and then what it was before the first of them."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        writers, before = _WRITING.get(app, (0, spark.conf.get(CLEANUP, "false")))
        _WRITING[app] = writers + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITING.pop(app)
            if writers > 1:
                _WRITING[app] = writers - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str = "part", result: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    The table takes the place of the shuffle files it was made from, so these
    go at once and not when the driver next collects garbage. A result outlives
    the scratch block it is written in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    blocks = _OPEN.__dict__.get("blocks", [])[: -1 if result else None]
    if blocks:
        blocks[-1].append(path)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
