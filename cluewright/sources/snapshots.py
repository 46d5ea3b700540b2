"""Keyed tables that are upserted durably: buckets of files, and versions that say which of them hold.

    <root>/data/<write>/bucket=<b>/part-*.parquet    rows of one bucket, never changed once written
    <root>/versions/<number>                         a version: each bucket's files, and the batches it has taken in

An upsert reads and writes the buckets that its batch touches and no others.
It becomes visible by one file, the next version, that is renamed into place
when all data are there: a reader sees a version whole or not at all, and a
run that dies before leaves files that nothing refers to. There is one writer
at a time and any number of readers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import latest

BUCKETS = 64


@dataclass
class Version:
    """What a version file says. writes: the write under data/ that holds a bucket's rows; batches: the version that took each batch in."""

    number: int
    key: list[str]
    order: list[str]
    schema: str
    buckets: int
    writes: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Snapshots:
    """A keyed table at root. Rows are latest by `order` for each `key`, as in scans.latest()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []

    def versions(self) -> list[int]:
        """Numbers of the versions there are, in order."""
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the latest; None where there is none yet."""
        number = number if number is not None else max(self.versions(), default=None)
        if number is None:
            return None
        text = self.spark.read.text(f"{self.root}/versions/{number}", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default of the latest."""
        v = self.version(number)
        if v is None:
            raise ValueError(f"{self.root} has no version")
        return self._rows(v, list(v.writes))

    def _rows(self, v: Version, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        places = [f"{self.root}/data/{v.writes[b]}/bucket={b}" for b in buckets if b in v.writes]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _published(self, v: Version) -> None:
        """Rename the version into place; a version that another writer has made meanwhile is an error."""
        final, draft = self._path(f"{self.root}/versions/{v.number}"), self._path(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(v.__dict__, ensure_ascii=False).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {v.number} of {self.root} was written by another run")

    def upsert(self, rows: DataFrame, key: list[str], order: list[str], batch: str | None = None, buckets: int = BUCKETS) -> int:
        """Take rows in and give the number of the version that has them.

        A row replaces the one of its key unless that is later by `order`; of
        equal ones the new row stands. A batch that was taken in before, by
        its name, changes nothing. key, order, columns and buckets are those
        of the first version. Rows with a null in their key are kept like
        others, under that key. Without rows there is no new version but the
        first.
        """
        old = self.version()
        if old is not None and batch is not None and batch in old.batches:
            return old.batches[batch]
        if old is None:
            old = Version(0, key, order, json.dumps(rows.schema.jsonValue()), buckets)
        elif (old.key, old.order) != (key, order):
            raise ValueError(f"{self.root} has key {old.key} and order {old.order}")
        schema = T.StructType.fromJson(json.loads(old.schema))
        bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(old.buckets)).alias("bucket")
        new = latest(rows.select(*schema.names), key, order).withColumn("__new", F.lit(1)).select("*", bucket)
        write = f"{old.number + 1}-{uuid.uuid4().hex}"
        # The batch alone first: which buckets it touches is read off what is written, and the merge does not run its source twice.
        staged = f"{self.root}/data/{write}-batch"
        new.write.partitionBy("bucket").parquet(staged)
        touched = sorted(n.removeprefix("bucket=") for n in self._names(f"data/{write}-batch") if n.startswith("bucket="))
        v = Version(old.number + 1, key, order, old.schema, old.buckets, dict(old.writes), dict(old.batches))
        if touched:
            before = self._rows(old, touched).withColumn("__new", F.lit(0)).select("*", bucket)
            again = self.spark.read.schema(new.schema).parquet(staged)
            merged = latest(before.unionByName(again), key, [*order, "__new"]).drop("__new")
            merged.repartition(min(len(touched), old.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{write}")
            v.writes |= {b: write for b in touched}
        self._files.delete(self._path(staged), True)
        if not touched and old.number:
            return old.number
        if batch is not None:
            v.batches[batch] = v.number
        self._published(v)
        return v.number

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the latest `keep` versions, and the data that these do not refer to; the number of writes deleted."""
        numbers = self.versions()
        stay = {w for n in numbers[-keep:] for w in self.version(n).writes.values()}
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.root}/versions/{n}"), False)
        gone = [w for w in self._names("data") if w not in stay]
        for w in gone:
            self._files.delete(self._path(f"{self.root}/data/{w}"), True)
        return len(gone)
