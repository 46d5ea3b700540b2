from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cluewright.sources.snapshots import Snapshots

SCHEMA = "clue_id string, status string, updated_at long"


def rows_of(df):
    return sorted(((r.clue_id or "", r.status, r.updated_at) for r in df.collect()))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/status")


def put(table, df, **more):
    return table.upsert(df, ["clue_id"], ["updated_at"], **more)


def test_upserts_and_versions(spark, table):
    assert table.versions() == [] and table.version() is None
    assert put(table, batch(spark, ("a", "x", 1), ("b", "x", 1), ("a", "y", 2), (None, "n", 1))) == 1
    assert put(table, batch(spark, ("a", "late", 1), ("b", "same time", 1), ("c", "z", 9), (None, "m", 2))) == 2
    assert rows_of(table.read()) == [("", "m", 2), ("a", "y", 2), ("b", "same time", 1), ("c", "z", 9)]
    assert rows_of(table.read(1)) == [("", "n", 1), ("a", "y", 2), ("b", "x", 1)]
    assert put(table, batch(spark).where("false")) == 2
    with pytest.raises(ValueError):
        table.upsert(batch(spark, ("a", "x", 1)), ["status"], ["updated_at"])


def test_only_touched_buckets_are_written(spark, table):
    many = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("clue_id"), F.lit("x").alias("status"), F.lit(1).cast("long").alias("updated_at"))
    put(table, many, buckets=16)
    first = table.version()
    put(table, batch(spark, ("k7", "y", 2)))
    second = table.version()
    changed = [b for b in first.writes if second.writes[b] != first.writes[b]]
    assert len(first.writes) == 16 and len(changed) == 1
    assert table.read().count() == 2000 and table.read().where("status = 'y'").count() == 1


def test_a_rerun_changes_nothing(spark, table):
    one = batch(spark, ("a", "x", 1), ("b", "x", 1))
    assert put(table, one, batch="monday") == 1
    assert put(table, batch(spark, ("a", "y", 2)), batch="tuesday") == 2
    assert put(table, one, batch="monday") == 1 and table.versions() == [1, 2]
    want = rows_of(table.read())
    put(table, one)  # without a name it is merged again, to the same rows
    assert rows_of(table.read()) == want == [("a", "y", 2), ("b", "x", 1)]


@pytest.mark.parametrize("point", ["merge", "publish"])
def test_a_crash_leaves_the_version_before(spark, table, monkeypatch, point):
    """A run that dies while it writes data, or between the data and the version, is as if it had not been; its rerun is whole."""
    put(table, batch(spark, ("a", "x", 1)), batch="one")
    two = batch(spark, ("a", "y", 2), ("b", "z", 1))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_published" if point == "publish" else "_rows", dies)
        with pytest.raises(OSError):
            put(table, two, batch="two")
    assert table.versions() == [1] and rows_of(table.read()) == [("a", "x", 1)]
    assert put(table, two, batch="two") == 2
    assert rows_of(table.read()) == [("a", "y", 2), ("b", "z", 1)]
    assert table.vacuum(keep=1) >= 1 and table.versions() == [2]
    assert rows_of(table.read()) == [("a", "y", 2), ("b", "z", 1)]


def test_two_writers_of_one_version(spark, table, monkeypatch):
    """The second of two runs that began from one version fails and publishes nothing."""
    put(table, batch(spark, ("a", "x", 1)))
    old = table.version()
    put(table, batch(spark, ("a", "y", 2)))
    monkeypatch.setattr(Snapshots, "version", lambda self, number=None: old)
    with pytest.raises(RuntimeError):
        put(table, batch(spark, ("a", "w", 3)))
    monkeypatch.undo()
    assert rows_of(table.read()) == [("a", "y", 2)]


def test_a_reader_keeps_its_version(spark, table):
    """What was read from a version stays what it was while later ones come."""
    put(table, batch(spark, ("a", "x", 1)))
    before = table.read()
    put(table, batch(spark, ("a", "y", 2)))
    assert rows_of(before) == [("a", "x", 1)]
