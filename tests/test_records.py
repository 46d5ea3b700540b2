from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cluewright.sources import records as R
from cluewright.sources.ingest import read_file, read_json

ODD = ['"', "\\", '\\"', "}", "{", "[", "]", ",", ":", "a", "é", "日", "\n", "},{", '"}', "\\\\", ""]


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, deep=0):
    kind = rng.randint(0, 7 if deep < 3 else 4)
    if kind < 3:
        return "".join(rng.choices(ODD, k=rng.randint(0, 6)))
    if kind < 5:
        return rng.choice([None, True, 1, -2.5])
    if kind < 6:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", 'k"', "}"]): value(rng, deep + 1) for _ in range(rng.randint(0, 3))}


def records(rng, n):
    return [{"id": i, **{k: value(rng) for k in ("x", "y") if rng.random() < 0.8}} if rng.random() < 0.95 else {} for i in range(n)]


def found(df):
    return [json.loads(r.text) for r in sorted(df.collect(), key=lambda r: r["_source_row"])]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("seed", range(3))
def test_array_in_splits(spark, tmp_path, small_splits, indent, seed):
    """Random records with braces, quotes and backslashes in strings, over splits smaller than some records."""
    rng = random.Random(seed)
    rows = records(rng, 60) + [{"long": "}" * 1500, "list": [{"q": '"'}] * 60}] + records(rng, 10)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2)), encoding="utf-8")
    got = R.json_records(spark, str(tmp_path / "a.json"))
    assert found(got) == rows
    assert sorted(r["_source_row"] for r in got.collect()) == list(range(1, len(rows) + 1))
    assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 10


@pytest.mark.parametrize("indent", [None, 1])
def test_named_array_in_splits(spark, tmp_path, small_splits, indent):
    """The array of one name, beside objects and other arrays at its depth, before and after."""
    rng = random.Random(7)
    rows = records(rng, 50)
    doc = {"meta": {"k": {"z": 1}, "list": [{"no": 1}]}, "others": [{"no": 2}] * 30, "single": {"no": 3}, "data": rows, "last": [{"no": 4}] * 20, "data2": {"data": [{"no": 5}]}}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=indent), encoding="utf-8")
    assert found(R.json_records(spark, str(tmp_path / "b.json"), "data")) == rows
    assert found(R.json_records(spark, str(tmp_path / "b.json"), "others")) == [{"no": 2}] * 30
    assert R.json_records(spark, str(tmp_path / "b.json"), "none").count() == 0


def test_same_rows_either_way(spark, tmp_path, small_splits):
    rows = [{"name": f"n{i}", "callee": None if i % 3 else 'x "}" y', "n": {"a": i, "tags": ["p", "q"][: i % 3]}} for i in range(80)]
    for doc, at in ((rows, None), ({"v": 1, "data": rows}, "data")):
        (tmp_path / "c.json").write_text(json.dumps(doc), encoding="utf-8")
        one, many = (read_json(spark, str(tmp_path / "c.json"), at, split_bytes=n) for n in (1 << 30, 10))
        columns = sorted(one.columns)
        assert sorted(many.columns) == columns
        assert sorted(map(str, many.select(*[f"`{c}`" for c in columns]).collect())) == sorted(map(str, one.select(*[f"`{c}`" for c in columns]).collect()))
    for text in ("[]", "[ {} ]", "", "[1, 2]"):
        (tmp_path / "d.json").write_text(text)
        assert R.json_records(spark, str(tmp_path / "d.json")).count() == text.count("{")


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"k{i},{i * 3}" for i in range(500)]
    (tmp_path / "t.csv").write_text("\n".join(["name,v", *lines]))
    spark.createDataFrame([(f"k{i}", i) for i in range(300)], "name string, v int").repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    seen = []
    for size in ("128mb", "700b", "97b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r["_source_row"]: (r.name, r.v) for r in R.with_source_rows(spark.read.option("header", True).csv(str(tmp_path / "t.csv"))).collect()}
            assert got == {i + 1: (f"k{i}", str(i * 3)) for i in range(500)}
            part = R.with_source_rows(spark.read.parquet(str(tmp_path / "t.parquet")))
            seen.append(sorted((r["_source_part"], r["_source_row"], r.name) for r in part.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] and len({s[:2] for s in seen[0]}) == 300


def test_ids_lead_back_to_rows(spark, tmp_path):
    (tmp_path / "流水.csv").write_text("主体,金额\n甲,1\n ,2\n乙,3\n")
    (tmp_path / "通话.json").write_text(json.dumps({"data": {"records": [{"姓名": "甲"}, {"姓名": "丙"}]}}))
    flow = read_file(spark, str(tmp_path / "流水.csv"))
    assert sorted((r.subject, r.source_row_id, r["_source_row"]) for r in flow.collect()) == [("乙", "流水.csv:3", 3), ("甲", "流水.csv:1", 1)]
    assert sorted((r.subject, r.source_row_id) for r in read_file(spark, str(tmp_path / "通话.json")).collect()) == [("丙", "通话.json:2"), ("甲", "通话.json:1")]
    assert flow.where(F.col("source_row_id").isNull()).count() == 0


def test_one_file_in_order_without_one_task_that_sorts_it(spark, tmp_path, monkeypatch):
    """The writer of the split JSON gets chunks of sorted ranges: no frame of all lines is brought to one partition."""
    from pyspark.sql import functions as F

    from cluewright import queries
    from cluewright.sources import records

    lines = spark.range(50_000, numPartitions=5).select((-F.col("id")).cast("double").alias("k"), F.concat(F.lit("line "), -F.col("id")).alias("value"))
    records.write_in_order(lines, "k", to := f"{tmp_path}/lines.txt")
    parts = [p for p in (tmp_path / "lines.txt").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1
    assert parts[0].read_text().splitlines() == [f"line {-i}" for i in range(49_999, -1, -1)]

    kind, asked = type(lines), []
    of = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: asked.append(a[0]) or of(self, *a))
    got = queries.QUERIES["json_split_ingest"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert 1 not in asked
