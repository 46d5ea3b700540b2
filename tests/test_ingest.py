from __future__ import annotations

import json
import sqlite3

from cluewright.functions.schema import BANK_FLOW, align
from cluewright.sources import ingest as I
from cluewright.streaming import rollup


def files(spark, folder):
    (folder / "银行流水_2024Q1.csv").write_text("日期;主体;对方;金额\n2024-01-05;甲;乙;1,000,000\n2024-02-05;甲;丙;18,532\n2024-02-06; ;丙;5\n", encoding="utf-8")
    (folder / "通话记录.json").write_text(json.dumps({"data": {"records": [{"name": "甲", "callee": "乙", "count": 2, "tags": ["x", "y"]}, {"name": "丙", "callee": "乙", "count": 1, "tags": []}]}}), encoding="utf-8")
    with sqlite3.connect(folder / "工商注册.sqlite") as db:
        db.execute("create table companies (name text, rep text)")
        db.executemany("insert into companies values (?, ?)", [("A", "李"), ("B", None)])
    spark.createDataFrame([("p", "c", "2024-01-01")], "`项目` string, `公司` string, `日期` string").write.parquet(str(folder / "中标公告.parquet"))
    (folder / "工商信息.xlsx").write_bytes(b"not a workbook")
    (folder / "notes.md").write_text("skipped")
    return [str(p) for p in folder.iterdir()]


def test_ingest(spark, tmp_path):
    (src := tmp_path / "in").mkdir()
    log = {r.file: r for r in I.ingest(spark, files(spark, src), str(tmp_path / "out")).collect()}
    assert {f: (r.source_type, r.rows, r.status) for f, r in log.items()} == {
        "银行流水_2024Q1.csv": ("bank_flow", 2, "ok"),
        "通话记录.json": ("call_record", 2, "ok"),
        "工商注册.sqlite": ("business", 2, "ok"),
        "中标公告.parquet": ("bid_win", 1, "ok"),
        "工商信息.xlsx": ("business", 0, "failed"),
    }
    again = {r.file: r.rows for r in I.ingest(spark, [str(src / "银行流水_2024Q1.csv")], str(tmp_path / "out")).collect()}
    assert again == {"银行流水_2024Q1.csv": 2}
    back = spark.read.parquet(str(tmp_path / "out" / "raw_bank_flow"))
    assert back.count() == 2 and sorted(float(r.amount) for r in back.collect()) == [18532.0, 1000000.0]


def test_readers(spark, tmp_path):
    files(spark, tmp_path)
    flow = I.read_file(spark, str(tmp_path / "银行流水_2024Q1.csv"))
    assert dict(flow.dtypes)["amount"] == "double" and dict(flow.dtypes)["date"] == "timestamp"
    calls = I.read_file(spark, str(tmp_path / "通话记录.json"))
    assert {(r.subject, r.counterparty, r["tags[0]"], r["tags[1]"]) for r in calls.collect()} == {("甲", "乙", "x", "y"), ("丙", "乙", None, None)}
    firms = I.read_sqlite(spark, str(tmp_path / "工商注册.sqlite"), query="select rep from companies where rep is not null")
    assert [r.rep for r in firms.collect()] == ["李"]
    assert align(flow, BANK_FLOW).columns == ["date", "subject", "counterparty", "amount"]


def test_coercion_takes_a_column_or_leaves_it(spark):
    df = spark.createDataFrame([("1,5", "1,5", "7", "bad"), ("¥3元", "x", "8", "2024-01-01"), (None, None, None, None)], "a string, b string, c string, date string")
    out = I.coerced(df)
    assert [t for _, t in out.dtypes] == ["double", "string", "string", "timestamp"]
    assert sorted(r.a for r in out.collect() if r.a is not None) == [3.0, 15.0]


def test_separators():
    assert [I.separator(s) for s in ("a\tb;c", "a;b,c", "a,b|c", "a|b", "a")] == ["\t", ";", ",", "|", ","]


def test_stream(spark, tmp_path):
    rows = [(f"2024-0{m}-05", s, 10 * m) for m in (1, 2, 3) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "date string, subject string, amount long")
    place = lambda n: str(tmp_path / n)
    for part in (df.where("subject = 'a'"), df.where("subject = 'b'"), df.where("date < '2024-02'")):  # the last one is late
        part.coalesce(1).write.mode("append").parquet(place("in"))
        rollup.start_rollup(rollup.flow_stream(spark, place("in"), df.schema), place("out"), place("offsets")).awaitTermination()
    got = {(r.subject, r.period.month): (r.cnt, int(r.total)) for r in rollup.rollup(spark, place("out")).collect()}
    assert got == {(s, m): (2, 20) if m == 1 else (1, 10 * m) for s in "ab" for m in (1, 2, 3)}
