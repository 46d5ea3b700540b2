from __future__ import annotations

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from cluewright.sources import partitioned as P
from cluewright.sources.ingest import read_file


@pytest.fixture
def ledger(tmp_path):
    path = str(tmp_path / "流水.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table flow (主体 text, amount, note)")
        db.executemany("insert into flow values (?, ?, ?)", [(f"s{i % 7}" if i % 11 else None, i if i % 2 else i + 0.5, b"x" if i % 5 == 0 else None) for i in range(100_000)])
        db.execute("create table pairs (a text, b integer, primary key (a, b)) without rowid")
        db.executemany("insert into pairs values (?, ?)", [("p", i) for i in range(10)])
        db.execute("create table empty_one (a text)")
    return path


def test_a_table_is_read_by_many_tasks(spark, ledger):
    df = P.read_sqlite(spark, ledger)
    assert df.columns == ["主体", "amount", "note", "_source_row"] and df.rdd.getNumPartitions() == 5
    assert df.select(F.spark_partition_id()).distinct().count() == 5
    rows = sorted(df.collect(), key=lambda r: r["_source_row"])
    assert [r["_source_row"] for r in rows] == list(range(1, 100_001))
    assert [tuple(r)[:3] for r in rows[:2]] == [(None, "0.5", "x"), ("s1", "1", None)]


def test_conditions_reach_the_file(spark, ledger):
    where = "\"主体\" = 's3' and note is not null or amount = -1"
    reader = P.SqliteReader({"here": ledger, "table": "flow", "by": "rowid", "parts": "2", "where": where}, P.read_sqlite(spark, ledger).schema)
    want = sum(i % 7 == 3 and i % 11 > 0 and i % 5 == 0 for i in range(100_000))
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == want
    df = P.read_sqlite(spark, ledger, where=where)
    assert df.count() == want and df.where("amount = '12.5'").count() == 0 and df.where("note = 'x' or note is null").count() == want


def test_queries_and_tables_without_row_ids(spark, ledger):
    pairs = P.read_sqlite(spark, ledger, table="pairs")
    assert pairs.columns == ["a", "b"] and sorted(int(r.b) for r in pairs.collect()) == list(range(10))
    assert P.read_sqlite(spark, ledger, table="empty_one").count() == 0
    whole = P.read_sqlite(spark, ledger, query="select amount * 2 as twice, rowid as k from flow where note is not null")
    cut = P.read_sqlite(spark, ledger, query="select amount * 2 as twice, rowid as k from flow where note is not null", by="k")
    assert cut.rdd.getNumPartitions() == 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 20_000
    with pytest.raises(sqlite3.OperationalError):
        P.read_sqlite(spark, ledger, table="no such table")


def workbook(path, sheets, shared, styles="", extra=""):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}">{extra}<sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="171" formatCode="0&quot; d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_sheets_are_parts(spark, tmp_path):
    shared = ["<t>主体</t>", "<t>金额</t>", "<r><t>张</t></r><r><t>三</t></r><rPh sb='0' eb='1'><t>zhang</t></rPh>", "<t>日期</t>", "<t xml:space='preserve'> 李 </t>"]
    s = lambda at, i: f'<c r="{at}" t="s"><v>{i}</v></c>'
    one = f'<row r="2">{s("A2", 0)}{s("B2", 1)}{s("D2", 3)}{s("E2", 1)}</row><row r="3">{s("A3", 2)}<c r="B3"><v>1000000</v></c><c r="D3" s="1"><v>45292</v></c><c r="E3" t="b"><v>1</v></c></row><row r="4"/><row r="7">{s("A7", 4)}<c r="B7"><v>1.50</v></c><c r="D7" s="2"><v>45292.25</v></c><c r="E7" t="e"><v>#N/A</v></c></row>'
    two = f'<row>{s("", 0)}<c t="inlineStr"><is><t>其他</t></is></c></row><row><c t="str"><v>王五</v></c><c s="3"><v>3</v></c></row>'
    workbook(tmp_path / "银行流水.xlsx", {"一": one, "二": two, "空": ""}, shared)
    df = P.read_excel(spark, str(tmp_path / "银行流水.xlsx"))
    assert df.columns == ["主体", "金额", "Unnamed: 2", "日期", "金额.1", "其他", "_source_sheet", "_source_row"] and df.rdd.getNumPartitions() == 3
    got = sorted(map(tuple, df.collect()), key=lambda r: (r[6], r[7]))
    assert got == [
        ("张三", "1000000", None, "2024-01-01 00:00:00", "True", None, "一", 3),
        (" 李 ", "1.5", None, "2024-01-01 06:00:00", None, None, "一", 7),
        ("王五", None, None, None, None, "3", "二", 2),
    ]
    flow = read_file(spark, str(tmp_path / "银行流水.xlsx"))
    assert {"subject", "amount", "date", "_source_file"} <= set(flow.columns) and dict(flow.dtypes)["date"] == "timestamp"


def test_written_and_read(spark, tmp_path):
    df = spark.range(5).select("id", F.when(F.col("id") > 2, F.concat(F.lit("n'\""), "id")).alias('odd "name"'))
    P.write_sqlite(df, str(tmp_path / "x.db"), 'a "t"')
    back = P.read_sqlite(spark, str(tmp_path / "x.db"))
    assert sorted((int(r[0]), r[1]) for r in back.collect()) == sorted(map(tuple, df.collect()))
