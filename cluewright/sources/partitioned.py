"""SQLite and Excel files as Spark data sources: many tasks read one file, each its own part, a batch of rows at a time.

A SQLite table is cut into ranges of its row ids, which its index finds, and
a condition is passed down to it; a workbook is cut into its sheets, which are
parsed as streams. The file is opened by each task where it runs: in place on
one machine, elsewhere as a copy that Spark hands to each executor once.
"""

from __future__ import annotations

import datetime
import os
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.storage import one_machine

#: Rows of a batch, and row ids of a part at least.
BATCH, PART_ROWS = 10_000, 20_000
#: A row's place in its source: its row id, or its number in the sheet.
ROW = "_source_row"


def _on_executors(spark: SparkSession, path: str) -> dict[str, str]:
    """Options that lead the driver and each task to the file."""
    url = urlparse(path)
    local = url.path if url.scheme == "file" else path
    if url.scheme in ("", "file") and one_machine(spark):
        return {"here": local, "name": ""}
    spark.sparkContext.addFile(path)
    return {"here": SparkFiles.get(os.path.basename(path)), "name": os.path.basename(path)}


def _found(options) -> str:
    return SparkFiles.get(options["name"]) if options.get("name") else options["here"]


def _batches(rows: Iterator[tuple], names: list[str], numbered: bool) -> Iterator[pa.RecordBatch]:
    """Batches of rows of texts; with numbered the last column is the row's number."""
    while some := list(islice(rows, BATCH)):
        columns = list(zip(*some))
        kinds = [pa.string()] * (len(names) - numbered) + [pa.int64()] * numbered
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _text(value) -> str | None:
    return None if value is None else value.decode(errors="replace") if isinstance(value, bytes) else str(value)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# ---- SQLite ----


def _quoted(name: str) -> str:
    return '"{}"'.format(name.replace('"', '""'))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.names = dict(options), [n for n in schema.names if n != ROW]

    def _source(self) -> str:
        return f"({self.options['query']})" if "query" in self.options else _quoted(self.options["table"])

    def partitions(self):
        """Ranges of row ids, or of a query's whole-number column; a table without row ids and any other query are one part."""
        by = self.options.get("by")
        if by is None:
            return [Range(None, None)]
        with _open(self.options["here"]) as db:
            low, high = db.execute(f"SELECT min({by}), max({by}) FROM {self._source()}").fetchone()
        if low is None:
            return [Range(None, None)]
        parts = max(1, min(int(self.options["parts"]), -(-(high - low + 1) // PART_ROWS)))
        cuts = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
        return [Range(None if not i else a, None if i == parts - 1 else b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def read(self, part: Range):
        where, values = [f"({w})" for w in [self.options.get("where")] if w], []
        for sign, bound in ((">=", part.low), ("<", part.high)):
            if bound is not None:
                where, values = [*where, f"{self.options['by']} {sign} ?"], [*values, bound]
        numbered = "query" not in self.options and self.options.get("by") == "rowid"
        columns = [*map(_quoted, self.names), *["rowid"] * numbered]
        sql = f"SELECT {', '.join(columns) or '1'} FROM {self._source()}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with _open(_found(self.options)) as db:
            rows = ((*map(_text, r[: len(self.names)]), *r[len(self.names) :]) for r in db.execute(sql, values))
            yield from _batches(rows, [*self.names, *[ROW] * numbered], numbered)


class SqliteSource(DataSource):
    """Options: here and name (of the file), table or query, by (what ranges are of), parts."""

    @classmethod
    def name(cls) -> str:
        return "cluewright_sqlite"

    def schema(self) -> T.StructType:
        source = SqliteReader(self.options, T.StructType())._source()
        with _open(self.options["here"]) as db:
            names = [d[0] for d in db.execute(f"SELECT * FROM {source} LIMIT 0").description]
        out = _strings(names)
        return out.add(ROW, T.LongType()) if "query" not in self.options and self.options.get("by") == "rowid" else out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, by: str | None = None, where: str | None = None, parts: int | None = None) -> DataFrame:
    """A table of a SQLite file, by default its first, or a query's rows, as texts.

    A table is read by ranges of its row ids, and has them as _source_row. Of
    a query `by` names a column of whole numbers to cut by; without it, and of
    a table without row ids, one task reads all, a batch at a time. `where` is
    a condition in SQLite's SQL that leaves rows out in the file. Spark's own
    filters are not passed down: it keeps those that a Python source took from
    one query for the next one of the same frame.
    """
    options = _on_executors(spark, path)
    with _open(options["here"]) as db:
        if query is None:
            found = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchone()
            options["table"] = table or (found[0] if found else "")
            try:
                db.execute(f"SELECT rowid FROM {_quoted(options['table'])} LIMIT 0")
                by = by or "rowid"
            except sqlite3.OperationalError as e:
                if "rowid" not in str(e):
                    raise
        else:
            options["query"] = query
    if where:
        options["where"] = where
    if by:
        options["by"] = by if by == "rowid" else _quoted(by)
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(**options, parts=str(parts or spark.sparkContext.defaultParallelism * 4)).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """df as a table of a new local SQLite file. The format has one writer; rows pass the driver one partition at a time."""
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(map(_quoted, df.columns))})")
        db.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))


# ---- Excel ----

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates or times.
_DATES = {*range(14, 23), *range(45, 48)}
_NOT_CODE = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


class Workbook:
    """The parts of an .xlsx file that rows of texts need."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        names = set(self.zip.namelist())
        read = lambda name: ElementTree.fromstring(self.zip.read(name)) if name in names else None
        book, links = read("xl/workbook.xml"), read("xl/_rels/workbook.xml.rels")
        target = {r.get("Id"): r.get("Target") for r in links}
        inside = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): inside(target[s.get(_LINK)]) for s in book.iter(f"{_MAIN}sheet")}
        about = book.find(f"{_MAIN}workbookPr")
        self.epoch = datetime.datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        styles = read("xl/styles.xml")
        codes = {} if styles is None else {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        used = None if styles is None else styles.find(f"{_MAIN}cellXfs")
        kinds = [] if used is None else [int(x.get("numFmtId", 0)) for x in used]
        self.dated = [k in _DATES or bool(re.search("[dmyhs]", _NOT_CODE.sub("", codes.get(k, "")), re.I)) for k in kinds]
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        self.shared.append(self._string(e))
                        e.clear()

    @staticmethod
    def _string(e: ElementTree.Element) -> str:
        """A text and its runs, without its reading aids."""
        return "".join(t.text or "" for x in e if x.tag != f"{_MAIN}rPh" for t in x.iter(f"{_MAIN}t"))

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            found = cell.find(f"{_MAIN}is")
            return None if found is None else self._string(found)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return str(v.text == "1")
        if kind == "n":
            style = int(cell.get("s", 0))
            if style < len(self.dated) and self.dated[style]:
                days = float(v.text)
                moment = self.epoch + datetime.timedelta(seconds=round(days * 86400))
                return str(moment.time()) if 0 <= days < 1 else str(moment)
            return str(float(v.text)) if re.search("[.eE]", v.text) else v.text
        return v.text

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number, {column: text}) of the rows that have values."""
        number = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "end" and e.tag == f"{_MAIN}row":
                    number = int(e.get("r", number + 1))
                    cells, at = {}, -1
                    for c in e.iter(f"{_MAIN}c"):
                        letters = re.match("[A-Z]*", c.get("r", ""))[0]
                        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else at + 1
                        if (value := self._value(c)) is not None:
                            cells[at] = value
                    if cells:
                        yield number, cells
                    e.clear()

    def header(self, sheet: str) -> dict[int, str]:
        """Column names of the first row that has values; empty ones are named by number, repeated ones numbered on."""
        first = next(self.rows(sheet), (0, {}))[1]
        out: dict[int, str] = {}
        for i in range(max(first, default=-1) + 1):
            name, k = first.get(i, f"Unnamed: {i}"), 0
            while name in out.values():
                k += 1
                name = f"{first.get(i)}.{k}"
            out[i] = name
        return out


class Sheet(InputPartition):
    def __init__(self, name: str):
        self.sheet = name


class ExcelReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.names = dict(options), schema.names

    def partitions(self):
        return [Sheet(s) for s in Workbook(self.options["here"]).sheets]

    def read(self, part: Sheet):
        book = Workbook(_found(self.options))
        at = {name: i for i, name in book.header(part.sheet).items()}
        fixed = {"_source_sheet": part.sheet}
        texts = [n for n in self.names if n != ROW]
        rows = ((*(fixed.get(n) or cells.get(at.get(n)) for n in texts), number) for number, cells in islice(book.rows(part.sheet), 1, None))
        yield from _batches(rows, [*texts, ROW], True)


class ExcelSource(DataSource):
    """Options: here and name, of the file."""

    @classmethod
    def name(cls) -> str:
        return "cluewright_excel"

    def schema(self) -> T.StructType:
        book = Workbook(self.options["here"])
        names = dict.fromkeys(n for s in book.sheets for n in book.header(s).values())
        return _strings([*names, "_source_sheet"]).add(ROW, T.LongType())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ExcelReader(self.options, schema)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of an .xlsx workbook as texts, with _source_sheet and _source_row, one task a sheet. The first row of a sheet names its columns; a column that a sheet lacks is null there."""
    spark.dataSource.register(ExcelSource)
    return spark.read.format(ExcelSource.name()).options(**_on_executors(spark, path)).load()
