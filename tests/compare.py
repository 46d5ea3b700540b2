"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pyarrow as pa

DATA = "/root/testdata"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r)) if columns else []


def kind(t: pa.DataType) -> str:
    """Types as far as they matter here: DuckDB's and Spark's strings and times have different widths."""
    if pa.types.is_string(t) or pa.types.is_large_string(t) or pa.types.is_string_view(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def schema(table: pa.Table) -> dict[str, str]:
    return {f.name: kind(f.type) for f in sorted(table.schema, key=lambda f: f.name)}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def check(spark, query, sql: str, folder: str) -> None:
    """The query's rows, names and types are those of its SQL."""
    got = query(spark, folder).toArrow()
    want = database(folder).sql(sql).to_arrow_table()
    assert schema(got) == schema(want)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
