"""Reading loose files into the schema contract.

Readers are Spark's own wherever Spark has one. A file's columns are renamed
by alias, amounts and dates coerced, blank subjects dropped, and the file's
name kept with each row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import filled
from ..functions.schema import TYPE_HINTS, missing, renamed
from .partitioned import ROW, read_excel, read_sqlite
from .records import read_split_json, with_source_rows

LOG = "file string, format string, source_type string, rows long, columns array<string>, missing array<string>, status string, error string"
DATES = ["date"]
MARKS = "[,¥元]"
#: A JSON document of more bytes is read by many tasks.
SPLIT_BYTES = 64 << 20


def separator(sample: str) -> str:
    """The first of tab, semicolon, comma and bar that the sample has."""
    return next((s for s in "\t;,|" if s in sample), ",")


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    if sep is None:
        lines = spark.read.text(path).limit(20).collect()
        sep = separator("\n".join(r[0] or "" for r in lines)[:2048])
    return spark.read.option("header", True).option("sep", sep).csv(path)


def flattened(df: DataFrame) -> DataFrame:
    """Structs to dotted columns, arrays to indexed ones as far as the longest goes."""
    while True:
        nested = [f for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
        if not nested:
            return df
        arrays = [f.name for f in nested if isinstance(f.dataType, T.ArrayType)]
        longest = df.agg(*[F.max(F.size(f"`{c}`")) for c in arrays]).first() if arrays else []
        sizes = dict(zip(arrays, longest))
        columns = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                columns += [c[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
            elif f.name in sizes:
                columns += [F.get(c, i).alias(f"{f.name}[{i}]") for i in range(max(0, sizes[f.name] or 0))]
            else:
                columns.append(c)
        df = df.select(*columns)


def _bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def _first_letter(spark: SparkSession, path: str) -> str:
    """What a document begins with, read off its text up to the first brace that closes."""
    head = spark.read.option("lineSep", "}").text(path).limit(1).select(F.substring(F.ltrim(F.regexp_replace("value", "^[\ufeff\\s]+", "")), 1, 1).alias("c")).first()
    return head["c"] if head else ""


def read_json(spark: SparkSession, path: str, record_path: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of a JSON document, with _source_row. record_path names the array of records; without it a root of nested objects is searched for its one array of objects.

    A document of over split_bytes that is an array, or whose array is named
    in its root object, is read by many tasks; others are read whole by one.
    """
    if _bytes(spark, path) > split_bytes and "." not in (record_path or ""):
        if record_path is not None or _first_letter(spark, path) == "[":
            return flattened(read_split_json(spark, path, record_path))
    df = spark.read.option("multiLine", True).json(path)
    at = record_path

    def arrays(schema: T.StructType, prefix: str) -> list[str]:
        out = []
        for f in schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out.append(prefix + f.name)
            elif isinstance(f.dataType, T.StructType):
                out += arrays(f.dataType, f"{prefix}{f.name}.")
        return out

    if at is None and all(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in df.schema.fields):
        found = arrays(df.schema, "")
        at = found[0] if len(found) == 1 else None
    if at:
        df = df.select(F.col("_metadata.file_name").alias("_source_part"), F.posexplode(at).alias("i", "r")).select("r.*", "_source_part", (F.col("i") + 1).cast("long").alias(ROW))
        return flattened(df)
    return flattened(with_source_rows(df))


READERS = {".csv": read_csv, ".tsv": read_csv, ".txt": read_csv, ".xlsx": read_excel, ".json": read_json, ".sqlite": read_sqlite, ".db": read_sqlite, ".parquet": lambda spark, path: spark.read.parquet(path)}

#: Files whose reader does not number rows.
WITHOUT_ROWS = {".csv", ".tsv", ".txt", ".parquet"}


def coerced(df: DataFrame) -> DataFrame:
    """String columns with money marks become numbers if all their values do; dates are parsed, bad ones null. One pass decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        number = lambda c: F.regexp_replace(F.col(f"`{c}`"), MARKS, "").try_cast("double")
        facts = df.agg(
            *[F.max(F.col(f"`{c}`").rlike(MARKS)).alias(f"m{i}") for i, c in enumerate(texts)],
            *[F.max(F.col(f"`{c}`").isNotNull() & number(c).isNull()).alias(f"b{i}") for i, c in enumerate(texts)],
        ).first()
        money = {c for i, c in enumerate(texts) if facts[f"m{i}"] and not facts[f"b{i}"]}
        df = df.select(*[number(c).alias(c) if c in money else F.col(f"`{c}`") for c in df.columns])
    for c in DATES:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.try_to_timestamp(c))
    return df


def source_type(name: str, hints: dict[str, str] | None = None) -> str:
    """By the first keyword in the file's name."""
    return next((t for k, t in (hints or TYPE_HINTS).items() if k in name), "unknown")


def read_file(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, **options) -> DataFrame:
    """One file in the contract's names and types, with _source_file, _source_row and source_row_id.

    _source_row is the row's number in its file, part file or sheet, or its
    row id in a SQLite table; source_row_id is the file's name and these, so
    that an id leads back to one row and is the same on every run. Rows of a
    query have no number and no id. Rows without a subject are dropped last.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path}")
    df = READERS[suffix](spark, path, **options)
    name = os.path.basename(path.rstrip("/"))
    if suffix in WITHOUT_ROWS:
        df = with_source_rows(df)
    at = [F.lit(name), *[F.when(F.col(c) != name, F.col(c)) for c in ("_source_part", "_source_sheet") if c in df.columns]]
    row_id = F.concat_ws(":", *at, F.col(ROW).cast("string")) if ROW in df.columns else F.lit(None).cast("string")
    df = coerced(renamed(df.withColumn("source_row_id", row_id).drop("_source_part"), aliases))
    if "subject" in df.columns:
        df = df.where(filled(F.col("subject").cast("string")))
    return df.withColumn("_source_file", F.lit(name))


def ingest(spark: SparkSession, paths: list[str], to: str, hints: dict[str, str] | None = None) -> DataFrame:
    """Read files and write each as a partition of <to>/raw_<type>; the log has one row for each, failures included. A rerun replaces a file's partition and no other."""
    log = []
    for path in sorted(paths):
        name = os.path.basename(path)
        kind = source_type(name, hints)
        suffix = os.path.splitext(path)[1].lower()
        if suffix not in READERS:
            continue
        try:
            df = read_file(spark, path)
            texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c.replace(".", "_")) for c in df.columns if c != "_source_file"])
            texts.write.mode("overwrite").parquet(place := f"{to}/raw_{kind}/_source_file={name}")
            log.append((name, suffix[1:], kind, spark.read.parquet(place).count(), df.columns, missing(df, kind), "ok", None))
        except Exception as e:  # one bad file must not stop the others; the log tells of it
            log.append((name, suffix[1:], kind, 0, [], [], "failed", str(e)[:500]))
    return spark.createDataFrame(log, LOG)
