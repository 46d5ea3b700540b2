"""Scans and sinks: cold Parquet, features, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, scans


def cold_scan(spark: SparkSession, pattern: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet files by glob. A Column predicate reaches the scan, as do the columns."""
    df = spark.read.parquet(pattern)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with bound parameters."""
    return spark.sql(sql, args=args)


def register(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Temporary views of the tables that are there; the names of those."""
    there = []
    for name in names:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
            there.append(name)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return there


def business_tables(spark: SparkSession, folder: str, names: list[str], to: str, database: str = "default") -> list[str]:
    """Catalogue tables with copies of the source tables, kept under `to`; the names of those that are there. A rerun replaces them."""
    there = []
    for name in register(spark, folder, names):
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        spark.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").option("path", f"{to}/{name}").saveAsTable(f"`{database}`.`{name}`")
        spark.catalog.dropTempView(name)
        there.append(name)
    return there


def put_features(known: DataFrame, new: DataFrame) -> DataFrame:
    """Features (subject, feature, value, version): the highest version of each stands."""
    return scans.latest(known.unionByName(new), ["subject", "feature"], ["version"])


def features_of(features: DataFrame, subject: str) -> DataFrame:
    return features.where(F.col("subject") == subject)


def write_edges(flow: DataFrame, path: str, modulus: int = 10000) -> None:
    graph.edges(flow, modulus).select("from_id", "to_id", "amount", "date").write.mode("overwrite").option("header", True).csv(path)


def write_bridges(flow: DataFrame, path: str, rows: int = 1000, modulus: int = 10000) -> None:
    graph.least_paths(flow, rows, modulus, loops=True).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
