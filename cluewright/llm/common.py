"""What the operators of this subpackage share: tables, keys of texts, bounded sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch, shared_dir, stored  # noqa: F401

#: ASCII white space as the operators' contracts name it.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def digest(value: Column) -> Column:
    """16-byte key of a text or line, wide enough to stand for it at any size."""
    return F.unhex(F.md5(value))


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z alone. lower() is the faster way where a value has no other letters."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that an operator is about to make, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """batch with other values in a column whose field, nullability included, stays: all batches of a task need one schema."""
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), values)


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of 64-bit hashes as 2**bits flags, packed in uint8: a bounded and one-sided filter.

    The driver gets 2**bits / 64 rows at most, whatever the number of keys. A
    hash's low bits choose its flag, as callers select hashes by size.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = (
        keys.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    flags = np.zeros(1 << (bits - 6), np.int64)
    flags[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return flags.view(np.uint8)


def in_bitmap(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the set."""
    slot = h.astype(np.uint64) & np.uint64(8 * len(flags) - 1)
    return (flags[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
