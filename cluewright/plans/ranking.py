"""Ranks and exact samples over whole tables, without a task that has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

#: Hexadecimal digits of a key's hash that one histogram tells apart: 65,536 bins.
DIGITS = 4


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in order, a long from 1. Rows equal in order take neighbouring places.

    Rows are dealt into ranges of the order and written, so that their ranges
    stay what they are; each range is numbered by itself, from where those
    before it end. The driver gets one count for each range.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    starts = spark.createDataFrame(before, "__part int, __before long")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, place + F.col("__before")).drop("__part", "__before")


def least_hashes(rows: DataFrame, key: list[str], target: int) -> DataFrame:
    """The target rows of least md5 of key, ties by key.

    A histogram of the hashes' first digits tells up to which bin all rows are
    in, a second one does so within the bin at the border; only rows of one
    bin of that, a few in 2**32, are put in order.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat_ws("|", *key)))
    taken, near, left = F.lit(False), F.lit(True), target
    for level in range(2):
        bin_ = F.substring("__h", 1 + level * DIGITS, DIGITS)
        bins = sorted((r["b"], r["n"]) for r in hashed.where(near).groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        cut = None
        for b, n in bins:
            if n > left:
                cut = b
                break
            left -= n
        if cut is None:
            return hashed.where(taken | near).drop("__h")
        taken = taken | (near & (bin_ < cut))
        near = near & (bin_ == cut)
    border = hashed.where(near).orderBy("__h", *key).limit(left)
    return hashed.where(taken).unionByName(border).drop("__h")
