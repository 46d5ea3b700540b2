"""Sharding by sampled splitters: contiguous ranges of a content key with near-equal bytes.

The key is a hash of the text, then of the document id. A sample of keys,
drawn with chance in proportion to size, gives quantile splitters for many
fine ranges. The exact bytes and rows of the ranges come from one small
aggregate; ranges that came out too full are subdivided by splitters drawn
again within them. Ranges are cut further at equal steps of the hash, as many as the
rows need, so that a task's share does not grow with the table. Shards are then
runs of ranges, and where a shard's border falls inside a range, running sums
within that range settle it. Equal texts stay in one shard unless they alone
overfill a range. Only ids, sizes and hashes are shuffled, never texts, until
the records themselves are written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load, shared_dir, stored, text_of, without

SHARDS = 16
#: Fine ranges for each shard, and keys sampled for each range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 16, 24
#: A range with more than this many times its due is subdivided.
OVERFULL = 2.0
#: Rows that a range should have at most; beyond, it is cut at steps of the hash.
ROWS_PER_RANGE = 1 << 17
#: Leading bits of the hash by which splitters are looked up.
LOOKUP_BITS = 12
_LEAST = -(1 << 63)


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of the driver's rows, as a literal that the JVM reads: no Python worker takes part."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _drawn(rows: DataFrame, want: int) -> list[tuple]:
    """Keys drawn with chance min(1, want * size / total), by a hash of the row: the same in each run. About want rows."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(want / total))
    coin = (F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit("draw")), 11) / F.lit(float(1 << 53))).cast("double")
    return [tuple(r) for r in rows.where(coin < chance).select("h1", "h2", "size").collect()]


def _splitters(sample: list[tuple], want: int, total: float) -> set[tuple[int, int]]:
    """Quantiles of drawn keys. A rare text's border is moved to its first row, so that equal texts stay together; a text with several borders is cut between its rows, and off from its neighbours."""
    if not sample or not total:
        return set()
    rate = len(sample)  # a draw stands for one share of the sizes unless the record is larger than the share
    weights = [max(1.0, rate * s / total) for _, _, s in sample]
    keyed = sorted(zip(((a, b) for a, b, _ in sample), weights))
    step, out, run = sum(weights) / want, [], 0.0
    for key, w in keyed:
        run += w
        while run >= step * (len(out) + 1) and len(out) + 1 < want:
            out.append(key)
    often: dict[int, int] = {}
    for a, _ in out:
        often[a] = often.get(a, 0) + 1
    cuts = {(a, b) if often[a] > 1 else (a, _LEAST) for a, b in out}
    return cuts | {(x, _LEAST) for a, n in often.items() if n > 1 for x in (a, a + 1) if x < 1 << 63}


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]], steps: int) -> DataFrame:
    """rows with r, the number of cuts at or below the key, and q, the step within r: of h2 where r is part of one text, of h1 elsewhere. (r, q) ascends with the key.

    Cuts are looked up by the leading bits of h1 in a table of 2**LOOKUP_BITS
    rows, each with the few cuts of its stretch.
    """
    shift, base, table = 64 - LOOKUP_BITS, 0, []
    within: dict[int, list[tuple[int, int]]] = {}
    for a, b in cuts:
        within.setdefault(a >> shift, []).append((a, b))
    for stretch in range(-(1 << LOOKUP_BITS - 1), 1 << LOOKUP_BITS - 1):
        here = within.get(stretch, [])
        table.append({"__stretch": stretch, "__base": base, "__cuts": [{"a": a, "b": b} for a, b in here]})
        base += len(here)
    lookup = _table(rows.sparkSession, table, "__stretch: long, __base: int, __cuts: array<struct<a: long, b: long>>")
    key = F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"))
    out = rows.withColumn("__stretch", F.shiftright("h1", shift)).join(F.broadcast(lookup), "__stretch")
    out = out.withColumn("r", F.col("__base") + F.size(F.filter("__cuts", lambda c: c <= key))).drop("__stretch", "__base", "__cuts")
    if not steps:
        return out.withColumn("q", F.lit(0).cast("long"))
    inner = [{"r": i + 1} for i, (a, b) in enumerate(cuts) if cuts[i + 1 : i + 2] and cuts[i + 1][0] == a or b != _LEAST]
    marks = _table(rows.sparkSession, inner, "r: int").withColumn("__inner", F.lit(True))
    q = F.when(F.col("__inner"), F.shiftright("h2", 64 - steps)).otherwise(F.shiftright("h1", 64 - steps))
    return out.join(F.broadcast(marks), "r", "left").withColumn("q", q).drop("__inner")


def shard_plan(docs: DataFrame, shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard and slot.

    size is the text's UTF-8 bytes plus 1 (null counts as no bytes). Shards
    take near-equal sizes; a shard's border is off by at most half a group of
    equal texts, and a group that overfills a range is cut between its rows.
    Rows that agree in text and doc_id take neighbouring slots in any order.
    A null doc_id is a key like any other. An empty table has no rows.

    The driver holds a sample of fixed size and one sum for each range, of
    which there are about rows / rows_per_range. A group of equal texts that
    does not overfill a range is placed by one task, with less than
    OVERFULL / (RANGES_PER_SHARD * shards) of the bytes.
    """
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text_of()) + 1).cast("long").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
            F.xxhash64(text_of(), F.lit("text")).alias("h1"),
            F.xxhash64("doc_id", F.lit("id")).alias("h2"),
        ),
        "keys",
    )
    ranges = shards * RANGES_PER_SHARD
    whole = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = whole["b"] or 0
    steps = max(0, (whole["n"] // rows_per_range).bit_length())
    cuts = sorted(_splitters(_drawn(rows, ranges * SAMPLES_PER_RANGE), ranges, float(total)))
    ranged = _ranged(rows, cuts, 0)
    full = [x["r"] for x in ranged.groupBy("r").agg(F.sum("size").alias("b")).where(F.col("b") > OVERFULL * total / ranges).collect()]
    if full:
        inside = ranged.where(F.col("r").isin(full))
        part = float(inside.agg(F.sum("size")).first()[0])
        want = max(2, int(2 * part * ranges / total) + len(full))
        cuts = sorted(set(cuts) | _splitters(_drawn(inside, want * SAMPLES_PER_RANGE), want, part))
    ranged = _ranged(rows, cuts, steps)
    at, starts = 0, []
    for x in sorted(ranged.groupBy("r", "q").agg(F.sum("size").alias("b")).collect()):
        starts.append({"r": x["r"], "q": x["q"], "begin": at})
        at += x["b"]
    begin = _table(docs.sparkSession, starts, "r: int, q: long, begin: long")
    order = W.partitionBy("r", "q").orderBy("h1", "h2", "size", "text_crc32")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(begin), ["r", "q"]).withColumn("at", F.col("begin") + before).withColumn("place", F.row_number().over(order))
    group = W.partitionBy("r", "q", "h1")
    placed = placed.withColumn("at", F.min("at").over(group) + F.sum("size").over(group) / 2)
    shard = F.least(F.lit(shards - 1), F.floor(F.col("at") * F.lit(shards) / F.lit(float(max(total, 1))))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", "r", "q", "place", shard.alias("shard")), "placed")
    filled, offsets = {}, []
    for r, q, s, n, first in sorted(tuple(x) for x in placed.groupBy("r", "q", "shard").agg(F.count(F.lit(1)), F.min("place")).collect()):
        offsets.append({"r": r, "q": q, "shard": s, "o": filled.get(s, 0) - first})
        filled[s] = filled.get(s, 0) + n
    table = _table(docs.sparkSession, offsets, "r: int, q: long, shard: int, o: long")
    return placed.join(F.broadcast(table), ["r", "q", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("o")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs as one folder for each shard, ordered by slot. Needs unique ids."""
    plan = shard_plan(docs, shards).select("doc_id", "shard", "slot")
    out = without(docs, ["shard", "slot"]).join(plan, "doc_id")
    out.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return shard_plan(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
