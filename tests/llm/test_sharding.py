from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cluewright.llm import sharding as S


def facts(rows):
    size, count, slots, shard_of = defaultdict(int), defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        count[r.shard] += 1
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
    return size, count, slots, shard_of


def test_shards_have_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.op7_sharding(spark, "/root/testdata/sf0.01").collect()
    size, count, slots, _ = facts(rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    assert set(size) == set(range(16))
    mean = sum(size.values()) / 16
    largest = max(len(t) for t in texts.values())
    assert all(abs(x - mean) <= max(0.05 * mean, largest) for x in size.values()), dict(size)
    assert all(sorted(s) == list(range(count[k])) for k, s in slots.items())
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)


def test_equal_texts_stay_together_unless_they_overfill(spark):
    rare = [(i, f"text {i // 3} " * 20) for i in range(600)]
    out = S.shard_plan(spark.createDataFrame(rare, "doc_id long, text string"), 4).collect()
    assert all(len(x) == 1 for x in facts(out)[3].values())
    hot = [(i, "the same text " * 10) for i in range(500)] + [(1000 + i, f"other {i} " * 10) for i in range(500)]
    out = S.shard_plan(spark.createDataFrame(hot, "doc_id long, text string"), 4).collect()
    size = facts(out)[0]
    mean = sum(size.values()) / 4
    assert all(abs(x - mean) < 0.1 * mean for x in size.values()), dict(size)
    assert sum(len(x) > 1 for x in facts(out)[3].values()) <= 4


def brute_force(rows, shards):
    """(shard, slot) of each doc_id from one sorted list, where no text overfills a range."""
    rows, total = sorted(rows), sum(r[2] for r in rows)
    at, out, filled = 0, {}, defaultdict(int)
    for _, group in groupby(rows, key=lambda r: r[0]):
        group = list(group)
        size = sum(r[2] for r in group)
        shard = min(shards - 1, math.floor((at + size / 2) * shards / total))
        for r in group:
            out[r[3]] = (shard, filled[shard])
            filled[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("rows_per_range", [40, S.ROWS_PER_RANGE])
def test_against_one_sorted_list(spark, rows_per_range):
    docs = spark.createDataFrame([(i, f"text {i // 2} " * (i // 2 % 23 + 1)) for i in range(1500)], "doc_id long, text string")
    keys = docs.select(F.xxhash64("text", F.lit("text")), F.xxhash64("doc_id", F.lit("id")), (F.octet_length("text") + 1).cast("long"), "doc_id")
    expected = brute_force([tuple(r) for r in keys.collect()], 5)
    assert {r.doc_id: (r.shard, r.slot) for r in S.shard_plan(docs, 5, rows_per_range).collect()} == expected


def test_a_hot_text_is_cut_into_many_ranges(spark):
    docs = spark.createDataFrame([(i, "the same text " if i % 3 else f"other {i} ") for i in range(3000)], "doc_id long, text string")
    keys = docs.select(F.xxhash64("text", F.lit("text")).alias("h1"), F.xxhash64("doc_id", F.lit("id")).alias("h2"), F.lit(1).alias("size"))
    hot = keys.groupBy("h1").count().orderBy(F.desc("count")).first()["h1"]
    sample = [tuple(r) for r in keys.where("h2 % 3 = 0").collect()]
    cuts = sorted(S._splitters(sample, 64, 3000.0))
    fullest = lambda f: f.where(F.col("h1") == hot).groupBy("r", "q").count().agg(F.max("count")).first()[0]
    ranged = S._ranged(keys, cuts, 7)
    assert ranged.count() == 3000
    assert fullest(ranged) < 40 < fullest(S._ranged(keys, cuts, 0))
    assert ranged.groupBy("r").agg(F.countDistinct(F.col("h1") == hot).alias("n")).where("n > 1").count() == 0
    seen = [tuple(r) for r in ranged.orderBy("h1", "h2").select("r", "q").collect()]
    assert seen == sorted(seen)
    out = S.shard_plan(docs, 4, 50).collect()
    size, count, slots, _ = facts(out)
    assert sorted(r.doc_id for r in out) == list(range(3000))
    assert all(abs(x - sum(size.values()) / 4) < 0.05 * sum(size.values()) / 4 for x in size.values())
    assert all(sorted(s) == list(range(count[k])) for k, s in slots.items())


def test_odd_rows(odd, none):
    out = S.shard_plan(odd.withColumn("Shard", F.lit("mine")), 4).collect()
    assert len(out) == odd.count()
    slots = facts(out)[2]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert S.shard_plan(none, 4).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), i * 2) for i in range(200)], "doc_id long, text string, extra long")
    S.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.where("extra <> doc_id * 2").count() == 0
    assert back.select("shard").distinct().count() == 4
