from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from cluewright.llm import mixing as M
from tests.compare import check


def test_sql(spark, sf):
    check(spark, M.op9_mixing, M.SQL, sf)


def test_counts_follow_poisson(spark):
    docs = spark.createDataFrame([(i, "a", f"text {i:05d}") for i in range(4000)], "doc_id long, source string, text string")
    mean = 1.7
    got = Counter(r.doc_id for r in M.mix(docs, weights={"a": 1.0}, scale=mean).select("doc_id").collect())
    seen = Counter(got.get(i, 0) for i in range(4000))
    for k in range(5):
        p = math.exp(-mean) * mean**k / math.factorial(k)
        assert abs(seen[k] - 4000 * p) < 5 * math.sqrt(4000 * p)


def test_weights_are_reached(spark):
    rows = [(i, "ab"[i % 10 > 0], f"text {i:06d} " * 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = M.mix(docs, weights={"a": 3.0, "b": 1.0, "none": 5.0}).groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    n = {r.source: r.n for r in out}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.75) < 0.05


def test_high_means_do_not_underflow(spark):
    docs = spark.createDataFrame([(i, "a", f"t{i}") for i in range(50)], "doc_id long, source string, text string")
    n = M.mix(docs, weights={"a": 1.0}, scale=900.0).count()
    assert abs(n - 45000) < 6 * math.sqrt(45000)


def test_odd_rows(odd, none):
    out = M.mix(odd.withColumn("Copy", F.lit(1)), scale=5.0)
    assert [c.lower() for c in out.columns].count("copy") == 1
    rows = out.collect()
    assert {r.source for r in rows} >= {"a", None}
    twins = [r for r in rows if r.doc_id == 3 and r.text == "a" and r.source == "a"]
    assert len(twins) % 2 == 0  # the repeated row is drawn alike
    assert M.mix(none).count() == 0
    assert M.mix(odd, weights={}).count() == 0


def test_order_is_a_hash(spark):
    docs = spark.createDataFrame([(i, "a", f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    a = M.mix(docs, weights={"a": 1.0}, scale=2.0).orderBy("shuffle_key").select("doc_id", "copy").collect()
    b = M.mix(docs.repartition(7), weights={"a": 1.0}, scale=2.0).orderBy("shuffle_key").select("doc_id", "copy").collect()
    assert a == b and [r.doc_id for r in a] != sorted(r.doc_id for r in a)
