from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cluewright.operators import graph

FLOW = "subject string, counterparty string, amount double, date string"


def flow_of(spark, rows):
    return spark.createDataFrame(rows, FLOW).repartition(3)


def paths_by_hand(rows, loops):
    out = []
    for s, m, x, _ in rows:
        for m2, d, y, _ in rows:
            if m is not None and m == m2 and None not in (s, d) and s != d and (loops or (s != m and m != d)):
                out.append((s, m, d, x, y))
    return sorted(out)


def some(n, names, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([*names, "hub", "hub", "hub", None])
    return [(pick(), pick(), float(rng.randint(1, 9)), "2024-01-01") for _ in range(n)]


@pytest.mark.parametrize("loops", [False, True])
@pytest.mark.parametrize("cell", [3, 4096])
def test_bridges_through_a_hub(spark, monkeypatch, loops, cell):
    """Cells of three edges and of many give the paths of a plain double loop, with parallel edges, loops and nulls."""
    monkeypatch.setattr(graph, "CELL", cell)
    rows = some(200, [f"n{i}" for i in range(12)], cell)
    got = sorted(tuple(r) for r in graph.bridges(flow_of(spark, rows), loops=loops).collect())
    assert got == paths_by_hand(rows, loops)


@pytest.mark.parametrize("loops", [False, True])
@pytest.mark.parametrize("k", [1, 7, 150, 100_000])
def test_least_paths(spark, loops, k):
    for seed in range(2):
        rows = some(90, [f"n{i}" for i in range(9)], seed)
        got = [tuple(r) for r in graph.least_paths(flow_of(spark, rows), k, loops=loops).collect()]
        assert got == paths_by_hand(rows, loops)[:k]
    assert graph.least_paths(flow_of(spark, []), k).count() == 0


def test_export_of_a_large_hub(spark):
    """A hub of 100,000 edges in and as many out has 10**10 paths; the first 1000 of them are found without these."""
    n = 100_000
    both = spark.range(n).select(F.format_string("s%06d", "id").alias("subject"), F.lit("hub").alias("counterparty"), F.col("id").cast("double").alias("amount"), F.lit("2024-01-01").alias("date"))
    both = both.union(spark.range(n).select(F.lit("hub"), F.format_string("t%06d", "id"), F.col("id").cast("double"), F.lit("2024-01-01")))
    got = [tuple(r) for r in graph.least_paths(both, 1000).collect()]
    assert got == [("s000000", "hub", f"t{i:06d}", 0.0, float(i)) for i in range(1000)]


def test_reach_of_many_starts(spark):
    """More starts than a long has bits, among them unknown and null ones, against a walk from each."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(150)]
    rows = [(rng.choice(names), rng.choice(names), 1.0, "2024-01-01") for _ in range(260)] + [("n0", None, 1.0, ""), (None, "n1", 1.0, "")]
    after: dict = {}
    for s, t, _, _ in rows:
        if s and t:
            after.setdefault(s, set()).add(t)
    want = set()
    for start in names[:140]:
        front, seen = {start}, set()
        for hop in (1, 2, 3):
            front = {t for x in front for t in after.get(x, ())} - seen
            seen |= front
            want |= {(start, hop, t) for t in front}
    starts = spark.createDataFrame([(x,) for x in [*names[:140], "nobody", None, "n3"]], "name string")
    got = [tuple(r) for r in graph.reach(flow_of(spark, rows), starts, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.reach(flow_of(spark, rows), starts.where("false"), 2).count() == 0


@pytest.mark.parametrize("side, few", [(7, 0), (7, 30), (1000, 0), (1000, 10**9)])
def test_totals_are_those_of_the_paths(spark, side, few):
    """A hub's pairs are counted in cells and buckets of days; what they come to is what the listed paths do."""
    rng = random.Random(5)
    pick = lambda: rng.choice(["a", "b", "c", "d", "hub", "hub", None])
    rows = [(pick(), pick(), rng.choice([None, *range(-3, 60)]), rng.choice([None, *[f"2024-0{m}-{d:02d}" for m in (1, 2, 3) for d in range(1, 29, 3)]])) for _ in range(300)]
    flow = flow_of(spark, [(s, c, None if x is None else x / 4, d) for s, c, x, d in rows])
    for loops in (True, False):
        paths = graph.bridges(flow, within_days=10, least_ratio=0.5, loops=loops)
        want = paths.agg(F.count(F.lit(1)).alias("paths"), F.sum(F.col("amount_out").cast("decimal(18,2)")).alias("total")).first()
        got = graph.bridge_totals(flow, 10, 0.5, loops=loops, side=side, few=few).first()
        assert got.paths == want.paths > 0 and got.total == want.total
    none = graph.bridge_totals(flow.where("false"), 10, 0.5, side=side, few=few).first()
    assert (none.paths, none.total) == (0, None)
