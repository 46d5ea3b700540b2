from __future__ import annotations

import random

import pytest

from cluewright.plans.components import components


def by_hand(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def graphs():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(150)]  # a chain
    yield [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 160)]  # stars
    yield [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    yield [(7, 7), (1, 2), (2, 1), (1, 2)]


@pytest.mark.parametrize("task_edges", [1_000_000, 20])
@pytest.mark.parametrize("edges", list(graphs()), ids=["chain", "stars", "random", "loops"])
def test_least_vertex(spark, edges, task_edges):
    df = spark.createDataFrame([*edges, (None, 1), (5000, None)], "a long, b long")
    got = [tuple(r) for r in components(df, "a", "b", task_edges).collect()]
    assert len(got) == len(dict(got)) and dict(got) == by_hand(edges)


def test_names_and_empty(spark):
    df = spark.createDataFrame([("b", "é"), ("é", "Z"), ("x", "y")], "u string, v string")
    assert dict(map(tuple, components(df).collect())) == {"b": "Z", "é": "Z", "Z": "Z", "x": "x", "y": "x"}
    assert components(df.where("false")).count() == 0
    raw = spark.createDataFrame([(b"\xff", b"\x01"), (b"\x01", b"\x00\x02")], "u binary, v binary")
    assert {bytes(r.component) for r in components(raw).collect()} == {b"\x00\x02"}
