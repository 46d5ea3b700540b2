from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cluewright.llm import whitening as W


def by_hand(vectors, components=32):
    """(n, deviations, eigenvalues from the largest, directions, whitened) in plain numpy and Python integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, e, u, centred @ u / np.sqrt(e), e / np.trace(v)


def test_against_numpy(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, e, u, white, explained = by_hand([r.embedding for r in data])
    got: dict = {}
    for r in W.op12_whitening(spark, sf).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == [r.vec_id for r in data]
    k = len(e)
    assert k == 32
    mine = np.array([[got[r.vec_id][c + 1].whitened for c in range(k)] for r in data])
    for c in range(k):
        sign = np.sign(mine[:, c] @ white[:, c])
        assert np.allclose(mine[:, c], sign * white[:, c], atol=1e-7)
    for r, d in zip(data, deviation):
        one = got[r.vec_id][1]
        assert (one.n, one.deviation) == (n, d)
        assert one.identity_error < 1e-9
        assert np.allclose([got[r.vec_id][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert abs(mine.T @ mine / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("tile", [1, 3, 7, 64])
def test_tiles(spark, tile):
    """Any width of tiles, dividing the dimensions or not, gives the same; a third of the rows are one vector."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 10)) * np.arange(1, 11)
    data[::3] = data[0]
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<double>").repartition(5)
    out, w = W.whiten(docs, tile=tile)
    n, deviation, e, _, white, explained = by_hand(data)
    assert (w.n, len(w.values)) == (n, 10) and np.allclose(w.values, e) and np.allclose(w.explained, explained) and w.identity_error < 1e-9
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert [r.deviation for r in rows] == deviation
    assert np.allclose(np.abs([r.whitened for r in rows]), np.abs(white), atol=1e-7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-inf, 1.0]), (8, [1.0]), (9, [1e300, 1.0]), (10, [0.5, 7.25])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("N", F.lit("x")).withColumn("label", F.lit(None).cast("int"))
    out, w = W.whiten(docs)
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "10", "None"]
    assert [c.lower() for c in out.columns] == ["vec_id", "embedding", "label", "n", "deviation", "whitened"]
    n, deviation, e, _, _, _ = by_hand([[1, 2], [1, 2], [3, -1], [0.5, 7.25]])
    assert w.n == n == 4 and np.allclose(w.values, e) and sorted(r.deviation for r in got) == sorted(deviation)


def test_no_rows_no_variance(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    out, w = W.whiten(docs)
    assert [(r.n, r.deviation, r.whitened) for r in out.collect()] == [(3, 0, [])] * 3 and len(w.values) == 0
    out, w = W.whiten(docs.where("false"))
    assert out.count() == 0 and w.n == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    out, w = W.whiten(line)
    assert len(w.values) == 1 and np.isclose(w.explained[0], 1) and all(len(r.whitened) == 1 for r in out.collect())


def test_deviation_beyond_a_long(spark):
    docs = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in W.whiten(docs)[0].collect()}
    assert got[1] is None and got[2] is None and got[3] == by_hand([[1e9, 0], [-1e9, 0], [0, 1]])[1][2]
