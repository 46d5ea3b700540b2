"""Connected components of an edge table.

Edges are contracted first: every task turns the edges it has, a bounded
number, into stars. Where one task had them all, that is the answer; beyond,
alternating large-star and small-star rounds settle it, in a number that grows
with the logarithm of the vertices. A round is aggregates and equi-joins only,
by sorting, as a file's size tells too little of what a broadcast would hold,
so a vertex of very many edges is split like any skewed join key, and no
component is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import scratch, stored

MOST_ROUNDS = 60
#: Edges that one task contracts.
TASK_EDGES = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least one that edges a[i] - b[i] reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) with v the least vertex that u reaches by the task's edges; each vertex is a u once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    n = table.num_rows
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[ends.indices.to_numpy()]
    names = ends.dictionary.take(pa.array(order))
    label = least_reached(at[:n], at[n:], len(order))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", task_edges: int = TASK_EDGES) -> DataFrame:
    """(vertex, component) for every vertex of the edges; component is the least vertex it reaches.

    Null ends and loops make no link; repeated edges and both directions are
    one link. A vertex that has loops alone is its own component. An empty
    table gives an empty result.
    """
    with scratch(edges.sparkSession):
        links = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"), "edges")
        tasks = -(-links.count() // task_edges)
        if tasks <= 1:
            return stored(links.coalesce(1).mapInArrow(_stars, links.schema).toDF("vertex", "component"), "components", result=True)
        links = stored(links.repartition(tasks).mapInArrow(_stars, links.schema), "stars")
        now, before = links.where("u <> v"), None
        for _ in range(MOST_ROUNDS):
            now = stored(_small_star(_large_star(now)), "stars")
            mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
            if mark == before:
                break
            before = mark
        else:
            raise RuntimeError("components did not settle")
        roots = links.select("u").distinct()
        out = roots.join(now.hint("merge"), "u", "left").select(F.col("u").alias("vertex"), F.coalesce("v", "u").alias("component"))
        return stored(out, "components", result=True)
