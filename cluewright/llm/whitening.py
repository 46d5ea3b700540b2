"""Whitening of embeddings by a tiled covariance.

Vectors become integers, whose sums are exact. Centred rows are cut into
blocks of rows and these into blocks of columns. Each pair of column blocks is
a tile of the covariance: its two blocks of one row block are shuffled to one
task and multiplied there, and the products are summed per tile. Only tiles,
whose number depends on the dimensions alone, reach the driver, where the
matrix is assembled and decomposed. The covariance of the whitened vectors is
taken in the same way, so that the error told is one of the result itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, without

#: What entries are scaled by and moved by to become integers, and components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Columns of a block, rows of a block, and rows of Arrow that are worked on at once.
TILE, BLOCK_ROWS = 32, 4096
#: Largest scaled entry that doubles hold as an exact integer. Beyond, an entry counts as not finite.
MOST = float(1 << 53)
#: An eigenvalue under this share of the largest is rounding: its direction has no variance to be whitened.
LEAST_SHARE = 1e-12
_OWN = ["n", "deviation", "whitened", "__x"]


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S; eigenvalues of their covariance from the largest on, their directions as columns, shares of the trace, and the error of the whitened covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def _finite(column: str) -> Column:
    scaled = lambda c: F.abs(c.cast("double") * SCALE) < F.lit(MOST)
    return F.coalesce(F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & scaled(c)), F.lit(False))


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors that are whole and finite, with __x, their integers; of vectors of several lengths those of the commonest (then the longest) stay."""
    rows = vectors.where(F.size(column) > 0).where(_finite(column))
    lengths = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return without(rows.where(F.size(column) == d), ["__x"]).withColumn("__x", x)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, s, n): exact sums of a task's rows by dimension."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            high = (x >> 26).sum(axis=0).tolist()  # in two parts, so that no sum of a batch overflows
            low = (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            own = [(a << 26) + b for a, b in zip(high, low)]
            total = own if total is None else [a + b for a, b in zip(total, own)]
            n += batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * len(total), pa.int64())], ["pos", "s", "n"])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    found = rows.select("__x").mapInArrow(_sums, "pos int, s decimal(38,0), n long").groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in sorted(found, key=lambda r: r["pos"])]


def _centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as an integer and the rest of it below 1, so that x - S/n loses no digits."""
    return np.array([t // n for t in total], np.int64), np.array([(t % n) / n for t in total])


def _centred(x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - centre[0]).astype(np.float64) - centre[1]


def _column_blocks(make, tile: int):
    """(b, i, j, first, block): each column block of a block of rows, once for each tile it is part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = make(_matrix(batch.column(0).slice(at, BLOCK_ROWS)))
                blocks = [np.ascontiguousarray(x[:, k : k + tile]).tobytes() for k in range(0, x.shape[1], tile)]
                for i, own in enumerate(blocks):  # a tile's two blocks meet under its key
                    keys = [(min(i, j), max(i, j), i <= j) for j in range(len(blocks))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([(part << 32) + number] * len(keys), pa.int64()),
                            pa.array([k[0] for k in keys], pa.int32()),
                            pa.array([k[1] for k in keys], pa.int32()),
                            pa.array([k[2] for k in keys]),
                            pa.array([own] * len(keys), pa.binary()),
                            pa.array([len(x)] * len(keys), pa.int32()),
                        ],
                        ["b", "i", "j", "left", "block", "rows"],
                    )
                number += 1

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, tile): the sum over a task's row blocks of the products of both column blocks."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, left, right, rows in zip(*(batch.column(k).to_pylist() for k in range(5))):
            a, b = (np.frombuffer(x, np.float64).reshape(rows, -1) for x in (left, right))
            made = a.T @ b
            total[i, j] = total[i, j] + made if (i, j) in total else made
    if total:
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))], ["i", "j", "tile"]
        )


def covariance(rows: DataFrame, make, n: int, d: int, tile: int = TILE) -> np.ndarray:
    """The covariance, divisor n, of d columns that `make` gives, centred, of each array of rows' __x.

    Row blocks are keys of their own, so that no key has more than two blocks
    and a vector that very many rows share is dealt out like any other. A task
    adds its products up before they are summed per tile.
    """
    blocks = rows.select("__x").mapInArrow(_column_blocks(make, tile), "b long, i int, j int, left boolean, block binary, rows int")
    pair = blocks.groupBy("b", "i", "j").agg(F.max(F.when(F.col("left"), F.col("block"))).alias("l"), F.max(F.when(~F.col("left") | (F.col("i") == F.col("j")), F.col("block"))).alias("r"), F.max("rows").alias("rows"))
    made = pair.select("i", "j", "l", "r", "rows").mapInArrow(_products, "i int, j int, tile array<double>")
    flat = made.select("i", "j", F.posexplode("tile").alias("p", "v")).groupBy("i", "j", "p").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    width = lambda k: min(tile, d - k * tile)
    for r in flat.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).getField("v").alias("tile")).collect():
        i, j = r["i"], r["j"]
        part = np.array(r["tile"]).reshape(width(i), width(j)) / n
        out[i * tile : i * tile + width(i), j * tile : j * tile + width(j)] = part
        out[j * tile : j * tile + width(j), i * tile : i * tile + width(i)] = part.T
    return out


def fitted(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Whitening:
    """The whitening of rows that integers() gave. Without rows, or variance, it has no components."""
    n, total = sums(rows)
    d = len(total)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    centre = _centre(n, total)
    v = covariance(rows, lambda x: _centred(x, centre), n, d, tile)
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    keep = np.flatnonzero(values > LEAST_SHARE * max(values[0], 0.0))[:components] if values[0] > 0 else np.zeros(0, int)
    values, directions = values[keep], np.ascontiguousarray(directions[:, keep])
    error = 0.0
    if len(keep):
        white = directions / np.sqrt(values)
        error = float(np.abs(covariance(rows, lambda x: _centred(x, centre) @ white, n, len(keep), tile) - np.eye(len(keep))).max())
    return Whitening(n, total, values, directions, values / np.trace(v) if len(keep) else values, error)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exact; null where that is no long."""
    bound = max(max(abs(n * int(m) - t) for m, t in zip(side, total)) for side in (x.min(axis=0), x.max(axis=0)))
    if len(total) * bound**2 < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        return ((n * x - np.array(total)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - t) ** 2 for a, t in zip(row, total)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _applied(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, white = _centre(w.n, w.sums), w.directions / np.sqrt(w.values)
        for batch in batches:
            at, rest = batch.schema.get_field_index("__x"), [c for c in batch.schema.names if c != "__x"]
            for top in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(top, BLOCK_ROWS)
                x = _matrix(part.column(at))
                y = _centred(x, centre) @ white
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in rest], pa.array([w.n] * len(x), pa.int64()), pa.array(_deviations(x, w.n, w.sums), pa.int64()), lists], [*rest, "n", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> tuple[DataFrame, Whitening]:
    """(vectors that are whole and finite, with n, deviation and whitened; the whitening).

    An entry c counts as the integer floor(64 c) + 1,000,000. Rows go whose
    vector is null or empty, has null or non-finite entries, entries of which
    64 c is 2**53 or more, or another length than most. whitened has as many
    entries as there are components: at most `components`, the vector's
    length, and the directions that have variance; rows that are all equal
    have none. deviation is null where it is no long. Repeated rows and ids
    count each time and are whitened each by itself; null ids stay. Columns of
    the names made here are replaced, others kept. An empty table gives an
    empty result.
    """
    rows = integers(vectors, column)
    w = fitted(rows, components, tile)
    names = [c for c in rows.columns if c.lower() not in _OWN]
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names], "n long, deviation long, whitened array<double>"])
    return rows.select(*[F.col(f"`{c}`") for c in names], "__x").mapInArrow(_applied(w), schema), w


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, w = whiten(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = spark.createDataFrame([(k, float(e)) for k, e in enumerate(w.explained)], "__k int, explained double")
    rows = out.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("__k", "whitened"))
    return rows.join(F.broadcast(explained), "__k").select(  # a row for each component
        "vec_id", (F.col("__k") + 1).alias("component"), "n", "deviation", "whitened", "explained", F.lit(w.identity_error).alias("identity_error")
    )
