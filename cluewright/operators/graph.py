"""Paths in a transfer graph, as joins over its edges."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import round_amount
from ..plans.meetings import _groups as runs
from ..plans.ranking import ranked
from ..plans.storage import stored

#: Edges on a side of a cell of a heavy node's grid, about, and heavy nodes that are broadcast at most.
CELL, BROADCAST_NODES = 4096, 500_000
#: Pairs of a bridge and window up to which they are joined to be counted, edges on a side of a cell beyond, and those of a sum.
FEW, SIDE, STEP = 4096, 1 << 16, 1 << 14
PATH = ["source", "bridge", "dest", "amount_in", "amount_out"]


def nodes(flow: DataFrame) -> DataFrame:
    """Distinct names of both ends."""
    both = flow.select(F.col("subject").alias("name")).union(flow.select(F.col("counterparty").alias("name")))
    return both.where("name is not null").distinct()


def edges(flow: DataFrame, modulus: int | None = None) -> DataFrame:
    """(from_id, to_id, amount, date), parallel edges kept; with modulus of round amounts only."""
    rows = flow if modulus is None else flow.where(round_amount(F.col("amount"), modulus))
    return rows.select(F.col("subject").alias("from_id"), F.col("counterparty").alias("to_id"), "amount", F.to_date("date").alias("date"))


def _legs(flow: DataFrame, modulus: int | None, loops: bool) -> tuple[DataFrame, DataFrame]:
    e = edges(flow, modulus).where("from_id is not null and to_id is not null")
    if not loops:  # before any join: these rows would only be shuffled to be dropped
        e = e.where("from_id <> to_id")
    a = e.select(F.col("from_id").alias("source"), F.col("to_id").alias("bridge"), F.col("amount").alias("amount_in"), F.col("date").alias("date_in"))
    return a, e.select(F.col("from_id").alias("bridge"), F.col("to_id").alias("dest"), F.col("amount").alias("amount_out"), F.col("date").alias("date_out"))


def _gridded(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both legs with the keys they meet by: the bridge, and for a heavy one a cell of its grid.

    A node's edges are counted. Where there are over CELL on a side, they are
    dealt by hash into parts of about CELL; an edge in goes to every part of
    the edges out and the other way round, so that each pair meets in one cell.
    """
    into = a.groupBy("bridge").agg(F.count(F.lit(1)).alias("i"))
    out = b.groupBy("bridge").agg(F.count(F.lit(1)).alias("o"))
    parts = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    heavy = stored(into.join(out, "bridge").where(F.greatest("i", "o") > CELL).select("bridge", parts("i").alias("ins"), parts("o").alias("outs")), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_NODES else heavy

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[c for c in df.columns if c != "bridge"]), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return df.join(heavy, "bridge", "left").select(*df.columns, part.alias(mine), every.alias(theirs))

    return dealt(a, "ins", "outs", "cell_in", "cell_out"), dealt(b, "outs", "ins", "cell_out", "cell_in"), ["bridge", "cell_in", "cell_out"]


def bridges(flow: DataFrame, modulus: int | None = None, within_days: int | None = None, least_ratio: float | None = None, loops: bool = False) -> DataFrame:
    """(source, bridge, dest, amount_in, amount_out): two transfers that meet in the middle, each pair of parallel edges counted.

    All three ends differ; with loops only the outer two do. within_days asks
    for the second leg on or up to so many days after the first, least_ratio
    for so much of the first amount in the second. A node of very many edges
    is a grid of join keys, so that no task makes all its paths.
    """
    a, b, keys = _gridded(*_legs(flow, modulus, loops))
    paths = a.join(b, keys).where("source <> dest")
    if within_days is not None:
        paths = paths.where(F.datediff("date_out", "date_in").between(0, within_days))
    if least_ratio is not None:
        paths = paths.where(F.col("amount_out") >= least_ratio * F.col("amount_in"))
    return paths.select("source", "bridge", "dest", "amount_in", "amount_out")


def _sums(keys: int, within: int):
    """(paths, total) of cells: for each edge in, how many edges out are in its window and large enough, and their cents, by search in sorted amounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, keys):
            side, day, amount, cents = (table.column(c).to_numpy() for c in ("side", "day", "amount", "cents"))
            ins, outs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            ins, outs = ins[np.argsort(day[ins], kind="stable")], outs[np.argsort(amount[outs], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, np.diff(day[ins]) != 0, True]) if len(ins) else []
            paths = total = 0
            for lo, hi in zip(cuts, cuts[1:]):
                d = day[ins[lo]]
                near = outs[(day[outs] >= d) & (day[outs] <= d + within)]
                # Cents in two halves, so that no sum of a step leaves 64 bits.
                upper, lower = (np.r_[0, np.cumsum(x[::-1])][::-1] for x in (cents[near] >> 30, cents[near] & ((1 << 30) - 1)))
                for at in range(lo, hi, STEP):
                    first = np.searchsorted(amount[near], amount[ins[at : min(hi, at + STEP)]])
                    paths += int((len(near) - first).sum())
                    total += (int(upper[first].sum()) << 30) + int(lower[first].sum())
            yield pa.RecordBatch.from_arrays([pa.array([paths], pa.int64()), pa.array([Decimal(f"{total}e-2")], pa.decimal128(38, 2))], ["paths", "total"])

    return run


def _totals(a: DataFrame, b: DataFrame, keys: list[str], within: int, side: int, few: int) -> DataFrame:
    """Rows (paths, total) to be added up: pairs of edges in (keys, name, day, amount, the least that goes on) and out (keys, name, day, amount, cents) that agree on keys. name only deals edges out.

    Days are dealt into buckets as wide as the window; an edge out goes to the
    bucket of its day and the one before, so that a pair meets once. Buckets of
    many pairs are grids of about `side` edges a side, whose pairs are counted.
    """
    bucket = lambda back: F.floor((F.col("day") - back * (within + 1)) / (within + 1)).alias("bucket")
    a = a.select(*keys, bucket(0), "name", "day", "amount")
    b = b.select(*keys, F.explode(F.array(bucket(0), bucket(1))).alias("bucket"), "name", "day", "amount", "cents")
    met = [*keys, "bucket"]
    i, o = (df.groupBy(*met).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "i"), (b, "o")))
    parts = lambda c: F.ceil(F.col(c) / side).cast("int")
    heavy = stored(i.join(o, met).where(F.col("i") * F.col("o") > few).select(*met, "i", "o", parts("i").alias("ins"), parts("o").alias("outs")), "heavy")
    out = b.select(*met, F.col("day").alias("day_out"), F.col("amount").alias("amount_out"), "cents")
    pairs = a.join(heavy, met, "left_anti").join(out, met).where(f"day_out between day and day + {within} and amount_out >= amount")
    light = pairs.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(F.col("cents").cast("decimal(20,0)")) / 100, F.lit(0)).cast("decimal(38,2)").alias("total"))
    rows = heavy.agg(F.sum(F.expr("cast(i as double) * outs + cast(o as double) * ins"))).first()[0]
    if not rows:
        return light
    tasks = int(max(1, min(rows // 4096, 4 * int(heavy.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def dealt(df: DataFrame, number: int, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        cents = F.col("cents") if "cents" in df.columns else F.lit(0).cast("long").alias("cents")
        rows = df.join(heavy, met).withColumn(mine, F.pmod(F.xxhash64("name", "day", "amount"), F.col(own)).cast("int"))
        rows = rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select(*met, "cell_in", "cell_out", F.lit(number).alias("side"), "day", "amount", cents)

    cell = [*met, "cell_in", "cell_out"]
    both = dealt(a, 0, "ins", "outs", "cell_in", "cell_out").unionByName(dealt(b, 1, "outs", "ins", "cell_out", "cell_in"))
    return light.unionByName(both.repartition(tasks, *cell).sortWithinPartitions(*cell).mapInArrow(_sums(len(cell), within), "paths long, total decimal(38,2)"))


def bridge_totals(flow: DataFrame, within_days: int, least_ratio: float, modulus: int | None = None, loops: bool = False, side: int = SIDE, few: int = FEW) -> DataFrame:
    """One row, paths and total: the number of bridges() and the sum of their amount_out, without listing any.

    Pairs of edges that meet at a bridge are counted, and those that return to
    their source, which agree on one more key, are counted in the same way and
    taken off. Amounts are summed as cents, exactly.
    """
    a, b = _legs(flow, modulus, loops)
    a = a.where("amount_in is not null and date_in is not null").select("source", "bridge", F.col("source").alias("name"), F.unix_date("date_in").alias("day"), (F.lit(least_ratio) * F.col("amount_in")).cast("double").alias("amount"))
    b = b.where("amount_out is not null and date_out is not null").select("dest", "bridge", F.col("dest").alias("name"), F.unix_date("date_out").alias("day"), F.col("amount_out").cast("double").alias("amount"), (F.col("amount_out").cast("decimal(18,2)") * 100).cast("long").alias("cents"))
    every = _totals(a, b, ["bridge"], within_days, side, few)
    back = _totals(a.withColumnRenamed("source", "end"), b.withColumnRenamed("dest", "end"), ["bridge", "end"], within_days, side, few)
    both = every.unionByName(back.select((-F.col("paths")).alias("paths"), (-F.col("total")).cast("decimal(38,2)").alias("total")))
    out = both.agg(F.coalesce(F.sum("paths"), F.lit(0)).alias("paths"), F.sum("total").alias("total"))
    return out.select("paths", F.when(F.col("paths") > 0, F.col("total")).alias("total"))


def least_paths(flow: DataFrame, rows: int, modulus: int | None = None, loops: bool = False) -> DataFrame:
    """The first `rows` of bridges() in order of source, bridge, dest, amount_in and amount_out, without listing the others.

    How many paths begin with a pair (source, bridge) is a product of counts:
    its edges in, times the bridge's edges out but for those that return. The
    first pairs that have enough of them are taken, `rows` at most. Of a
    pair's edges in only the `rows` least can be in the result, and so of its
    edges out; all taken pairs but the last have under `rows` paths together.
    """
    a, b = _legs(flow, modulus, loops)
    n = F.count(F.lit(1))
    back = b.groupBy("bridge", F.col("dest").alias("source")).agg(n.alias("r"))
    pairs = a.groupBy("source", "bridge").agg(n.alias("i")).join(b.groupBy("bridge").agg(n.alias("o")), "bridge").join(back, ["bridge", "source"], "left")
    counted = pairs.withColumn("paths", F.col("i") * (F.col("o") - F.coalesce("r", F.lit(0)))).where("paths > 0")
    first = stored(counted.orderBy("source", "bridge").limit(rows).select("source", "bridge", "paths"), "pairs")
    before = F.coalesce(F.sum("paths").over(W.orderBy("source", "bridge").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over `rows` pairs
    taken = F.broadcast(stored(first.select("source", "bridge", before.alias("before")).where(F.col("before") < rows).select("source", "bridge"), "pairs"))
    rank = lambda *order: F.row_number().over(W.partitionBy("source", "bridge").orderBy(*order))
    ins = a.join(taken, ["source", "bridge"]).select("source", "bridge", "amount_in").withColumn("__k", rank("amount_in")).where(F.col("__k") <= rows)
    outs = b.join(taken, "bridge").where("dest <> source").select("source", "bridge", "dest", "amount_out").withColumn("__k", rank("dest", "amount_out")).where(F.col("__k") <= rows)
    paths = ins.drop("__k").join(outs.drop("__k"), ["source", "bridge"])
    return paths.select(*PATH).orderBy(*PATH).limit(rows)


def bridge_nodes(flow: DataFrame, modulus: int | None = None) -> DataFrame:
    """(bridge, paths) without listing paths: in- and outflows of a node are counted by neighbour, and returns taken off."""
    e = edges(flow, modulus).where("from_id <> to_id")
    into = e.groupBy(F.col("to_id").alias("bridge"), F.col("from_id").alias("other")).agg(F.count(F.lit(1)).alias("i"))
    out = e.groupBy(F.col("from_id").alias("bridge"), F.col("to_id").alias("other")).agg(F.count(F.lit(1)).alias("o"))
    both = into.join(out, ["bridge", "other"], "full_outer").select("bridge", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"))
    paths = F.sum("i") * F.sum("o") - F.sum(F.col("i") * F.col("o"))
    return both.groupBy("bridge").agg(paths.alias("paths")).where("paths > 0")


def neighbours(flow: DataFrame, start: str, hops: int) -> DataFrame:
    """Distinct names that walks of 1 to hops edges from start reach; start itself if a cycle returns to it."""
    e = stored(flow.select("subject", "counterparty").where("subject is not null and counterparty is not null").distinct(), "edges")
    front = e.where(F.col("subject") == start).select(F.col("counterparty").alias("name"))
    seen = front
    for _ in range(hops - 1):
        front = stored(e.join(front, e.subject == front.name, "left_semi").select(F.col("counterparty").alias("name")).distinct().join(seen, "name", "left_anti"), "front")
        seen = seen.union(front)
    return seen.distinct()


def reach(flow: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, hop, name): what walks of up to `hops` edges from each start reach, with the fewest hops it takes. starts has name.

    Starts are numbered and 64 of them are the bits of one long, so that an
    edge passes all their fronts on at once: each hop is one join with the
    edges and one bit_or by node, whatever the number of starts in a block. A
    start is reached by a cycle only. Starts that have no edges reach nothing.
    """
    e = stored(flow.select("subject", "counterparty").where("subject is not null and counterparty is not null").distinct(), "edges")
    at = F.col("rank") - 1
    numbered = ranked(starts.where("name is not null").select("name").distinct(), [F.asc("name")])
    known = stored(numbered.select(F.col("name").alias("start"), F.expr("(rank - 1) div 64").alias("block"), (at % 64).cast("int").alias("bit")), "starts")
    shifted = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    front = known.groupBy("block", F.col("start").alias("name")).agg(F.bit_or(shifted).alias("bits"))
    seen, found = None, []
    for hop in range(1, hops + 1):
        met = e.join(front, e.subject == front.name).groupBy("block", F.col("counterparty").alias("name")).agg(F.bit_or("bits").alias("bits"))
        if seen is not None:
            fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
            met = met.join(seen.withColumnRenamed("bits", "old"), ["block", "name"], "left").select("block", "name", fresh.alias("bits")).where("bits <> 0")
        front = stored(met, "front")
        found.append(front.withColumn("hop", F.lit(hop)))
        seen = front if seen is None else stored(seen.union(front).groupBy("block", "name").agg(F.bit_or("bits").alias("bits")), "seen")
    every = reduce(DataFrame.union, found)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(1) == 1)
    return every.select("block", "hop", "name", F.explode(bits).alias("bit")).join(known, ["block", "bit"]).select("start", "hop", "name")


def compare_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, bridge, dest, side, amounts of both): side is matched, only_left or only_right. Amounts do not decide; of repeated keys the largest amounts stand."""
    key = ["source", "bridge", "dest"]
    one = lambda df, s: df.groupBy(*key).agg(F.max(F.struct("amount_in", "amount_out")).alias(s))
    both = one(left, "l").join(one(right, "r"), key, "full_outer")
    side = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("matched")
    return both.select(*key, side.alias("side"), *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for s, n in (("l", "left"), ("r", "right")) for c in ("amount_in", "amount_out")])


def consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: matched, only_left, only_right, consistent."""
    n = lambda side: F.coalesce(F.sum((F.col("side") == side).cast("long")), F.lit(0)).alias(side)
    return compare_paths(left, right).agg(n("matched"), n("only_left"), n("only_right")).withColumn("consistent", (F.col("only_left") == 0) & (F.col("only_right") == 0))
