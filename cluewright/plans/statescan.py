"""Running a state machine over a log, as a prefix scan of maps.

A step is a map from each of a few states to the next one, packed into one
integer; a step that is refused in a state maps the state to itself. Maps are
composed in any grouping, so that a key's steps are cut into chunks, each
chunk is composed to one map, chunks of chunks are composed in turn, and the
states found on top are carried down again. A key of very many steps is dealt
out in chunks like any other, and no task holds more than a chunk of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import stored

#: Bits of a state in a packed map, so that a long has room for 15 states, and steps of a chunk.
BITS, CHUNK = 4, 512


def packed(following: list[int]) -> int:
    """The map that takes state i to following[i]."""
    return sum(s << BITS * i for i, s in enumerate(following))


def after(step: Column, state: Column) -> Column:
    """The state that a packed map gives."""
    return F.call_function("shiftright", step, (state * BITS).cast("int")).bitwiseAND((1 << BITS) - 1)


def _then(first: Column, second: Column, states: int) -> Column:
    both = [F.call_function("shiftleft", after(second, after(first, F.lit(i))), F.lit(BITS * i)) for i in range(states)]
    return reduce(Column.bitwiseOR, both)


def _found(items: Column, start: Column) -> Column:
    """The states before each of items' maps, in order, from the state before the first."""
    nothing = F.struct(start.cast("long").alias("s"), F.array().cast("array<long>").alias("out"))
    walk = lambda acc, x: F.struct(after(x["m"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    return F.aggregate(items, nothing, walk, lambda acc: acc["out"])


def _groups(rows: DataFrame, key: str, number: str, *item: str) -> DataFrame:
    """Rows of one key and chunk, in order of number, with the state the key starts in."""
    return rows.groupBy(key, F.floor(F.col(number) / CHUNK).alias("c")).agg(F.sort_array(F.collect_list(F.struct(number, "m", *item))).alias("items"), F.first("start").alias("start"))


def states_before(rows: DataFrame, key: str, order: list[Column], step: Column, start: Column, states: int, name: str = "state") -> DataFrame:
    """rows with the state that each finds, and turn, their place among all rows: a key's rows run from its start in `order`.

    step is a long that packs the map of the row's step, start an integer that
    is the same for all rows of a key. Rows of a null key belong to one key.
    Rows equal in order come in any order of theirs, the same for all columns
    of the result.
    """
    columns = rows.columns
    row = [F.col(f"`{c}`") for c in columns]
    given = rows.select(F.struct(*row).alias("row"), F.col(key).alias("k"), step.cast("long").alias("m"), start.cast("long").alias("start"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    placed = ranked(given, [F.asc("k"), *[F.asc(f"o{i}") for i in range(len(order))]], "turn").drop(*[f"o{i}" for i in range(len(order))])
    leaves = stored(_groups(placed, "k", "turn", "row"), "chunks")
    same = packed(list(range(states)))
    whole = F.aggregate("items", F.lit(same).cast("long"), lambda acc, x: _then(acc, x["m"], states))
    levels, top = [leaves], leaves.agg(F.max("c")).first()[0] or 0
    while top:  # one level for each factor of CHUNK in the number of rows
        above = _groups(levels[-1].select("k", F.col("c").alias("n"), "start", whole.alias("m")), "k", "n")
        levels.append(stored(above, "chunks"))
        top //= CHUNK
    entered = levels.pop().withColumn("s", F.col("start"))
    while levels:
        below = entered.select("k", F.explode(F.arrays_zip(F.transform("items", lambda x: x["n"]).alias("c"), _found(F.col("items"), F.col("s")).alias("s"))).alias("x")).select(F.col("k").alias("above"), "x.c", "x.s")
        own = levels.pop()
        entered = own.join(below, F.expr("k <=> above") & (own["c"] == below["c"])).select(own["k"], own["c"], "items", "start", "s")
    out = entered.select(F.explode(F.zip_with("items", _found(F.col("items"), F.col("s")), lambda x, s: F.struct(x["row"].alias("row"), x["turn"].alias("turn"), s.alias("s")))).alias("x"))
    return out.select(*[F.col(f"x.row.`{c}`").alias(c) for c in columns], F.col("x.s").alias(name), F.col("x.turn").alias("turn"))
