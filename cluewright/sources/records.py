"""Rows of files with their place in the file, and the records of one large JSON array, found by many tasks.

A JSON document is read in Spark's splits, cut at closing braces. Whether a
split begins inside a string, and how deep, depends on all text before it: a
first pass tells for each split what it does to both, and these few facts are
added up in order. A second pass then knows where every record begins and
ends. Records within a split are whole at once; pieces of those that cross
splits are put together by the record they began with.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import shared_dir, stored
from .partitioned import ROW

FOUND = "file string, block long, pos long, i long, kind string, text string"
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def with_source_rows(df: DataFrame) -> DataFrame:
    """df, as read from files, with _source_part, the file's name, and _source_row, the row's number in it from 1.

    Where the source knows row numbers they are its own. Otherwise a row's
    place in its split is added to the rows of earlier splits of its file, so
    that the number does not depend on how files are split or dealt out.
    """
    file = F.col("_metadata.file_path")
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        return df.select("*", F.col("_metadata.file_name").alias("_source_part"), (F.col("_metadata.row_index") + 1).alias(ROW))
    rows = df.select("*", file.alias("__file"), F.col("_metadata.file_name").alias("_source_part"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    splits = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(splits.select("__file", "__block", (F.col("__first") - before).alias("__shift")), "splits")
    return rows.join(starts, ["__file", "__block"]).withColumn(ROW, F.col("__at") - F.col("__shift") + 1).drop("__file", "__block", "__at", "__shift")


def _structure(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(is a byte outside strings, change of depth at each byte, whether the end is inside), from whether the beginning is inside."""
    quote, back = data == 34, data == 92
    if back.any():
        at = np.flatnonzero(quote)
        last = np.maximum.accumulate(np.where(back, -1, np.arange(len(data))))  # the last byte that is no backslash
        before = np.where(at > 0, last[at - 1], -1)
        quote[at[(at - 1 - before) & 1 == 1]] = False
    state = np.cumsum(quote) + inside & 1
    change = ((data == 91) | (data == 123)).astype(np.int64) - ((data == 93) | (data == 125))
    return state == 0, change, int(state[-1]) if len(state) else inside


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, block), bytes) of runs of text, in order; each run ends behind a brace."""
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        texts = batch.column(2).cast(pa.binary())
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at], np.frombuffer(b"}".join(texts.slice(at, end - at).to_pylist()) + b"}", np.uint8)
            at = end


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, flips, deeper, deeper_inside): whether a split ends in the other state, and its change of depth begun outside or inside a string."""
    found: dict[tuple[str, int], list[int]] = {}
    for key, data in _runs(batches):
        own = found.setdefault(key, [0, 0, 0])
        outside, change, end = _structure(data, 0)
        out, into = int(change[outside].sum()), int(change[~outside].sum())
        own[1 + own[0]], own[2 - own[0]] = own[1 + own[0]] + out, own[2 - own[0]] + into
        own[0] ^= end
    if found:
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], ["file", "block", "flips", "deeper", "deeper_inside"])


def _cut(starts: dict[tuple[str, int], tuple[int, int]], level: int):
    """Rows of FOUND. kind: record; head, what a split begins with of a record from before; tail, a record that goes on; open and close, of arrays at `level`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        rows: list[tuple] = []

        def tail() -> None:
            if now is not None and going:
                rows.append((*now, where, number - element, "tail" if owned else "head", b"".join(held) if element else None))

        for key, data in _runs(batches):
            if key != now:
                tail()
                now, passed, number = key, 0, 0
                inside, depth = starts[key]
                going, owned, element, held, where = depth > level, False, depth > level, [], 0
            outside, change, inside = _structure(data, inside)
            deep = depth + np.cumsum(np.where(outside, change, 0))
            depth = int(deep[-1])
            solid = np.where(outside & ~np.isin(data, (32, 9, 10, 13)), np.arange(len(data)), -1)
            before = np.r_[-1, np.maximum.accumulate(solid)[:-1]]
            opens = np.flatnonzero(outside & (data == 123) & (deep == level + 1))
            ends = np.flatnonzero(outside & (data == 125) & (deep == level))
            listed = np.isin(np.where(before[opens] >= 0, data[before[opens]], 125), (91, 44))
            if level > 1:
                for p in np.flatnonzero(outside & (data == 91) & (deep == level)).tolist():
                    name = _NAME.search(data[max(0, p - 400) : p].tobytes())
                    rows.append((*now, passed + p, 0, "open", name[1] if name else None))
                rows += [(*now, passed + p, 0, "close", None) for p in np.flatnonzero(outside & (data == 93) & (deep == level - 1)).tolist()]
            e = 0
            if going:
                if not len(ends):
                    held.append(data.tobytes())
                else:
                    text = b"".join([*held, data[: ends[0] + 1].tobytes()])
                    rows.append((*now, where, number - (owned and element), "record" if owned else "head", text if element else None))
                    going, held, e = False, [], 1
            for k, a in enumerate(opens.tolist()):
                number += bool(listed[k])
                if e + k < len(ends):
                    if listed[k]:
                        rows.append((*now, passed + a, number - 1, "record", data[a : ends[e + k] + 1].tobytes()))
                else:
                    going, owned, element, where, held = True, True, bool(listed[k]), passed + a, [data[a:].tobytes()]
            passed += len(data)
            rows = [r for r in rows if r[4] != "record" or r[5] is not None]
            if rows:
                yield _found(rows)
                rows = []
        tail()
        if rows:
            yield _found(rows)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([*made[:5], made[5].cast(pa.string())], ["file", "block", "pos", "i", "kind", "text"])


def _starts(effects: list) -> dict[tuple[str, int], tuple[int, int]]:
    """Of every split whether it begins inside a string, and how deep: the effects of those before it, one after another."""
    out, now = {}, None
    for r in sorted(effects, key=lambda r: (r["file"], r["block"])):
        if r["file"] != now:
            now, inside, depth = r["file"], 0, 0
        out[r["file"], r["block"]] = inside, depth
        depth += r["deeper_inside"] if inside else r["deeper"]
        inside ^= r["flips"]
    return out


def json_records(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(_source_part, _source_row, text): the objects of a JSON document's array, in order from 1, found by many tasks.

    The array is the document itself, or the one that the root object has under
    `name`. Elements that are no objects are left out. The driver gets one row
    for each split of a file, and two for each array in the root object.
    """
    level = 1 if name is None else 2
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = pieces.mapInArrow(_effects, "file string, block long, flips long, deeper long, deeper_inside long").collect()
    found = stored(pieces.mapInArrow(_cut(_starts(effects), level), FOUND), "found")
    whole = found.where("kind = 'record'").select("file", "block", "pos", "i", "text")
    # A record that crosses splits: its tail in the split it begins in, and all heads up to the next tail.
    parts = found.where("kind in ('head', 'tail')")
    began = F.last(F.when(F.col("kind") == "tail", F.struct("block", "pos", "i", F.col("text").isNotNull().alias("element"))), True).over(W.partitionBy("file").orderBy("block", F.col("kind") == "tail"))
    crossing = parts.withColumn("b", began).where("b.element").groupBy("file", F.col("b.block").alias("block"), F.col("b.pos").alias("pos"), F.col("b.i").alias("i"))
    crossing = crossing.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block"), (F.col("kind") != "tail").alias("k"), "text"))), lambda x: x["text"]), "").alias("text"))
    rows = whole.unionByName(crossing.select(*whole.columns))
    if name is not None:
        marks = sorted(map(tuple, found.where("kind in ('open', 'close')").select("file", "block", "pos", "kind", "text").collect()), key=lambda r: r[:3])
        ranges = [(*a[:3], *b[1:3]) for a, b in zip(marks, marks[1:]) if a[3] == "open" and a[4] == name and b[3] == "close" and a[0] == b[0]]
        kept = spark.createDataFrame(ranges, "file string, b0 long, p0 long, b1 long, p1 long")
        within = F.expr("struct(block, pos) > struct(b0, p0) and struct(block, pos) < struct(b1, p1)")
        rows = rows.join(F.broadcast(kept), "file").where(within).select(*rows.columns)  # an array for each file
    rows = stored(rows, "records")
    counts = rows.groupBy("file", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(shift, ["file", "block"]).select(F.element_at(F.split("file", "/"), -1).alias("_source_part"), (F.col("i") + F.col("shift") + 1).alias(ROW), "text")


def read_split_json(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The records of json_records() as columns, with _source_part and _source_row; their fields are found by Spark's JSON reader in one row of text each."""
    lines = json_records(spark, path, name)
    place = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    body = F.regexp_replace(F.expr("substring(text, 2)"), "[\r\n]", " ")
    comma = F.when(F.col("text").rlike(r"^\{\s*\}$"), "").otherwise(",")
    told = F.to_json(F.struct("_source_part", ROW))
    out = lines.select(told.alias("told"), comma.alias("comma"), body.alias("body")).select(F.concat(F.expr("substring(told, 1, length(told) - 1)"), "comma", "body").alias("value"))
    out.write.text(place)
    return spark.read.json(place)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a part, a batch of them as one text, with the numbers of the part and of the text in it."""
    part = TaskContext.get().partitionId()
    for n, batch in enumerate(b for b in batches if b.num_rows):
        text = "\n".join(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([text])], ["part", "n", "text"])


def write_in_order(lines: DataFrame, key: str, to: str) -> None:
    """Write the column value of lines as one text file, in order of key.

    Ranges of the key are sorted by many tasks. The file's one writer puts
    their chunks in order by Python's sort of pairs, which spills beyond
    spark.python.worker.memory, so that its memory has that bound and does not
    grow with the file.
    """
    chunks = lines.repartitionByRange(key).sortWithinPartitions(key).select("value").mapInArrow(_chunks, "part long, n long, text string")
    ordered = chunks.rdd.map(lambda r: ((r["part"], r["n"]), r["text"])).repartitionAndSortWithinPartitions(1)
    lines.sparkSession.createDataFrame(ordered.map(lambda x: (x[1],)), "value string", verifySchema=False).write.text(to)
