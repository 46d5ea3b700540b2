"""Exact substring dedup: remove every byte that a string of `span` bytes covers which also starts elsewhere.

Only suffixes that can repeat are sorted, and they are sorted one bucket at a
time. Every string of `span` bytes has one anchor: among its `gram`-byte
grams the one of least hash, leftmost first. Equal strings have equal anchors
at equal places, so the suffixes that start with a repeated string fall into
the bucket of their anchor's hash, whichever document they are from.

1. Anchors are counted by hash. What occurs once cannot repeat and is dropped;
   a bitmap sized to the keys does that on the map side and only ever errs by
   keeping too much. Where it would be too full to tell, what it keeps meets
   the keys themselves before it is written.
2. Consecutive suffixes of one anchor form a stretch. Equal stretches are one
   class, counted before any text moves: in a class of two, all suffixes
   repeat.
3. Buckets with different classes are sorted suffix by suffix, one text per
   class. A suffix is compared by the few bytes up to the next position of a
   cover, in coordinates relative to the anchor, by that position's
   precomputed rank among the cover's samples, and by the bytes after the
   sample: long ties cost one comparison. Neighbours that agree repeat.
4. A bucket of over MOST_CLASSES classes, such as the edge of a passage that
   very many documents share, is not gathered: the strings of its suffixes are
   counted by hash with a partial aggregate, which gives the same verdicts.
5. What repeats is joined back to the stretches of each distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import bitmap, digest, in_bitmap, load, stored, text_of, without

SPAN, GRAM = 200, 100
#: Distance of the cover's positions. A sample has SPAN - COVER bytes.
COVER = 32
#: Sizes of the bitmaps, as powers of two of flags: at most the first, at least the second, and in between 2**SPARE flags for a key.
MOST_BITS, LEAST_BITS, SPARE = 27, 18, 4
CHUNK = 1 << 19
#: Classes, of up to 3 * SPAN / 2 bytes each, that a task sorts as one bucket.
MOST_CLASSES = 4096


def _parts(data: np.ndarray, offs: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Cut very long rows so that arrays stay small; parts overlap by span - 1 bytes, so that each suffix lies in one of them. (bytes, offsets, rows, first byte)."""
    rows = np.arange(len(offs) - 1)
    if len(rows) > 1 or len(data) <= 4 * CHUNK:
        yield data, offs, rows, 0
        return
    for at in range(0, len(data), 2 * CHUNK):
        part = data[at : at + 2 * CHUNK + span - 1]
        yield part, np.array([0, len(part)]), rows, at


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def stretches(data: np.ndarray, offs: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor's hash, hash of the stretch's bytes, row, first suffix, suffixes, anchor - first suffix) of each run of suffixes of one anchor."""
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    sums = K.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    h = K.span_hash(sums, at, at + gram)
    low = np.uint64(32)
    least = _sliding_min((h >> low << low) | at.astype(np.uint64), span - gram + 1)
    p = np.arange(len(data) - span + 1)
    row = np.searchsorted(offs, p, "right") - 1
    inside = p + span <= offs[row + 1]
    p, row = p[inside], row[inside]
    anchor = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(p):
        return h[:0], h[:0], p, p, p, p
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[first[1:], len(p)] - 1
    lo, hi = p[first], p[last]
    return h[anchor[first]], K.span_hash(sums, lo, hi + span), row[first], lo, hi - lo + 1, anchor[first] - lo


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_counts(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in K.chunks(batch.column(0), CHUNK):
                for part, cut, _, _ in _parts(data, offs, span):
                    h, n = np.unique(stretches(part, cut, span, gram)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_i64(h), pa.array(n)], ["h", "n"])

    return run


def _occurrences(span: int, gram: int, flags: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, _, data, offs in K.chunks(batch.column(0), CHUNK):
                for part, cut, _, base in _parts(data, offs, span):
                    h, r, row, lo, n, _ = stretches(part, cut, span, gram)
                    may = in_bitmap(flags, h)
                    key = batch.column(1).take(pa.array(row[may] + top))
                    yield pa.RecordBatch.from_arrays(
                        [key, _i64(h[may]), _i64(r[may]), pa.array(lo[may] - cut[row[may]] + base), pa.array(n[may].astype(np.int32))], ["key", "h", "r", "lo", "n"]
                    )

    return run


def _classes_of(batches: Iterator[pa.RecordBatch], span: int, gram: int, flags: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Classes of flagged buckets, each once for a run of texts: bytes, bucket, class, first suffix, suffixes, anchor's place."""
    for batch in batches:
        for _, _, data, offs in K.chunks(batch.column(0), CHUNK):
            for part, cut, _, _ in _parts(data, offs, span):
                h, r, _, lo, n, pre = stretches(part, cut, span, gram)
                may = np.flatnonzero(in_bitmap(flags, h))
                may = may[np.lexsort((r[may], h[may]))]
                if len(may):
                    may = may[np.r_[True, (h[may][1:] != h[may][:-1]) | (r[may][1:] != r[may][:-1])]]
                yield part, h[may], r[may], lo[may], n[may], pre[may]


def _class_texts(span: int, gram: int, flags: np.ndarray, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, r, lo, n, pre in _classes_of(batches, span, gram, flags):
            cold = np.flatnonzero(~in_bitmap(hot, h))
            text = pa.array([part[a : a + k + span - 1].tobytes() for a, k in zip(lo[cold], n[cold])], pa.binary())
            yield pa.RecordBatch.from_arrays([_i64(h[cold]), _i64(r[cold]), pa.array(pre[cold].astype(np.int32)), text], ["h", "r", "pre", "text"])

    return run


def _class_suffixes(span: int, gram: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, r, lo, n, pre in _classes_of(batches, span, gram, hot):
            own = np.repeat(np.arange(len(h)), n)
            i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            p = lo[own] + i
            # A suffix is told from the others of its bucket by its place before the anchor and its string.
            x = K.mix(K.span_hash(K.prefix_sums(part), p, p + span) + (i - pre[own]).astype(np.uint64)) if len(p) else h
            yield pa.RecordBatch.from_arrays([_i64(h[own]), _i64(r[own]), pa.array(i.astype(np.int32)), _i64(x)], ["h", "r", "i", "x"])

    return run


def repeated_suffixes(h: np.ndarray, pre: np.ndarray, data: np.ndarray, offs: np.ndarray, span: int = SPAN, cover: int = COVER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort the suffixes of classes bucket by bucket: (class, first, end) of runs of suffixes that another class has too.

    h: bucket of each class; offs: its text in data; pre: its anchor's place.
    """
    n = np.diff(offs) - span + 1
    own = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    p, place = offs[own] + i, i - pre[own]
    gap = (-place) % cover
    # Ranks of the cover's samples.
    spot, slot = np.unique(p + gap, return_inverse=True)
    size = span - cover
    rank = np.empty(len(spot), np.int64)
    rows = np.ascontiguousarray(data[spot[:, None] + np.arange(size)]).view(np.dtype((np.void, size)))[:, 0]
    order = np.argsort(rows)
    same = np.zeros(len(rows), bool)
    same[1:] = rows[order][1:] == rows[order][:-1]
    rank[order] = np.cumsum(~same)
    sums = K.prefix_sums(data)
    keys = (rank[slot], K.span_hash(sums, p + gap + size, p + span), K.span_hash(sums, p, p + gap), place, h[own])
    order = np.lexsort(keys)
    tie = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        tie &= key[order][1:] == key[order][:-1]
    again = np.zeros(len(own), bool)
    again[order[1:][tie]] = True
    again[order[:-1][tie]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])])
    first, last = at[new], at[np.r_[new[1:], len(at)] - 1]
    return own[first], i[first], i[last] + 1


def _sorted_buckets(span: int, cover: int):
    def work(h: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        texts = table.column("text").combine_chunks()
        _, offsets, body = texts.buffers()
        offs = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)
        own, a, b = repeated_suffixes(h, table.column("pre").to_numpy().astype(np.int64), data[offs[0] : offs[-1]], offs - offs[0], span, cover)
        taken = table.select(["h", "r"]).take(pa.array(own)).combine_chunks()
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
        return pa.RecordBatch.from_arrays([*cols, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["h", "r", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket: whole buckets are sorted together until they make up about a chunk.
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size > CHUNK:
                table = pa.concat_tables(held).combine_chunks()
                h = table.column("h").to_numpy()
                end = int(np.searchsorted(h, h[-1]))
                if end:
                    yield work(h[:end], table.slice(0, end))
                held, size = [table.slice(end)], table.slice(end).nbytes
        if held:
            table = pa.concat_tables(held).combine_chunks()
            yield work(table.column("h").to_numpy(), table)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        names = batch.schema.names
        rest = [c for c in names if c not in ("__t", "__found")]
        at = batch.schema.get_field_index
        kept, spans, sizes = [], [], []
        for text, found in zip(batch.column(at("__t")), batch.column(at("__found"))):
            body = text.as_buffer().to_pybytes()
            runs: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in found.as_py() or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(e, runs[-1][1])
                else:
                    runs.append([s, e])
            edges = [0, *[x for run in runs for x in run], len(body)]
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": s, "end": e} for s, e in runs])
            sizes.append(len(body))
        yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in rest], pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(sizes, pa.int64())], [*rest, "kept", "spans", "n_bytes"])


def _flags(keys: DataFrame, most: int) -> tuple[np.ndarray, Callable[[DataFrame], DataFrame]]:
    """A bitmap of keys' h, and what makes sure of rows that passed it: nothing, or a join with the keys where they are too many for the flags."""
    n = keys.count()
    bits = min(most, max(LEAST_BITS, n.bit_length() + SPARE))
    full = n > 1 << (bits - 2)
    return bitmap(keys, "h", bits), lambda rows: rows.join(keys.select("h"), "h", "left_semi").select(*rows.columns) if full else rows


def suffix_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, cover: int = COVER, bits: int = MOST_BITS, most_classes: int = MOST_CLASSES) -> DataFrame:
    """docs with text replaced by kept (its remaining bytes), spans (what was removed) and n_bytes.

    All texts are judged as they came. A string that starts twice in one text
    counts as a repeat, overlapping or not; none crosses texts. Null and empty
    texts keep nothing and lose nothing. Repeated rows are copies of each
    other; ids are not read. A cut may fall inside a character, so kept is
    binary. Columns named kept, spans or n_bytes are replaced, others pass
    through. An empty table gives an empty result.
    """
    docs = without(docs, ["kept", "spans", "n_bytes", "__t", "__found", "__key"])
    texts = docs.select(text_of().alias("t"), digest(text_of()).alias("key")).where(F.octet_length("t") >= span)
    counted = texts.select("t").mapInArrow(_anchor_counts(span, gram), "h long, n long")
    repeats = stored(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeats")
    flags, sure = _flags(repeats, bits)
    found = stored(sure(texts.mapInArrow(_occurrences(span, gram, flags), "key binary, h long, r long, lo long, n int")), "stretches")
    classes = stored(found.groupBy("h", "r").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "classes")
    kinds = stored(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "buckets")
    (flags, sure), (hot, _) = _flags(kinds, bits), _flags(kinds.where(F.col("k") > most_classes), bits)
    sample = sure(texts.select("t").mapInArrow(_class_texts(span, gram, flags, hot), "h long, r long, pre int, text binary")).dropDuplicates(["h", "r"])
    runs = sample.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(_sorted_buckets(span, cover), "h long, r long, a int, b int")
    if hot.any():
        suffixes = stored(texts.select("t").mapInArrow(_class_suffixes(span, gram, hot), "h long, r long, i int, x long"), "suffixes")
        again = suffixes.groupBy("h", "x").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("h", "x")
        runs = runs.unionByName(suffixes.join(again, ["h", "x"]).select("h", "r", F.col("i").alias("a"), (F.col("i") + 1).alias("b")).distinct())
    single = classes.where("copies = 1").select("h", "r")
    verdicts = classes.where("copies > 1").select("h", "r", F.lit(0).alias("a"), F.col("n").alias("b")).unionByName(runs.join(single, ["h", "r"], "left_semi"))
    spans = (
        found.join(verdicts, ["h", "r"])
        .groupBy("key")
        .agg(F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + span - 1).alias("end"))).alias("__found"))
    )
    rest = [f for f in docs.schema.fields if f.name != "text"]
    joined = docs.select(*[F.col(f"`{f.name}`") for f in rest], text_of().alias("__t"), digest(text_of()).alias("__key")).join(spans.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "kept binary, spans array<struct<start:bigint,end:bigint>>, n_bytes long"])
    return joined.mapInArrow(_removed, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
