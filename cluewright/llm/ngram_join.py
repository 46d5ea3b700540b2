"""N-gram Jaccard join: overlap counts by a blocked sparse product of the document by n-gram incidence.

Equal sets of n-grams are one row of the incidence, which one text of them
represents. The rest is exact and never lists all pairs of a group. The
incidence itself is not written, as it is twice as large as the documents it
comes from: texts that represent a set are shingled where they are needed.

1. The columns of the incidence, the n-grams, are dealt into blocks by their
   hash. Sizes bound how many n-grams two linked sets can differ by, and there
   are more blocks than that: linked sets have the same n-grams in one block
   at least. So a set is told by a key for each of its blocks, sets that share
   a key are a list, and pairs without a common list are discarded unseen. Keys
   and their sets go to buckets of keys once, packed, and are sorted there.
2. Lists that share sets are one cluster. A cluster is a block of rows, and
   the sparse product of its rows accumulates the overlap of each pair.
3. A cluster that is too large for one block is contracted first: each member
   is held against least members of its lists, unless the parities of their
   n-grams, a bit for each, show that they differ by too many. Of lists that
   still span several components, short ones let their pairs meet in the same
   way. Long ones are cut where neighbouring sizes rule each other out and
   multiplied block by block; blocks whose sizes rule each other out, or that
   lie in one component, do not meet. Parities go to all pairs of blocks, the
   n-grams only where a pair of rows is left that they do not rule out.
4. Links of all kinds make the components. A block gives back a spanning
   forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.components import components, least_reached
from . import kernel as K
from .common import bitmap, digest, in_bitmap, load, scratch, stored, text_of

WORDS, PERCENT = 3, 90
#: Sizes of the bitmaps that keep rows from a shuffle, as powers of two: at most the first, and at least 2**SPARE flags for a key up to there.
MOST_BITS, LEAST_BITS, SPARE = 27, 18, 4
#: Sets and n-grams in a block of rows at most.
BLOCK, BLOCK_GRAMS = 1024, 1 << 19
#: Signatures, or names of sets, that are broadcast up to this many bytes and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Sets of a list at most for its pairs to meet one by one.
FEW = 32
#: Columns that more rows than this share are multiplied as dense slices of so many columns.
THIN, SLICE = 24, 1024
#: Sizes from one border to the next are one family; borders grow by this factor.
FAMILY = 1.5
#: Text bytes that are worked on at once, and n-grams of pivots and their sets that are.
CHUNK, PACK_GRAMS = 1 << 19, 1 << 17
#: Keys that a task sorts at once, and n-grams whose keys, about, meet in one bucket.
FLUSH, BUCKET_GRAMS = 1 << 20, 1 << 20
#: Keys go to their buckets in so many passes at most, one for as many n-grams: each holds its share of the keys on disk, and shingles the texts again.
PASSES, PASS_GRAMS = 2, 1 << 25
_SET = pa.binary(16)


def _borders() -> np.ndarray:
    out = [8]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * FAMILY)))
    return np.array(out, np.int64)


BORDERS = _borders()


def _sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes by row, ascending; the size and both fingerprints of each row's set."""
    start, end, row = K.words(data, offs)
    h, own = K.distinct_per_row(*K.shingles(K.hash_spans(data, start, end, lower=True), row, n))
    rows = len(offs) - 1
    size = np.bincount(own, minlength=rows)
    prints = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(rows, np.uint64)
        full = size > 0
        if len(h):
            total[full] = np.add.reduceat(K.mix(h ^ np.uint64(salt)), (np.cumsum(size) - size)[full])
        prints.append(total)
    return h, size, prints[0], prints[1]


def _names(a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(_SET, len(a), [None, pa.py_buffer(np.stack([a, b], 1).astype(">u8"))]).cast(pa.binary())


def _named(n: int):
    """Each row's set by name and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, last, data, offs in K.chunks(batch.column(2), CHUNK):
                _, size, a, b = _sets(data, offs, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(top, last - top), batch.column(1).slice(top, last - top), _names(a, b), pa.array(size)], ["doc_id", "rid", "s", "n"])

    return run


def _incidence(batches: Iterator[pa.RecordBatch], n: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams of rows end to end, their number by row, both fingerprints) for the texts whose row id may be in rows, some at a time."""
    for batch in batches:
        batch = batch.filter(pa.array(in_bitmap(rows, batch.column(0).to_numpy())))
        for _, _, data, offs in K.chunks(batch.column(1), CHUNK):
            yield _sets(data, offs, n)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a column of sets, end to end, and the number of them in each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return np.frombuffer(data.tobytes(), np.uint64), np.diff(offs) // 8


def column_blocks(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For families of sets of up to size: blocks of columns, and how many of them may be empty without a key.

    Sets up to r n-grams that link differ by 2 r (100 - percent) / (100 +
    percent) n-grams at most; with so many blocks and one more, they agree on
    one. Further blocks make up for empty ones, in which sets agree by chance:
    a set with no more empty blocks than that has no key for them, a set with
    more has one for each. They are as many as the family's small sets hardly
    ever exceed, four standard deviations over the mean.
    """
    most = 2 * size * (100 - percent) // (100 + percent)
    spare = np.ones(len(size))
    for _ in range(20):
        blocks = most + 1 + spare
        empty = blocks * np.exp(-size / FAMILY / blocks)
        spare = 1 + np.ceil(empty + 4 * np.sqrt(empty))
    spare = np.minimum(spare, most + 1).astype(np.int64)
    return most + 1 + spare, spare


def block_keys(h: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of the rows' blocks of columns, family by family. Sets too small to link with any other have none."""
    first = np.cumsum(size) - size
    can = 100 * size >= percent * (size + 1)
    own = np.searchsorted(BORDERS, size)
    last = np.searchsorted(BORDERS, 100 * size // percent)  # the family of the largest set it may link with
    for step in range(int((last - own)[can].max(initial=-1)) + 1):
        rows = np.flatnonzero(can & (own + step <= last))
        if not len(rows):
            continue
        family = own[rows] + step
        blocks, spare = column_blocks(BORDERS[family], percent)
        many = size[rows]
        mine = np.repeat(np.arange(len(rows)), many)
        grams = h[np.repeat(first[rows] - (np.cumsum(many) - many), many) + np.arange(len(mine))]
        block = ((grams >> np.uint64(32)) * blocks.astype(np.uint64)[mine] >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (block[1:] != block[:-1])])
        content = np.add.reduceat(K.mix(grams ^ np.uint64(0xA4093822299F31D0)), new)
        where = K.mix((block[new] * 64 + family[mine[new]]).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        yield K.mix(content + where), rows[mine[new]]
        filled = np.bincount(mine[new], minlength=len(rows))
        for r in np.flatnonzero(blocks - filled > spare):
            empty = np.setdiff1d(np.arange(blocks[r]), block[new][mine[new] == r])
            yield K.mix(K.mix((empty * 64 + family[r]).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))), np.full(len(empty), rows[r])


def _grouped(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of keys and sets in order, each once, and each one's turn among those of its key."""
    order = np.argsort(k)
    k, f = k[order], f[order]
    same = np.r_[False, k[1:] == k[:-1], False]
    run = np.flatnonzero(same[1:] | same[:-1])
    f[run] = f[run][np.lexsort((f[run], k[run]))]
    once = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])][: len(k)])
    k, f = k[once], f[once]
    at = np.arange(len(k))
    return k, f, at - np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]][: len(k)], at, 0))


def _strung(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Values from cut to cut as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _keys(n: int, percent: int, rows: np.ndarray, buckets: int, flush: int = FLUSH, lo: int = 0, hi: int | None = None):
    """(bucket, k, f): the sets' keys, with the first fingerprints of the sets, end to end in buckets of keys. Keys of the buckets from lo to hi alone.

    Of the pairs of one key that a task sorts at once, two go to the key's
    bucket, where they tell that it is shared. Others need not be told apart,
    so they go to further buckets, by turns and not by key: a key that very
    many sets have fills none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            k, f, turn = _grouped(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            told, more = turn < 2, np.flatnonzero(turn >= 2)
            k_, f_ = k[told], f[told]
            bucket = _bucket(k_, buckets)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), _strung(k_, cuts), _strung(f_, cuts)], ["bucket", "k", "f"])
            if len(more):
                cuts = np.unique(np.r_[np.arange(0, len(more), 1 << 16), len(more)])
                to = buckets + _bucket(K.mix(k[more[cuts[:-1]]] ^ f[more[cuts[:-1]]]), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(to), _strung(k[more], cuts), _strung(f[more], cuts)], ["bucket", "k", "f"])

        for h, size, a, _ in _incidence(batches, n, rows):
            for key, row in block_keys(h, size, percent):
                if lo or hi is not None:
                    bucket = _bucket(key, buckets)
                    mine = (bucket >= lo) & (bucket < (buckets if hi is None else hi))
                    key, row = key[mine], row[mine]
                if len(key):
                    held.append((key, a[row]))
            if sum(len(k) for k, _ in held) >= flush:
                yield from dealt()
        if held:
            yield from dealt()

    return run


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _shared(buckets: int):
    """(k, f) of a bucket's keys that several sets have."""

    def run(table: pa.Table) -> pa.Table:
        k, f = _joined(table.column("k"))[0], _joined(table.column("f"))[0]
        if table.column("bucket")[0].as_py() < buckets:
            k, f, turn = _grouped(k, f)
            keep = (turn > 0) | np.r_[turn[1:] > 0, False][: len(k)]
            k, f = k[keep], f[keep]
        return pa.table({"k": k.view(np.int64), "f": f.view(np.int64)})

    return run


def _grams(n: int, rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, size, a, b in _incidence(batches, n, rows):
            yield pa.RecordBatch.from_arrays([_names(a, b), _strung(h, np.r_[0, np.cumsum(size)])], ["s", "grams"])

    return run


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def overlaps(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of n-grams that each two different rows share: the product of the incidence with its transpose.

    Columns of one row are left out, equal columns are one with a weight. Thin
    columns add their pairs, thick ones are multiplied as dense slices.
    """
    m = len(size)
    own = np.repeat(np.arange(m), size)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(h)])
    keep = count > 1
    total = np.zeros(m * m)  # counts stay far below 2**53
    if not keep.any():
        return total.astype(np.int64).reshape(m, m)
    told = K.mix(np.arange(1, m + 1).astype(np.uint64))
    pattern = np.add.reduceat(told[own], new)[keep]
    _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
    new, count, weight = new[keep][first], count[keep][first], weight.astype(np.float64)
    for k in np.unique(count[count <= THIN]):
        at = np.flatnonzero(count == k)
        step = max(1, (1 << 18) // int(k * k))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            rows = own[new[part][:, None] + np.arange(k)]
            np.add.at(total, (rows[:, :, None] * m + rows[:, None, :]).ravel(), np.repeat(weight[part], k * k))
    thick = np.flatnonzero(count > THIN)
    dense = total.reshape(m, m)
    for lo in range(0, len(thick), SLICE):
        part = thick[lo : lo + SLICE]
        column = np.repeat(np.arange(len(part)), count[part])
        row = own[np.repeat(new[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(len(column))]
        slice_ = np.zeros((m, len(part)))
        slice_[row, column] = 1
        dense += (slice_ * weight[part]) @ slice_.T
    return dense.astype(np.int64)


def _forest(h: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each row the least row that links reach."""
    both = overlaps(h, size)
    a, b = np.nonzero(np.triu(both, 1))
    link = linked(both[a, b], size[a], size[b], percent)
    return least_reached(a[link], b[link], len(size))


def _product(percent: int, by: str):
    """Links of a block, or of the blocks of column `by` that a group packs together."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("s").combine_chunks()
        block = table.column(by).combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((names.dictionary_encode().indices.to_numpy(), block))
        table, block = table.take(pa.array(order)).combine_chunks(), block[order]
        names = table.column("s").combine_chunks()
        h, size = _joined(table.column("grams"))
        at = np.r_[0, np.cumsum(size)]
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
        label = np.arange(len(size))
        for lo, hi in zip(cuts, cuts[1:]):
            label[lo:hi] = lo + _forest(h[at[lo] : at[hi]], size[lo:hi], percent)
        moved = np.flatnonzero(label != np.arange(len(size)))
        return pa.table({"u": names.take(pa.array(moved)), "v": names.take(pa.array(label[moved]))})

    return run


def _verified(percent: int):
    """(s, pivot) that link, of packs of blocks: rows (block, pivot, s, grams), s null for the pivot itself.

    A block is the rows of sets that name one pivot; their overlaps with it are
    the product of these rows with the pivot's column of the incidence. The
    n-grams of a block are told from those of others by its number, so that one
    search multiplies all blocks of a pack.
    """

    def run(table: pa.Table) -> pa.Table:
        s = table.column("s").combine_chunks()
        block = K.mix(table.column("block").to_numpy().view(np.uint64))
        h, size = _joined(table.column("grams"))
        keys = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.repeat(block, size))
        own = np.repeat(s.is_null().to_numpy(zero_copy_only=False), size)
        columns = np.sort(keys[own])
        slot = np.minimum(np.searchsorted(columns, keys), max(len(columns) - 1, 0))
        hits = np.r_[0, np.cumsum(columns[slot] == keys if len(columns) else np.zeros(len(keys), bool))]
        at = np.r_[0, np.cumsum(size)]
        both = hits[at[1:]] - hits[at[:-1]]
        rows = np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False))
        keep = rows[linked(both[rows], size[rows], table.column("pivot_n").to_numpy()[rows], percent)]
        return table.select(["s", "pivot"]).take(pa.array(keep))

    return run


def signature(h: np.ndarray) -> np.ndarray:
    """For half as many bits as n-grams at least, a power of two: the parity of the n-grams whose hash ends in the bit's number. Packed, 8 bits a byte."""
    bits = max(64, 1 << max(0, len(h).bit_length() - 1))
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def differences(x: pa.Array, y: pa.Array) -> np.ndarray:
    """How many n-grams the sets of two columns of signatures differ by at least, row by row: each flips one bit of one of the two. Rows of like lengths are one matrix."""
    out = np.zeros(len(x), np.int64)
    lengths = np.stack([pc.binary_length(x).to_numpy(), pc.binary_length(y).to_numpy()], 1)
    kinds, own = np.unique(lengths, axis=0, return_inverse=True)
    for i, (k, m) in enumerate(kinds):
        rows = pa.array(np.flatnonzero(own.ravel() == i))
        short, long = (np.frombuffer(b"".join(c.take(rows).to_pylist()), np.uint8).reshape(len(rows), w) for c, w in ((x, k), (y, m)))
        if k > m:
            short, long = long, short
        while long.shape[1] > short.shape[1]:
            long = long[:, : long.shape[1] // 2] ^ long[:, long.shape[1] // 2 :]
        out[rows.to_numpy()] = np.bitwise_count(short ^ long).sum(1, dtype=np.int64)
    return out


def _signatures(n: int, rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, size, a, b in _incidence(batches, n, rows):
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([_names(a, b), pa.array([signature(h[e - k : e]).tobytes() for e, k in zip(ends, size)], pa.binary())], ["s", "told"])

    return run


def _at_hand(told: DataFrame) -> DataFrame:
    """Signatures, broadcast if they are known to fit."""
    size = told.agg(F.sum(F.octet_length("told") + 64)).first()[0] or 0
    return F.broadcast(told) if size <= BROADCAST_BYTES else told


def may_link(n: np.ndarray, part: np.ndarray, told: pa.Array, percent: int) -> np.ndarray:
    """For each set whether sizes and signatures let it link with one of another part."""
    length = pc.binary_length(told).to_numpy()
    at = {k: np.flatnonzero(length == k) for k in np.unique(length)}
    bits = {k: np.frombuffer(b"".join(told.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), k) for k, rows in at.items()}
    out = np.zeros(len(n), bool)
    for k, long in combinations_with_replacement(sorted(at), 2):
        x, y = bits[k], bits[long]
        while y.shape[1] > k:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        x, y, b = x.view(np.uint64), np.ascontiguousarray(y).view(np.uint64), at[long]
        step = max(1, (1 << 20) // y.size)
        for lo in range(0, len(x), step):
            a = at[k][lo : lo + step]
            apart = np.bitwise_count(x[lo : lo + step, None] ^ y[None]).sum(2, dtype=np.int64)
            m, o = n[a][:, None], n[b][None]
            ok = (apart <= (m + o) * (100 - percent) // (100 + percent)) & (100 * np.minimum(m, o) >= percent * np.maximum(m, o)) & (part[a][:, None] != part[b][None])
            out[a] |= ok.any(1)
            out[b] |= ok.any(0)
    return out


def _promising(percent: int):
    """(pair, s) of the sets of a pair of blocks that may link with one of another component there."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
        keep = may_link(table.column("n").to_numpy(), part, table.column("told").combine_chunks(), percent)
        return table.select(["pair", "s"]).filter(pa.array(keep))

    return run


def _alike(pairs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """pairs (s, n, pivot, pivot_n) without those that sizes or signatures rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            most = (column("n").to_numpy() + column("pivot_n").to_numpy()) * (100 - percent) // (100 + percent)
            apart = differences(column("told"), column("pivot_told"))
            yield batch.select(names).filter(pa.array(apart <= most))

    names = pairs.columns
    sized = F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n")
    told = _at_hand(told)
    other = told.select(F.col("s").alias("pivot"), F.col("told").alias("pivot_told"))
    met = pairs.where(sized).join(told, "s").join(other, "pivot").select(*names, "told", "pivot_told")
    return stored(met.mapInArrow(run, pairs.schema).distinct(), "alike")


def _sent(names: DataFrame, many: int) -> DataFrame:
    """Names of sets, of which there are `many`: broadcast where they are known to fit, 128 bytes each, so that n-grams do not move to be discarded."""
    return F.broadcast(names) if many <= BROADCAST_BYTES // 128 else names


def _tried(pairs: DataFrame, grams: DataFrame, percent: int, pack_grams: int = PACK_GRAMS) -> DataFrame:
    """(s, pivot) of the pairs (s, n, pivot, pivot_n) that link.

    Sets of one pivot are dealt into blocks of about pack_grams n-grams, and
    small blocks packed together. A pivot's list goes to each of its blocks
    once, however many sets name it.
    """
    pairs = pairs.select("s", "n", "pivot", "pivot_n")
    width = F.ceil((F.sum("n") + F.first("pivot_n")) / pack_grams).alias("w")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-2 * total // pack_grams))
    number = F.xxhash64("pivot", F.pmod(F.xxhash64("s"), F.col("w")))
    dealt = stored(pairs.join(pairs.groupBy("pivot").agg(width), "pivot").select("s", "pivot", "pivot_n", number.alias("block")), "dealt")
    rows = dealt.join(grams, "s").select("block", "pivot", "pivot_n", "s", "grams")
    own = dealt.select("block", "pivot", "pivot_n").distinct().join(grams.withColumnRenamed("s", "pivot"), "pivot")
    both = rows.unionByName(own.withColumn("s", F.lit(None).cast("binary"))).withColumn("pack", F.pmod("block", F.lit(packs)))
    return stored(both.groupBy("pack").applyInArrow(_verified(percent), "s binary, pivot binary"), "links")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs whose ends links do not connect."""
    label = stored(components(links, "s", "pivot"), "parts")
    cs, cp = label.select(F.col("vertex").alias("s"), F.col("component").alias("cs")), label.select(F.col("vertex").alias("pivot"), F.col("component").alias("cp"))
    return pairs.join(cs, "s", "left").join(cp, "pivot", "left").where("not coalesce(cs = cp, false)").select(*pairs.columns)


def _large(pairs: DataFrame, lists: DataFrame, told: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int, block_grams: int) -> DataFrame:
    """(u, v): links of the sets of clusters that are larger than a block.

    pairs: sets and least members of their lists; lists: (k, s, n) of all
    sets; told: signatures by s. fetch(sets with s) gives (s, grams): the few that stand
    when sizes and signatures have had their say.
    """
    sides = lambda df: df.select("s").union(df.select("pivot")).distinct()
    ends = lambda df: df.select(F.col("s").alias("u"), F.col("pivot").alias("v"))
    with scratch(pairs.sparkSession):
        # One pivot of a set, which most of its lists name, before the others.
        pairs = _alike(pairs, told, percent)
        grams = fetch(sides(pairs))
        best = pairs.groupBy("s").agg(F.max_by(F.struct("n", "pivot", "pivot_n"), F.struct("lists", "pivot")).alias("x")).select("s", "x.*")
        once = _tried(best, grams, percent)
        known = once.unionByName(_tried(_apart(pairs.join(best, ["s", "pivot"], "left_anti"), once), grams, percent))
        known = stored(known, "known", result=True)
        # Lists that still span several components.
        parts = components(known, "s", "pivot").withColumnRenamed("vertex", "s")
        label = stored(told.select("s").join(parts, "s", "left").select("s", F.coalesce("component", "s").alias("c")), "label")
        own = stored(lists.join(_sent(label, label.count()), "s").select("k", "s", "n", "c"), "own")
        wide = own.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("sets")).where("a <> b").select("k", "sets")
        rest = stored(own.join(wide, "k"), "open", result=True)
    # In a list of a few sets all pairs may meet, in longer ones blocks do.
    few = _each_once(rest.where(F.col("sets") <= FEW))
    other = few.select("k", F.col("s").alias("pivot"), F.col("n").alias("pivot_n"), F.col("c").alias("pivot_c"))
    met = few.join(other, "k").where("s < pivot and c <> pivot_c").select("s", "n", "pivot", "pivot_n")
    met = _alike(met.distinct(), told, percent)  # signatures go to a pair once, however many lists it is in
    members = stored(_members(rest.where(F.col("sets") > FEW).drop("sets"), percent), "members")
    # Signatures are a small part of the n-grams, so they are what goes to all pairs of blocks.
    rows = _blocks(members, percent, block, block_grams).join(_at_hand(told), "s").groupBy("pair").applyInArrow(_promising(percent), "pair long, s binary")
    rows = stored(rows, "promising")
    grams = fetch(sides(met).union(rows.select("s")).distinct())
    more = _tried(met, grams, percent)
    blocks = rows.join(grams, "s").groupBy("pair").applyInArrow(_product(percent, "pair"), "u binary, v binary")
    return ends(known).unionByName(ends(more)).unionByName(blocks)


def _each_once(lists: DataFrame) -> DataFrame:
    """lists (k, s, ...), of those that have the same sets one alone: near copies share most of their keys."""
    told = [F.bit_xor(F.xxhash64("s", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    same = lists.groupBy("k").agg(F.count(F.lit(1)).alias("m"), *told).groupBy("m", "x1", "x2").agg(F.min("k").alias("k"))
    return lists.join(same.select("k"), "k", "left_semi")


def _members(lists: DataFrame, percent: int) -> DataFrame:
    """(cluster, s, c, n): sets of lists (k, s, c, n) that may link with sets of other components, those that may with each other in one cluster."""
    # Sizes are few however long a list is, so the window is over them and not over members.
    sizes = lists.select("k", "n").distinct()
    smaller = F.lag("n").over(W.partitionBy("k").orderBy("n"))
    start = F.when(F.lit(100) * smaller >= F.lit(percent) * F.col("n"), 0).otherwise(1)
    parts = sizes.withColumn("start", start).withColumn("part", F.sum("start").over(W.partitionBy("k").orderBy("n"))).select("k", "n", "part")
    rows = stored(lists.join(parts, ["k", "n"]).select("k", "part", "s", "c", "n"), "list-parts")
    open_parts = rows.groupBy("k", "part").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("s").alias("least")).where("a <> b").select("k", "part", "least")
    rows = stored(rows.join(open_parts, ["k", "part"]).select("s", "c", "n", "least").distinct(), "open-parts")
    clusters = components(rows, "s", "least").select(F.col("vertex").alias("s"), F.col("component").alias("cluster"))
    return rows.select("s", "c", "n").distinct().join(clusters, "s")


def _blocks(members: DataFrame, percent: int, block: int, grams: int) -> DataFrame:
    """(pair, s, n, c): members (cluster, s, c, n), once for each pair of blocks they are in."""
    # Sets of one band or of neighbouring bands can link; others cannot.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("long") if percent < 100 else F.col("n")
    heavy = members.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= block).select("cluster", "c", F.col("c").alias("own"))
    large = members.join(heavy, ["cluster", "c"], "left").withColumn("band", band)
    width = large.groupBy("cluster", "band", "own").agg(F.greatest(F.ceil(2 * F.count(F.lit(1)) / block), F.ceil(2 * F.sum("n") / grams)).alias("w"))
    same = [large[x].eqNullSafe(width[x]) for x in ("cluster", "band", "own")]
    large = large.join(width, same[0] & same[1] & same[2]).select(large["*"], F.pmod(F.xxhash64("s"), F.col("w")).alias("part"))
    large = stored(large.withColumn("block", F.xxhash64("cluster", "band", "own", "part")), "blocks")
    blocks = large.select("cluster", "band", "own", "block").distinct()
    other = blocks.select("cluster", F.col("band").alias("band2"), F.col("own").alias("own2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "cluster").where("(band2 = band and block2 >= block or band2 = band + 1) and not coalesce(own = own2, false)")
    pairs = pairs.withColumn("pair", F.xxhash64("block", "block2", F.lit("pair")))
    sides = pairs.select("pair", "block").union(pairs.select("pair", F.col("block2").alias("block"))).distinct()
    return large.join(sides, "block").select("pair", "s", "n", "c")


def _classes(docs: DataFrame, words: int, percent: int, block: int, block_grams: int, most_bits: int, rows_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, s, n) of each row, and the component of each set that may link; both are tables."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in rows_by], text_of()).alias("rid"), text_of().alias("t"))
    sets = stored(texts.mapInArrow(_named(words), f"doc_id {kind}, rid long, s binary, n long"), "sets", result=True)
    texts = texts.select("rid", "t")
    flagged = lambda of, key, n: bitmap(of, key, min(most_bits, max(LEAST_BITS, int(n).bit_length() + SPARE)))
    own = F.expr("cast(conv(hex(substring(s, 1, 8)), 16, -10) as long)").alias("f")  # the first fingerprint
    # Texts of few rows are picked before they go to Python, 32 bytes of a broadcast for each; those of many, there.
    among = lambda rids, many: texts.join(F.broadcast(rids.select("rid")), "rid", "left_semi") if many <= BROADCAST_BYTES // 32 else texts
    reps = stored(sets.where("n > 0").groupBy("s").agg(F.min("rid").alias("rid"), F.first("n").alias("n")).select("s", "rid", "n", own), "reps")
    total = reps.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    first = flagged(reps, "rid", total["sets"])
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["n"] // BUCKET_GRAMS))
    passes = max(1, min(PASSES, -(-total["n"] // PASS_GRAMS)))
    cuts = [i * buckets // passes for i in range(passes + 1)]
    dealt = [texts.mapInArrow(_keys(words, percent, first, buckets, FLUSH, lo, hi), "bucket long, k binary, f binary") for lo, hi in zip(cuts, cuts[1:])]
    # A pass is written before the next one begins, and its shuffle goes.
    postings = reduce(DataFrame.unionByName, [stored(keys.groupBy("bucket").applyInArrow(_shared(buckets), "k long, f long"), "postings") for keys in dealt])
    # Lists are told by fingerprints; sets that agree in their first one go together, as pairs are verified.
    pivots = postings.groupBy("k").agg(F.min("f").alias("pivot_f"), F.max("f").alias("last")).where("pivot_f <> last").drop("last")
    met = stored(postings.join(pivots, "k").where("f <> pivot_f").groupBy("f", "pivot_f").agg(F.count(F.lit(1)).alias("lists")), "met")
    pairs = met.join(reps.select("f", "s", "n"), "f").join(reps.select(F.col("f").alias("pivot_f"), F.col("s").alias("pivot"), F.col("n").alias("pivot_n")), "pivot_f")
    pairs = stored(pairs.select("s", "pivot", "lists", "n", "pivot_n"), "pairs")
    clusters = components(pairs, "s", "pivot").select(F.col("vertex").alias("s"), F.col("component").alias("cluster"))
    clusters = stored(clusters.join(reps, "s"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all_n"))
    small = (F.col("sets") <= block) & (F.col("all_n") <= block_grams)
    totals = sizes.agg(F.sum(F.when(small, F.col("sets"))).alias("sets"), F.sum(F.when(small, F.col("all_n"))).alias("n"), F.max(~small).alias("large")).first()
    # Small clusters are packed, so that a group of them makes up about half a block.
    packs = max(1, -(-2 * (totals["sets"] or 0) // block), -(-2 * (totals["n"] or 0) // block_grams))
    placed = stored(clusters.join(sizes.select("cluster", small.alias("fits")), "cluster").withColumn("pack", F.pmod(F.xxhash64("cluster"), F.lit(packs))), "placed")
    members = clusters.count()
    wanted = among(clusters, members).mapInArrow(_grams(words, flagged(clusters, "rid", members)), "s binary, grams binary")
    packed = wanted.join(_sent(placed.where("fits").select("s", "cluster", "pack"), totals["sets"] or 0), "s").select("pack", "cluster", "s", "grams")
    links = stored(packed.groupBy("pack").applyInArrow(_product(percent, "cluster"), "u binary, v binary"), "pack-links")
    if totals["large"]:
        wide = placed.where("not fits").select("s")
        sets_wide = wide.count()
        lists = stored(postings.join(_sent(placed.where("not fits").select("f", "s", "n"), sets_wide), "f").select("k", "s", "n"), "lists")

        def fetch(some: DataFrame) -> DataFrame:
            some = stored(some.join(reps, "s").select("s", "rid"), "some")
            many = some.count()
            rows = among(some, many).mapInArrow(_grams(words, flagged(some, "rid", many)), "s binary, grams binary")
            return stored(rows.join(_sent(some.select("s"), many), "s").dropDuplicates(["s"]), "grams")

        rids = placed.where("not fits").select("rid")
        told = among(rids, sets_wide).mapInArrow(_signatures(words, flagged(rids, "rid", sets_wide)), "s binary, told binary")
        told = stored(told.join(wide, "s").dropDuplicates(["s"]), "signatures")
        links = links.unionByName(_large(pairs.join(wide, "s", "left_semi"), lists, told, fetch, percent, block, block_grams))
    return sets, stored(components(links), "final", result=True)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, most_bits: int = MOST_BITS, rows_by: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, the least doc_id that links of percent Jaccard or more reach.

    A set is the distinct runs of `words` words, A-Z lower-cased; a text with
    fewer words has its whole sequence. Null and empty texts have no shingle,
    link with nothing and are their own component. Repeated rows and ids are
    members like others. A null doc_id never names a component unless all ids
    in it are null. Only doc_id and text are read, so other columns cannot
    clash. An empty table gives an empty result. A text of any length is taken
    whole; its words are hashed a piece at a time. docs has to give the same
    rows each time it is read. Columns rows_by, doc_id if there are none, tell
    rows of one text apart; that only saves work.
    """
    with scratch(docs.sparkSession):
        sets, final = _classes(docs, words, percent, block, block_grams, most_bits, rows_by or ["doc_id"])
    labelled = sets.select("doc_id", "s", "n").join(final.withColumnRenamed("vertex", "s"), "s", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "s")))
    labelled = labelled.select("doc_id", "n", "c")
    least = labelled.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return labelled.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def text_groups(docs: DataFrame, **options) -> DataFrame:
    """(text_key, group_key): the digest of each distinct text that has shingles, and the least digest that links reach."""
    texts = docs.select(digest(text_of()).alias("doc_id"), F.col("doc_id").alias("__row"), "text")
    return jaccard_components(texts, rows_by=["__row"], **options).where("n_shingles > 0").select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("group_key")).distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: one row of each component stays, of the least doc_id, nulls last.

    Among rows of one doc_id the digests of the text and of the other columns
    decide; of rows equal in all columns one stays. Texts without shingles link
    with nothing, so their rows all stay.
    """
    rest = digest(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]), {"ignoreNullFields": "false"}))
    keyed = docs.withColumn("__text", digest(text_of())).withColumn("__rest", rest)
    with scratch(docs.sparkSession):
        groups = stored(text_groups(docs, **options), "text-groups")
        rows = keyed.select("__text", "__rest", F.col("doc_id").alias("__id")).join(groups.withColumnRenamed("text_key", "__text"), "__text", "left")
        rows = stored(rows, "text-rows", result=True)
    first = rows.where("group_key is not null").groupBy("group_key").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__text"), F.col("__rest"))).alias("x"))
    alone = rows.where("group_key is null").select("__text", "__rest", F.lit(True).alias("__all")).distinct()
    stay = first.select("x.__text", "x.__rest", F.lit(False).alias("__all")).unionByName(alone)
    # Of rows equal in all columns one stays, unless their text has no shingles: then each is told by a number of its own.
    numbered = keyed.withColumn("__row", F.monotonically_increasing_id()).join(stay, ["__text", "__rest"])
    kept = numbered.withColumn("__row", F.when(F.col("__all"), F.col("__row"))).dropDuplicates(["__text", "__rest", "__row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
