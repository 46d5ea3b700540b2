"""Array kernels shared by the text operators.

They work on Arrow string columns without making Python strings: a column is
seen as one run of UTF-8 bytes and the offsets of its rows, and words, lines
and their hashes come from whole-array numpy operations. A hash is a
polynomial over the bytes modulo 2**64 with random odd constants, finished by
a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240501)
_BASE = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) * 2 + 1)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 20

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finish hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial sums; span_hash() reads any span off them."""
    _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * _powers[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end); equal spans have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, piece: int = CHUNK_BYTES) -> np.ndarray:
    """span_hash() of ascending spans that do not overlap, such as words or lines, with sums over a piece of the data at a time.

    The memory for sums depends on the piece, not on the text, and a span may
    be longer than a piece: what stands in later pieces adds to its polynomial.
    """
    total = np.zeros(len(start), np.uint64)
    for at in range(0, len(data), piece):
        part = data[at : at + piece]
        first, last = np.searchsorted(end, at, "right"), np.searchsorted(start, at + len(part))
        if first >= last:
            continue
        sums = prefix_sums(part, lower)
        a, b = np.maximum(start[first:last] - at, 0), np.clip(end[first:last] - at, 0, len(part))
        raw = (sums[b] - sums[a]) * _inverses[a]
        if start[first] < at:
            raw[:1] *= np.array([pow(int(_BASE), int(at - start[first]), 1 << 64)], np.uint64)
        total[first:last] += raw
    return mix(total + (end - start).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about limit bytes; null is empty.

    One row is never cut, so a longer text makes a longer run.
    """
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, body = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes other than space and \\t to \\r, within rows."""
    solid = ~_IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every line; a row always has one at least, which may be empty."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offs[:-1], breaks + 1], kind="stable")
    end = np.sort(np.r_[offs[1:], breaks], kind="stable")
    counts = np.bincount(np.searchsorted(offs, breaks, "right") - 1, minlength=len(offs) - 1) + 1 if len(breaks) else np.ones(len(offs) - 1, np.int64)
    return start, end, np.repeat(np.arange(len(offs) - 1), counts)


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n words of one row; a row with 1 to n - 1 words gives its whole sequence."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(hashes) - n + 1
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k > 0:
        h = np.full(k, n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + k])
        whole = row[:k] == row[n - 1 :]
        out, own = h[whole], row[:k][whole]
    count = np.bincount(row)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        h = count[short].astype(np.uint64)
        for i in range(n - 1):
            more = i < count[short]
            h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[more] + i])
        out, own = np.r_[out, h], np.r_[own, short]
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, in ascending order. Rows ascend."""
    if not len(h):
        return h, row
    bits = np.uint64(max(1, int(row[-1]).bit_length()))
    order = np.argsort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    h, row = h[order], row[order]
    near = np.flatnonzero((h[1:] >> bits == h[:-1] >> bits) & (row[1:] == row[:-1]) & (h[1:] < h[:-1]))
    if len(near):  # hashes that agree but for the bits that made room for the row
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    return h[new], row[new]


def list_array(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """Values, sorted by row, as one list for each of rows."""
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
