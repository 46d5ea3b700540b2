"""Best-fit packing planned on the histogram of lengths.

Texts become token ids and pieces of at most `room` tokens. The histogram of
piece lengths, which has at most `room` rows, is all the planner needs: it
runs best fit over counts, from the longest length down, and gives blocks of
slots. Pieces then take the slots of their length by their rank within it.
Ranks come from salted windows and their offsets, so that a length that very
many pieces share is never ranked in one task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import load, stored, text_of

ROOM, END_ID = 2048, 0
#: A run of white space over this many letters is beyond the fast encoder's stack.
LONG_RUN = 10_000
_LONG = re.compile(r"\s{%d}" % LONG_RUN)
#: Pieces that one ranking window holds, about.
WINDOW_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a tokenizers file. Strings of added tokens in a text are those tokens."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """The same ids from tiktoken, several times as fast; it cannot take long runs of white space."""
    import public_tokenizers
    import tiktoken

    # The file writes bytes as letters: printable ones as themselves, the others, in order, from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in said["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str) -> np.ndarray:
    """Ids of a whole text. A text with a run of white space over LONG_RUN is one for the tokenizers library itself."""
    if len(text) > LONG_RUN and _LONG.search(text):
        return np.array(encoder(path).encode(text, add_special_tokens=False).ids, "<u4")
    return fast_encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


def _cut(path: str, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(path, text.as_py()), END_ID).astype("<u4")
                first = len(ids) % room or room
                cuts = [0, *range(first, len(ids) + 1, room)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """Pieces of every document: its token ids and a closing END_ID, cut into pieces of room tokens of which the first may be shorter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_cut(path, room), PIECES)


def plan(histogram: dict[int, int], room: int = ROOM) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over counts: blocks (length, first rank, bins, copies in a bin, first sequence, offset) and the number of sequences.

    Bins filled alike are one group: there are two new groups for a length at
    most, and a group has few distinct lengths, so the plan's size depends on
    room alone. A piece of rank r in a block lies in sequence first +
    (r - first rank) // copies at offset + (r - first rank) % copies * length.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}  # room left -> [(bins, ((length, copies), ...))]
    left: list[int] = []

    def put(room_left: int, bins: int, filled: tuple) -> None:
        if bins:
            if room_left not in groups:
                groups[room_left] = []
                bisect.insort(left, room_left)
            groups[room_left].append((bins, filled))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            i = bisect.bisect_left(left, length)
            if i < len(left):
                space = left[i]
                bins, filled = groups[space].pop()
                if not groups[space]:
                    del groups[space], left[i]
            else:
                space, filled = room, ()
                bins = -(-n // (room // length))
            each = space // length
            full = min(bins, n // each)
            put(space - each * length, full, (*filled, (length, each)))
            n -= full * each
            if full < bins:
                if n:
                    put(space - n * length, 1, (*filled, (length, n)))
                    full, n = full + 1, 0
                put(space, bins - full, filled)
    out, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for space in sorted(groups):
        for bins, filled in groups[space]:
            at = 0
            for length, each in filled:
                out.append((length, rank[length], bins, each, sequence, at))
                rank[length] += bins * each
                at += each * length
            sequence += bins
    return out, sequence


def _placed(blocks: list[tuple]):
    table = np.array(sorted(blocks), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.int64(1) << 48  # ranks stay below it
        key = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            _, first, _, each, sequence, at = table[np.searchsorted(key, length * step + rank, "right") - 1].T
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(sequence + (rank - first) // each), pa.array(at + (rank - first) % each * length)],
                [*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the closing id alone. Texts of any
    length are cut, never shortened. Repeated rows and ids, and null ids, are
    packed each by itself. Only doc_id and text are read, so other columns
    cannot clash. An empty table has no pieces.
    """
    cut = stored(pieces(docs, path or vocabulary(), room), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, _ = plan(sizes, room)
    salts = max(8, sum(sizes.values()) // WINDOW_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(_placed(blocks), PIECES + ", sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
