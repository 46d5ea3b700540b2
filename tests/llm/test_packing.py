from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cluewright.llm import packing as P


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def expected(tokenizer, rows, room):
    out = set()
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        first = len(ids) % room or room
        cuts = [0, *range(first, len(ids) + 1, room)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.add((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def valid(rows, room):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return len(places)


def best_fit(lengths, room):
    import bisect

    left = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, n)
        space = left.pop(i) if i < len(left) else room
        bisect.insort(left, space - n)
    return len(left)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.vocabulary())


def test_pieces_and_places(spark, sf, documents, tokenizer):
    out = P.op5_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == expected(tokenizer, documents, 2048)
    used = valid(out, 2048)
    assert used <= best_fit([r.length for r in out], 2048)


def test_ids_of_odd_texts(tokenizer):
    texts = ["", " ", "\n\n", "<|endoftext|> x", "a <|endoftext|>b<|endoftext|>", "don't  stop\t\tnow", "日本語", "🙂é́", "a" * 5000, "12345678 1,000.5", "\x00\x01\x7f", " nbsp x", "".join(map(chr, range(32, 700)))]
    rng = random.Random(5)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 32, 10])) for _ in range(80)) for _ in range(200)]
    texts += [" " * n + "x" for n in (9_999, 10_000, 10_001, 1_000_000)] + ["\n" * 1_000_000, "a b " * 20_000 + "\t" * 12_000]
    for t in texts:
        assert P.token_ids(P.vocabulary(), t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:80])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_is_a_packing_as_good_as_best_fit(histogram):
    blocks, used = P.plan(histogram, 64)
    ranks, places = defaultdict(set), defaultdict(list)
    for length, first, bins, each, sequence, at in blocks:
        for r in range(bins * each):
            assert first + r not in ranks[length]
            ranks[length].add(first + r)
            places[sequence + r // each].append((at + r % each * length, length))
    assert {n: set(range(k)) for n, k in histogram.items()} == dict(ranks)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == used <= best_fit([n for n, k in histogram.items() for _ in range(k)], 64)


def test_one_length_that_all_share(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    out = P.pack(docs, room=16).collect()
    n = out[0].length
    assert valid(out, 16) == -(-3000 // (16 // n))


def test_odd_rows(odd, none, tokenizer):
    out = P.pack(odd.withColumn("offset", F.lit("mine")), room=64).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == expected(tokenizer, [(r.doc_id, r.text) for r in odd.collect()], 64)
    valid(out, 64)
    assert P.pack(none).count() == 0
