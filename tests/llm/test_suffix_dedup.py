from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cluewright.llm import suffix_dedup as S


def by_hand(texts, span):
    """Remaining bytes and runs of each text."""
    data = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for b in data:
        for i in range(len(b) - span + 1):
            h = hash(b[i : i + span])
            (twice if h in seen else seen).add(h)
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if hash(b[i : i + span]) in twice:
                gone[i : i + span] = b"\1" * span
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8).astype(int), 0]))
        out.append((bytes(x for x, g in zip(b, gone) if not g), [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2])], len(b)))
    return out


def result(df):
    return [(bytes(r.kept), [(s.start, s.end) for s in r.spans], r.n_bytes) for r in df.collect()]


def test_query(spark, sf, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op2_suffix_dedup(spark, sf).collect()}
    want = {i: (n, sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest()) for (i, _), (kept, runs, n) in zip(documents, by_hand([t for _, t in documents], 200))}
    assert got == want
    assert any(n for _, n, _, _ in got.values())


def texts_of(seed, n, alphabet, span):
    """Texts that share passages of about span letters, some within themselves, some with runs of one letter."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(span - 3, 3 * span)) for _ in range(8)] + ["a" * rng.randint(span, 4 * span), "ab" * span]
    out = []
    for _ in range(n):
        parts = [word(rng.randint(0, 2 * span))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 4) : len(p) - rng.randint(0, 4)], word(rng.randint(0, span))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abcdefgh"), (2, "ab"), (3, "aé日x ")])
def test_shared_passages(spark, seed, alphabet):
    texts = texts_of(seed, 60, alphabet, 20)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for bits, most in ((8, 4096), (20, 4096), (20, 3), (8, 3)):
        got = S.suffix_dedup(docs, span=20, gram=10, cover=4, bits=bits, most_classes=most)
        assert sorted(result(got)) == sorted(by_hand(texts, 20))


def test_one_passage_in_very_many_texts(spark, monkeypatch):
    """A hot bucket, larger than what is sorted at once."""
    monkeypatch.setattr(S, "CHUNK", 1 << 12)
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = word(45)
    texts = [word(rng.randint(0, 60)) + passage + word(rng.randint(0, 60)) for _ in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for most in (4096, 50):
        assert sorted(result(S.suffix_dedup(docs, span=20, gram=10, cover=4, most_classes=most))) == sorted(by_hand(texts, 20))


def test_sorting_kernel_against_a_plain_sort():
    rng = np.random.default_rng(8)
    for span, cover in ((20, 4), (16, 8)):
        texts = [rng.choice([97, 98], rng.integers(span, 3 * span)).astype(np.uint8) for _ in range(30)]
        texts += [np.full(2 * span, 97, np.uint8), np.full(3 * span, 97, np.uint8)]
        h = np.sort(rng.integers(0, 3, len(texts)).astype(np.int64))
        pre = np.zeros(len(texts), np.int64)
        offs = np.r_[0, np.cumsum([len(t) for t in texts])]
        own, a, b = S.repeated_suffixes(h, pre, np.concatenate(texts), offs, span, cover)
        got = {(int(o), i) for o, s, e in zip(own, a, b) for i in range(s, e)}
        where: dict = {}
        for o, t in enumerate(texts):
            for i in range(len(t) - span + 1):
                where.setdefault((int(h[o]), i, t[i : i + span].tobytes()), []).append((o, i))
        assert got == {x for xs in where.values() if len(xs) > 1 for x in xs}


def test_odd_rows(odd, none):
    docs = odd.withColumn("KEPT", F.lit("mine")).withColumn("key", F.lit(1))
    out = S.suffix_dedup(docs)
    assert sorted(result(out)) == sorted(by_hand([r.text for r in odd.collect()], 200))
    assert [c.lower() for c in out.columns].count("kept") == 1
    assert S.suffix_dedup(none).count() == 0
