from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from cluewright.llm import sentencepieces as P

#: Rules of a small character map: ligature, two letters to one, white space to space, dropped letter, one that begins with white space.
RULES = {"ﬁ": "fi", "é": "é", "　": " ", "\t": " ", "​": "", "①": "1", "Ａ": "A", "ab": "", "½": " 1/2", "ẍ́": "y"}


def compiled(rules: dict[str, str]) -> bytes:
    """A compiled character map: a double array whose units are placed one after another, and the texts."""
    texts, at = b"", {}
    for source, made in rules.items():
        at[source.encode()] = len(texts)
        texts += made.encode() + b"\0"
    tree: dict = {}
    for source in at:
        node = tree
        for b in source:
            node = node.setdefault(b, {})
        node[None] = at[source]
    units = [0] * 65536
    taken, free = {0}, [256]

    def put(place: int, node: dict, label: int) -> None:
        while True:  # offsets over 2**21 are never needed here; below 2**21 they stand as they are
            base = free[0] = free[0] + 256
            offset = place ^ base
            if offset < 1 << 21:
                break
        units[place] = offset << 10 | label | (256 if None in node else 0)
        taken.add(place)
        if None in node:
            units[base] = 1 << 31 | node[None]
        for b, child in node.items():
            if b is not None:
                put(base ^ b, child, b)

    put(0, tree, 0)
    size = free[0] + 256
    blob = b"".join(u.to_bytes(4, "little") for u in units[:size])
    return len(blob).to_bytes(4, "little") + blob + texts


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def changed(raw: bytes, charsmap: bytes = b"", prefix: int = 1, strip: int = 0) -> bytes:
    spec = b"\x12" + varint(len(charsmap)) + charsmap + bytes([0x18, prefix, 0x20, strip])
    return raw + b"\x1a" + varint(len(spec)) + spec


@pytest.fixture(scope="module")
def raw():
    return open(P.vocabulary(), "rb").read()


def spans(library, text):
    """Bytes of the source of each piece, as the library gives them."""
    out, proto = [], library.encode(text, return_type="proto")
    for p in proto.pieces:
        out.append((p.id, p.begin, p.end))
    return out


def test_against_library(spark, sf, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=P.vocabulary())
    got = {r.doc_id: r for r in P.op13_sentencepiece(spark, sf).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        ids = library.encode(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((text or "").encode()))
        assert tuple(got[doc_id])[1:] == want


def test_spans(spark, sf, raw, documents):
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    m = P.Model(raw)
    for _, text in documents[:40]:
        ids, first, last, pieces = m.encoded([text])
        assert list(zip(ids, first, last)) == spans(library, text)
        assert pieces == [len(ids)]


ODD = ["", " ", "  two  spaces ", "▁mark▁ ▁", "é ü 日本語 😀😀 x", "a\tb\n\nc", "\x00\x01", "x" * 3000, "<s> </s> <unk> <0x0A>", "   ", "ﬁne é 　 ​①Ａ ab½½ ẍ́ẍ", "ab", "　　a　", "½ ½a ", "é" * 5]


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("strip", [0, 1])
@pytest.mark.parametrize("ruled", [0, 1])
def test_normalisation_and_spans(raw, prefix, strip, ruled):
    """With and without a character map, a prefix and stripping: ids and spans as the library gives them."""
    made = changed(raw, compiled(RULES) if ruled else b"", prefix, strip)
    library, m = sentencepiece.SentencePieceProcessor(model_proto=made), P.Model(made)
    rng = random.Random(1)
    letters = [*"ab \t xe", "́", "̈", "ﬁ", "　", "​", "①", "½", "é", "日", "😀"]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(400)]
    if ruled:
        assert {s.decode() for s in m.map.sources()} == set(RULES)
    ids, first, last, pieces = m.encoded(texts)
    assert [int(x) for x in ids] == [i for t in texts for i in library.encode(t)]
    at = 0
    for t, n in zip(texts, pieces):
        want = spans(library, t)
        assert [(int(i), int(a), int(b)) for i, a, b in zip(ids[at : at + n], first[at : at + n], last[at : at + n])] == want, repr(t)
        at += n


def test_forgets(raw, monkeypatch):
    """A worker that forgets its words again and again gives the same pieces."""
    monkeypatch.setattr(P, "HELD", 2000)
    library, m = sentencepiece.SentencePieceProcessor(model_proto=raw), P.Model(raw)
    for i in range(30):
        texts = [" ".join(f"word{i * 7 + k}" for k in range(j)) for j in range(12)]
        ids, _, _, pieces = m.encoded(texts)
        assert ids.tolist() == [x for t in texts for x in library.encode(t)]
        assert pieces.tolist() == [len(library.encode(t)) for t in texts]


def test_odd_rows(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=P.vocabulary())
    rows = odd.collect()
    got = P.encode(odd.withColumn("IDS", F.lit(7)), decode=True)
    assert sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in got.collect()))) == sorted(str((r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or "")))) for r in rows)
    assert [c.lower() for c in got.columns].count("ids") == 1
    assert P.encode(none, decode=True).count() == 0
    back = P.decode(P.encode(odd).withColumn("decoded", F.lit(1)))
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in got.collect())
    assert [r.decoded for r in P.decode(odd.select(F.lit(None).cast("array<int>").alias("ids")).limit(1)).collect()] == [""]
