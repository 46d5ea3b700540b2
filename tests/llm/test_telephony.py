from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from cluewright.llm import telephony as T


def padded(text):
    b = (text or "").encode()
    return b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))


def mulaw(u):
    u = ~u & 0xFF
    t = ((u & 0x0F) << 3) + 0x84
    t <<= (u & 0x70) >> 4
    return 0x84 - t if u & 0x80 else t - 0x84


def alaw(a):
    a ^= 0x55
    t = (a & 0x0F) << 4
    seg = (a & 0x70) >> 4
    t = t + 8 if seg == 0 else (t + 0x108) << (seg - 1)
    return t if a & 0x80 else -t


def adpcm(block):
    """One block, one sample at a time."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(T.STEPS[index])
            diff = step >> 3
            if code & 1:
                diff += step >> 2
            if code & 2:
                diff += step >> 1
            if code & 4:
                diff += step
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(value)
    return out


def test_tables():
    assert [int(x) for x in T.MULAW] == [mulaw(i) for i in range(256)]
    assert [int(x) for x in T.ALAW] == [alaw(i) for i in range(256)]


def test_adpcm_blocks_one_by_one():
    blocks = np.random.default_rng(3).integers(0, 256, (9, 576), dtype=np.uint8)
    assert [list(map(int, x)) for x in T.adpcm(blocks)] == [adpcm(bytes(b)) for b in blocks]


def test_resampling_keeps_samples_and_constants():
    pcm = np.random.default_rng(4).integers(-32768, 32768, 500).astype(np.int16)
    assert (T.resampled(pcm)[0::2] == pcm).all()
    flat = T.resampled(np.full(200, 1000, np.int16))
    assert (np.abs(flat[40:-40].astype(int) - 1000) <= 1).all()
    tone = np.round(8000 * np.sin(2 * np.pi * 440 * np.arange(2000) / 8000)).astype(np.int16)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(4000) / 16000)
    assert np.abs(T.resampled(tone)[200:-200] - want[200:-200]).max() < 80


def test_blocks_of_samples(monkeypatch):
    """Whatever the size of a block: the same samples and features."""
    rng = np.random.default_rng(6)
    pcm = rng.integers(-32768, 32768, 1000).astype(np.int16)
    payloads = [(c, rng.integers(0, 256, 576 * 4, dtype=np.uint8).tobytes()) for c in ("ima_adpcm", "alaw", "ima_adpcm")]
    wide = T.resampled(pcm)
    want = wide.tolist(), T.features("x", pcm, wide.tobytes()), [x.tolist() for x in T.decoded(payloads)]
    for block in (1, 7, 8, 333, 999, 1000):
        monkeypatch.setattr(T, "BLOCK", block)
        wide = T.resampled(pcm)
        assert (wide.tolist(), T.features("x", pcm, wide.tobytes()), [x.tolist() for x in T.decoded(payloads)]) == want


def test_wave_round_trip():
    for codec in T.CODECS:
        for n in (1, 2, 5):
            payload = np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
            assert T.unwave(T.wave(payload, codec)) == (codec, payload)


def test_query(spark, sf, documents):
    got = {r.doc_id: r for r in T.op4_telephony(spark, sf).collect()}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        r, p = got[doc_id], padded(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        codec = r.feature.split(";")[0].split("=")[1]
        media = T.wave(p, codec)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if len(p) < 3000:
            table = {"mulaw": mulaw, "alaw": alaw}
            pcm = np.array([table[codec](b) for b in p] if codec in table else [x for i in range(0, len(p), 576) for x in adpcm(p[i : i + 576])], np.int16)
            wide = T.resampled(pcm).astype("<i2").tobytes()
            assert r.feature == T.features(codec, pcm, wide)
            assert (r.pcm16k_bytes, r.pcm16k_sha256) == (len(wide), hashlib.sha256(wide).hexdigest())


def test_odd_rows(odd, none):
    out = T.media_columns(odd.withColumn("Media", F.lit("mine"))).collect()
    assert sorted(r.payload for r in out) == sorted(padded(r.text) for r in odd.collect())
    by = {}
    for r in out:
        assert by.setdefault(r.payload, (r.media, r.feature, r.pcm16k)) == (r.media, r.feature, r.pcm16k)
        samples = int(r.feature.split("samples=")[1].split(";")[0])
        assert len(r.pcm16k) == 4 * samples
    assert T.media_columns(none).count() == 0
