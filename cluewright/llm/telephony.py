"""Media columns for telephony audio: store 8 kHz codec bytes as WAVE files, read them back, decode, resample.

Mu-law and A-law expand by 256-entry tables. IMA ADPCM decodes one nibble of
every block at a time: a step is a few numpy operations across all blocks at
hand, and blocks do not depend on each other. PCM is resampled from 8 to
16 kHz by a half-band filter in exact integer arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import load, text_of, without

RATE, UNIT, PAD = 8000, 576, 255
CODECS = ("mulaw", "alaw", "ima_adpcm")
_TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 0x11}
_NAMES = {v: k for k, v in _TAGS.items()}
#: Text bytes that are worked on at once, and samples of one call.
CHUNK = 1 << 20
BLOCK = 1 << 18


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(step == 0, part + 8, part + 0x108 << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# Fixed values of the IMA ADPCM format: step sizes, and what a code adds to the step's index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
     544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)

_HALF = 8  # taps on each side of a half-band filter, Hann-windowed, in 1/32768
_k = np.arange(_HALF) + 0.5
_taps = np.round(np.sinc(_k) * np.cos(np.pi * _k / (2 * _HALF)) ** 2 * 32768)
_taps[0] += 16384 - _taps.sum()
FILTER = np.r_[_taps[::-1], _taps]


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode blocks, one per row: 4 bytes of state, then nibbles, low one first. A step index over 88 counts as 88."""
    state = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = blocks[:, 4:]
    codes = np.empty((data.shape[1] * 2, len(data)), np.uint8)
    codes[0::2], codes[1::2] = (data & 15).T, (data >> 4).T
    out = np.empty((len(codes) + 1, len(data)), np.int16)
    out[0] = state
    for i, code in enumerate(codes):
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        state = np.clip(state + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + MOVES[code], 0, 88)
        out[i + 1] = state
    return out.T


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: those given, and between them what the half-band filter makes; ends are padded with zeros.

    It goes through the samples a block at a time, each with the filter's reach on both sides.
    """
    n = len(pcm)
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        lo, hi = max(0, at - (_HALF - 1)), min(n, end + _HALF)
        x = np.r_[np.zeros(max(0, _HALF - 1 - at)), pcm[lo:hi].astype(np.float64), np.zeros(max(0, end + _HALF - n))]
        # Products and sums stay far below 2**53, so this is exact.
        out[2 * at + 1 : 2 * end : 2] = np.clip(np.floor((np.convolve(x, FILTER, "valid") + 16384) / 32768), -32768, 32767)
    return out


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file that holds payload as it is, in 8-bit samples or whole ADPCM blocks of UNIT bytes."""
    if codec == "ima_adpcm":
        per_block = (UNIT - 4) * 2 + 1
        form = struct.pack("<HHIIHHHH", _TAGS[codec], 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
        samples = len(payload) // UNIT * per_block
    else:
        form = struct.pack("<HHIIHHH", _TAGS[codec], 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    parts = [(b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload)]
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, payload = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = _NAMES.get(struct.unpack_from("<H", media, at + 8)[0])
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if codec is None or payload is None:
        raise ValueError("no telephony codec or no data in this file")
    return codec, payload


def decoded(payloads: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM at 8 kHz of (codec, payload) pairs; the ADPCM blocks of all of them decode together, so many at a time as have BLOCK samples or so."""
    own = [np.frombuffer(p, np.uint8) for c, p in payloads if c == "ima_adpcm"]
    blocks = np.concatenate(own).reshape(-1, UNIT) if own else np.zeros((0, UNIT), np.uint8)
    pcm = np.empty((len(blocks), (UNIT - 4) * 2 + 1), np.int16)
    step = max(1, BLOCK // pcm.shape[1])
    for k in range(0, len(blocks), step):
        pcm[k : k + step] = adpcm(blocks[k : k + step])
    out, at = [], 0
    for codec, payload in payloads:
        if codec == "ima_adpcm":
            n = len(payload) // UNIT
            out.append(pcm[at : at + n].reshape(-1))
            at += n
        else:
            out.append((MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, np.uint8)])
    return out


def features(codec: str, pcm: np.ndarray, wide: bytes) -> str:
    """What a call sounds like, from exact sums over blocks of its samples, and the resampled PCM's size and checksum."""
    total = power = crossings = peak = 0
    for at in range(0, len(pcm), BLOCK):
        x = pcm[at : at + BLOCK + 1].astype(np.int64)  # one sample more, for the crossing to the next block
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:BLOCK]
        total, power, peak = total + int(x.sum()), power + int((x * x).sum()), max(peak, int(np.abs(x).max()))
    n = len(pcm)
    return f"codec={codec};samples={n};peak={peak};mean={total // n};power={power // n};crossings={crossings};pcm16k_samples={len(wide) // 2};pcm16k_crc32={zlib.crc32(wide)}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__t")
        rest = [c for c in batch.schema.names if c != "__t"]
        for first, last, data, offs in K.chunks(batch.column(at), CHUNK):
            media = []
            for a, b in zip(offs, offs[1:]):
                payload = data[a:b].tobytes()
                payload += bytes([PAD]) * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))
                media.append(wave(payload, CODECS[zlib.crc32(payload) % len(CODECS)]))
            back = [unwave(m) for m in media]
            pcm = decoded(back)
            wide = [resampled(x).astype("<i2", copy=False).tobytes() for x in pcm]
            feature = [features(c, x, w) for (c, _), x, w in zip(back, pcm, wide)]
            part = batch.slice(first, last - first)
            made = {
                "codec": pa.array([c for c, _ in back]),
                "payload": pa.array([p for _, p in back], pa.binary()),
                "media": pa.array(media, pa.binary()),
                "feature": pa.array(feature),
                "pcm16k": pa.array(wide, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in rest], *made.values()], [*rest, *made])


def media_columns(docs: DataFrame) -> DataFrame:
    """docs with text replaced by codec, payload, media (a WAVE file), feature and pcm16k, the call resampled to 16 kHz, as 16-bit samples.

    The text's bytes, filled up with 255 to a positive multiple of 576, stand
    for a call's codec bytes; a checksum of them picks the codec, so equal
    texts give equal values. payload is what was read back from media. Null
    and empty texts are one unit of filling. Other columns pass through,
    unless they have the name of a column made here. Rows are independent, so
    repeated rows, null ids and empty tables need no rule. A text of any
    length, up to the 2 GB of a column's value, is one file; its samples are
    worked on in blocks.
    """
    made = ["codec", "payload", "media", "feature", "pcm16k"]
    docs = without(docs, [*made, "__t"])
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], *[f"{c} {'string' if c in ('codec', 'feature') else 'binary'}" for c in made]])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest], text_of().alias("__t")).mapInArrow(_rows, schema)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return media_columns(docs).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm16k").cast("long").alias("pcm16k_bytes"),
        F.sha2("pcm16k", 256).alias("pcm16k_sha256"),
    )
