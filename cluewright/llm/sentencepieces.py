"""SentencePiece encoding that knows which bytes of the source each piece stands for, and decoding.

A text is normalised first: where a rule of the model's compiled character map
may begin, the longest rule is looked up in its double array, and every byte
of the result keeps the place of the source it came from. White space is
treated as the model says. The normalised text is cut where white space
begins, which no piece of such a model crosses, so that each distinct word is
encoded once by the library and then looked up. Lengths of pieces, summed up,
are places in the normalised text, and its alignment turns these into bytes of
the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import load, text_of, without

#: How a space is written in pieces.
MARK = "▁"
#: A model's message: fields of ModelProto, NormalizerSpec, TrainerSpec and SentencePiece that are read here.
PIECES, TRAINER, NORMALISER = 1, 2, 3
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 4, 5
PIECE, KIND, SUFFIX = 1, 3, 24
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
#: Bytes of words and their pieces that a worker remembers, about; then it begins anew.
HELD = 128 << 20
OUT = "ids array<int>, starts array<int>, ends array<int>"
_OWN = ["ids", "starts", "ends", "decoded", "__t"]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message, in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double array of source prefixes, and the texts that they become."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = blob[4 + size :]
        self._walk = self.units.tolist()

    @staticmethod
    def _offset(unit):
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, their replacement) of the longest rule that source has at `at`."""
        walk, found = self._walk, None
        if not walk:
            return None
        node = self._offset(walk[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(walk) or walk[node] & 0x800000FF != source[i]:
                break
            unit = walk[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, walk[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def sources(self) -> Iterator[bytes]:
        """All prefixes that have a rule."""
        labels, stack = np.arange(256), [(b"", int(self._offset(self._walk[0])))] if self._walk else []
        while stack:
            prefix, node = stack.pop()
            places = node ^ labels[1:]
            places = places[places < len(self.units)]
            for place in places[(self.units[places] & 0x800000FF) == (places ^ node)].tolist():
                unit = self._walk[place]
                source = prefix + bytes([place ^ node])
                if unit >> 8 & 1:
                    yield source
                stack.append((source, int(place ^ self._offset(unit))))


def _any_of(letters: set[str]) -> str:
    return "[" + "".join(map(re.escape, sorted(letters))) + "]"


class Model:
    """What a model file says of normalisation, and the library's encoder for text that is normalised already."""

    def __init__(self, raw: bytes):
        import sentencepiece

        said: dict[int, int | bytes] = {DUMMY_PREFIX: 1, EXTRA_SPACES: 1, ESCAPE: 1}
        self.suffix, symbols, crossing = False, [], False
        kinds: list[int] = []
        for number, value in _fields(raw):
            if number == NORMALISER:
                said |= dict(_fields(value))
            elif number == TRAINER:
                self.suffix = bool(dict(_fields(value)).get(SUFFIX, 0))
            elif number == PIECES:
                piece = dict(_fields(value))
                text, kind = piece[PIECE].decode(), piece.get(KIND, 1)
                if kind == USER_DEFINED:
                    symbols.append(text)
                crossing |= MARK in text.lstrip(MARK)
                kinds.append(kind)
        self.prefix, self.strip, self.escape = bool(said[DUMMY_PREFIX]), bool(said[EXTRA_SPACES]), bool(said[ESCAPE])
        self.map = CharacterMap(said.get(CHARSMAP, b""))
        self.symbols = sorted(symbols, key=len, reverse=True)
        #: Words are independent of each other if no piece holds white space behind a letter.
        self.by_words = not (crossing or symbols or self.suffix or not self.escape)
        self.is_byte, self.is_odd = np.array(kinds) == BYTE, np.isin(kinds, (UNKNOWN, BYTE)).astype(np.int64)
        # Of a field that stands twice the later values hold: no map, no prefix, all white space kept.
        plain = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, EXTRA_SPACES << 3, 0])
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=raw + bytes([NORMALISER << 3 | 2, len(plain)]) + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self._widths = np.array([len(p.encode()) for p in self.inner.id_to_piece(list(range(len(kinds))))], np.int32)
        self._starts = self._candidates()
        self._forget()

    def _candidates(self) -> re.Pattern | None:
        """Where a rule may begin: at a letter that is one by itself, or at the first of two letters that begin one."""
        alone, pairs = set(), {}
        for source in self.map.sources():
            text = source.decode()
            if len(text) == 1:
                alone.add(text)
            else:
                pairs.setdefault(text[1], set()).add(text[0])
        firsts = {x for first in pairs.values() for x in first}
        parts = [re.escape(s) for s in self.symbols]
        parts += [_any_of(alone)] if alone else []
        parts += [f"{_any_of(firsts)}(?={_any_of(set(pairs))})"] if pairs else []
        return re.compile("|".join(parts)) if parts else None

    def _ruled(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(bytes, place in the source of each, whether a unit of normalisation begins there, source bytes, where the first unit stands that became nothing), white space not yet treated."""
        source = text.encode()
        data = np.frombuffer(source, np.uint8)
        changed: list[tuple[int, int, bytes]] = []
        if self._starts is not None:
            at = where = seen = 0  # letters passed, their bytes
            while hit := self._starts.search(text, at):
                where += len(text[seen : hit.start()].encode())
                at = seen = hit.start()
                symbol = next((s for s in self.symbols if text.startswith(s, at)), None)
                if symbol:
                    rule = len(symbol.encode()), symbol.encode()
                else:
                    rule = self.map.longest(source, where)
                if rule is None:
                    at += 1
                    continue
                changed.append((where, *rule))
                where += rule[0]
                at = seen = at + len(source[where - rule[0] : where].decode())
        begins = (data & 0xC0) != 0x80
        if not changed:
            return data, np.arange(len(data)), begins, len(data), len(data)
        parts, places, units, last = [], [], [], 0
        for where, size, made in [*changed, (len(data), 0, b"")]:
            parts += [data[last:where], np.frombuffer(made, np.uint8)]
            # A source letter's bytes, and a rule's result, all come from where the unit begins.
            places += [np.arange(last, where), np.full(len(made), where)]
            units += [begins[last:where], np.arange(len(made)) == 0]
            last = where + size
        return np.concatenate(parts), np.concatenate(places), np.concatenate(units), len(data), next((where for where, _, made in changed if not made), len(data))

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, place in the source's bytes for each of its bytes and for its end)."""
        if not text:
            return "", np.zeros(1, np.int64)
        data, place, begins, end, dropped = self._ruled(text)
        place = np.maximum.accumulate(np.where(begins, place, 0)) if len(place) else place
        space, begin = data == 32, 0
        if self.strip and len(data):
            first = np.flatnonzero(begins)
            unit = np.cumsum(begins) - 1
            other = first[~(space[first] & (np.diff(np.r_[first, len(data)]) == 1))]  # units that are not one space
            begin = min(dropped, int(place[other[0]])) if len(other) else dropped
            # White space that begins a unit goes if white space stands before the unit, or nothing.
            solid = np.cumsum(~space)
            leading = space & (solid == (solid[first] - ~space[first])[unit])
            keep = ~(leading & np.r_[True, space[:-1]][first][unit])
            data, place, space = data[keep], place[keep], space[keep]
            if not len(data):
                return "", np.array([end])
        body, mark = data.tobytes(), MARK.encode() if self.escape else b" "
        if self.escape:
            body, place = body.replace(b" ", mark), np.repeat(place, np.where(space, len(mark), 1))
        if self.prefix and not self.suffix:
            body, place = mark + body, np.r_[np.repeat(begin, len(mark)), place]
        if self.strip:
            size = len(body)
            while body.endswith(mark, 0, size):
                size -= len(mark)
            if size < len(body):
                body, place, end = body[:size], place[:size], int(place[size])
        if self.prefix and self.suffix:
            body, place = body + mark, np.r_[place, np.repeat(end, len(mark))]
        return body.decode(), np.r_[place, end]

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._at, self._n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._used = self._held = 0

    def _lengths(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each piece stands for. Of a letter given in bytes the last piece has all."""
        size = self._widths[ids]
        if not self.is_byte[ids].any():  # a piece for unknown letters has no length of its own
            return np.array([len(p.surface.encode()) for p in self.inner.encode(text, return_type="proto").pieces], np.int32)
        source, at, i = text.encode(), 0, 0
        while i < len(ids):
            width = 1
            if self.is_byte[ids[i]]:
                width = 1 if source[at] < 128 else 2 if source[at] < 224 else 3 if source[at] < 240 else 4
                size[i : i + width] = 0
                size[i + width - 1] = width
            at += int(size[i + width - 1])
            i += width
        return size

    def _learn(self, words: list[str]) -> None:
        made = self.inner.encode(words, num_threads=1)
        n = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter(chain.from_iterable(made), np.int32, int(n.sum()))
        sizes, last = self._widths[ids], np.cumsum(n)
        for i in np.flatnonzero(np.add.reduceat(self.is_odd[ids], last - n) if len(ids) else n).tolist():
            own = slice(last[i] - n[i], last[i])
            sizes[own] = self._lengths(words[i], ids[own])
        k, end = len(self._known), self._used + len(ids)
        if end > len(self._ids):
            self._ids, self._sizes = (np.resize(x, max(end, 2 * len(x))) for x in (self._ids, self._sizes))
        if k + len(n) > len(self._at):
            self._at, self._n = (np.resize(x, max(k + len(n), 2 * len(x))) for x in (self._at, self._n))
        self._ids[self._used : end], self._sizes[self._used : end] = ids, sizes
        self._at[k : k + len(n)], self._n[k : k + len(n)] = self._used + last - n, n
        self._known.update(zip(words, range(k, k + len(n))))
        self._used = end
        self._held += 120 * len(n) + 2 * sum(map(len, words)) + 8 * len(ids)

    def _words(self, text: str) -> list[str]:
        return _WORD.findall(text) if self.by_words else [text] if text else []

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, end byte, number of pieces of each text): pieces of all texts one after another, with their places in the source's bytes."""
        norms = [self.normalised(t) for t in texts]
        cut = [self._words(norm) for norm, _ in norms]
        words = list(chain.from_iterable(cut))
        known = list(map(self._known.get, words))
        if None in known:
            if self._held > HELD:
                self._forget()
            self._learn([w for w in dict.fromkeys(words) if w not in self._known])
            known = list(map(self._known.get, words))
        k = np.array(known, np.int64)
        n = self._n[k]
        last = np.cumsum(n)
        take = np.repeat(self._at[k] - last + n, n) + np.arange(int(n.sum()))
        ids, sizes = self._ids[take], self._sizes[take].astype(np.int64)
        pieces = np.diff(np.r_[0, last][np.cumsum([0, *map(len, cut)])])
        # Each text's alignment has one place more than its normalised bytes.
        ends = np.cumsum(sizes) + np.repeat(np.arange(len(texts)), pieces)
        place = np.concatenate([p for _, p in norms])
        return ids, place[ends - sizes], place[ends], pieces


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _encode(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts, rest = batch.column(batch.schema.get_field_index("__t")), [c for c in batch.schema.names if c != "__t"]
            for top, end, _, _ in K.chunks(texts):
                ids, first, last, pieces = m.encoded(texts.slice(top, end - top).to_pylist())
                at = np.r_[0, np.cumsum(pieces)]
                row = np.repeat(np.arange(end - top), pieces)
                made = [K.list_array(x.astype(np.int32), row, end - top) for x in (ids, first, last)]
                if decode:
                    made.append(pa.array(m.whole.decode([ids[a:b].tolist() for a, b in zip(at, at[1:])], num_threads=1), pa.string()))
                part = batch.slice(top, end - top)
                yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in rest], *made], [*rest, "ids", "starts", "ends", *["decoded"] * decode])

    return run


def _decode(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [[] if x is None else [i for i in x if i is not None] for x in ids.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.whole.decode(own, num_threads=1), pa.string())], [*batch.schema.names, "decoded"])

    return run


def _ddl(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], more])


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """docs with ids, and starts and ends: the bytes of the source text that each piece stands for; with decode, what the ids decode to.

    A piece's bytes run to where the next one's begin, so that together they
    cover all that was not dropped as white space before or behind the text. A
    mark that the model sets before a text has no bytes. Of a letter that is
    written as byte pieces the last has the bytes. Null and empty texts have
    no pieces and decode to an empty text. Each row is encoded by itself:
    repeated rows and ids give repeated results. Columns of the names made here
    are replaced, others kept. An empty table gives an empty result. Texts of
    any length are taken whole.
    """
    docs = without(docs, _OWN)
    out = docs.withColumn("__t", text_of())
    return out.mapInArrow(_encode(path or vocabulary(), decode), _ddl(docs, OUT + ", decoded string" * decode))


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """encoded with decoded, the text of its ids. Null ids, and nulls among them, stand for nothing."""
    encoded = without(encoded, ["decoded"])
    return encoded.mapInArrow(_decode(path or vocabulary(), column), _ddl(encoded, "decoded string"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: source_bytes, the bytes from the first piece's first to the last one's last."""
    out = encode(load(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.when(F.size("ids") > 0, F.element_at("ends", -1) - F.element_at("starts", 1)).otherwise(0).cast("long").alias("source_bytes"),
    )
