"""Quality rules: per-text repetition rules, then lines that too many documents of one host share.

One Arrow pass over the texts gives their counts and the hash of each
normalised line. Documents of a host are counted for each line hash; lines
above the host's limit are removed, and a document that loses too many of its
words this way is rejected as depleted. Only hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import digest, load, replaced, stored, text_of, without

#: A line is common on a host if over LINE_DOCUMENTS of its documents have it, however many documents there are. On a small host
#: over LINE_SHARE of them is enough, but not fewer than over LEAST_DOCUMENTS.
LINE_SHARE, LINE_DOCUMENTS, LEAST_DOCUMENTS = 0.05, 20, 10
#: Exact copies count as one document.
COPIES_ONCE = True
#: A document that keeps less than this share of its words is depleted.
LEAST_KEPT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"
_OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words", "__text", "__host", "__common", "line_hash", "line_words"]


def _again(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, hash): is it an occurrence after the first; does it occur at least twice."""
    order = np.lexsort((h, row))  # stable: equal ones stay in their order
    hs, rs = h[order], row[order]
    same = np.zeros(len(h), bool)
    same[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order] = same
    twice[order] = same | np.r_[same[1:], False]
    return later, twice


def _line_keys(data: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines with a word: first byte, end, row, number of words, and the key: the hash of the line without white space at its ends and with A-Z lower-cased."""
    ls, le, row = K.lines(data, offs)
    # Words of a line. A word never crosses a line.
    lo, hi = np.searchsorted(start, ls), np.searchsorted(start, le)
    has = hi > lo
    lo, hi = lo[has], hi[has]
    return ls[has], le[has], row[has], hi - lo, K.hash_spans(data, start[lo], end[hi - 1], lower=True)


def text_stats(column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Counts and line hashes of a column of texts, as STATS. Bytes are hashed a piece at a time, however long a text is."""
    for _, _, data, offs in K.chunks(column):
        n = len(offs) - 1
        start, end, row = K.words(data, offs)
        count = lambda own: np.bincount(own, minlength=n)
        solid = ~K._IS_SPACE[data] & ((data & 0xC0) != 0x80)
        total = lambda flags: np.diff(np.r_[np.int32(0), np.cumsum(flags, dtype=np.int32)][offs]).astype(np.int64)
        chars, symbols = total(solid), total(_SYMBOL[data])
        del solid
        shingle, own = K.shingles(K.hash_spans(data, start, end), row, WINDOW)
        whole = count(row)[own] >= WINDOW  # shorter texts have no window
        _, twice = _again(shingle[whole], own[whole])
        in_window = np.zeros(len(start), bool)
        if twice.any():
            first = np.r_[0, np.cumsum(count(row))][:-1]
            mine = own[whole]
            at = first[mine] + np.arange(len(mine)) - np.searchsorted(mine, mine)
            for i in range(WINDOW):
                in_window[at[twice] + i] = True
        ls, le, lrow, words, key = _line_keys(data, offs, start, end)
        later, _ = _again(K.hash_spans(data, ls, le), lrow)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(count(row)),
                pa.array(chars),
                pa.array(symbols),
                pa.array(count(lrow[later])),
                pa.array(count(row[in_window])),
                K.list_array(key.view(np.int64), lrow, n),
                K.list_array(words.astype(np.int32), lrow, n),
            ],
            ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
        )


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rest = 0, [c for c in batch.schema.names if c != "__t"]
        for stats in text_stats(batch.column(batch.schema.get_field_index("__t"))):
            part = batch.slice(at, stats.num_rows)
            at += stats.num_rows
            yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(c)) for c in rest], *stats.columns], [*rest, *stats.schema.names])


def _cleaned(data: np.ndarray, offs: np.ndarray, common: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows without their lines of common keys. Lines that stay are joined by one line break."""
    start, end, _ = K.words(data, offs)
    first, last, row, _, key = _line_keys(data, offs, start, end)
    key = key.view(np.int64)
    gone = np.zeros(len(first), bool)
    at = np.searchsorted(row, np.arange(len(offs)))
    for r, keys in enumerate(common):
        if keys is not None:
            gone[at[r] : at[r + 1]] = np.isin(key[at[r] : at[r + 1]], keys)
    ls, le, lrow = K.lines(data, offs)
    out = np.zeros(len(ls), bool)
    out[np.searchsorted(le, last[gone])] = True  # ends of lines are distinct but for empty ones, and these have no word
    # A line goes with the break after it; behind the last line that stays nothing does.
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, ls[out], 1)
    np.add.at(edge, np.minimum(le[out] + 1, offs[lrow[out] + 1]), -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    stays = np.flatnonzero(~out)
    end_of_row = offs[:-1].copy()
    np.maximum.at(end_of_row, lrow[stays], le[stays])
    hit = np.unique(lrow[out])
    for r in hit:
        keep[end_of_row[r] : offs[r + 1]] = False
    return data[keep], np.r_[0, np.cumsum(keep)][offs]


def _without_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts, common = batch.column(at), batch.column(batch.schema.get_field_index("__common"))
        rest = [c for c in batch.schema.names if c != "__common"]
        for top, last, data, offs in K.chunks(texts):
            part = batch.slice(top, last - top).select(rest)
            own = common.slice(top, last - top)
            if own.null_count < len(own):
                valid = own.is_valid().to_pylist()
                body, ends = _cleaned(data, offs, [own[i].values.to_numpy() if ok else None for i, ok in enumerate(valid)])
                kind = pa.large_string() if len(body) >> 31 else pa.string()
                made = pa.Array.from_buffers(kind, len(own), [None, pa.py_buffer(ends.astype(np.int64 if kind == pa.large_string() else np.int32)), pa.py_buffer(np.ascontiguousarray(body))]).cast(texts.type)
                part = replaced(part, "text", made)
            yield part


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the columns of STATS, one per row; null and empty texts have zeros and no lines."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], STATS])
    return docs.withColumn("__t", text_of()).mapInArrow(_stats_rows, schema)


def quality_rules(docs: DataFrame, share: float = LINE_SHARE, documents: int = LINE_DOCUMENTS, least_kept: float = LEAST_KEPT, texts: bool = True, copies_once: bool = COPIES_ONCE) -> DataFrame:
    """docs with their counts, base_failed, kept, and (texts) their common lines removed.

    base_failed: fewer than 50 words, or over half of them in 3-word windows
    found twice or more. A line is common if over `documents` documents of its
    source have it in normalised form, or over `share` of them and over
    LEAST_DOCUMENTS; the share never raises the limit of a large source. With
    copies_once exact copies count as one document, so that copies alone never
    make a line common. kept is false for base_failed rows and for rows that
    keep under `least_kept` of their words. Null texts count as empty, a null
    source is a source of its own; repeated rows and ids are judged each by
    itself. Columns of the names made here are replaced, others kept. An empty
    table gives an empty result. Texts of any length are taken whole.
    """
    docs = without(docs, _OWN)
    slim = docs.select(text_of().alias("text"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__host"))
    stats = with_stats(slim).select(digest(F.col("text")).alias("__text"), "__host", *_OWN[:5], "line_hash", "line_words")
    own = ["__text", "__host"]
    measured = stored(stats.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in [*_OWN[:5], "line_hash", "line_words"]]), "stats")
    many = F.count(F.lit(1)) if copies_once else F.sum("__n")
    hosts = measured.groupBy("__host").agg(many.alias("n"))
    common = (
        measured.select("__host", "__n", F.explode(F.array_distinct("line_hash")).alias("h"))
        .groupBy("__host", "h")
        .agg(many.alias("found"))
        .where(F.col("found") > min(documents, LEAST_DOCUMENTS))
        .join(hosts, "__host")
        .where(F.col("found") > F.least(F.lit(documents), F.greatest(F.lit(LEAST_DOCUMENTS), share * F.col("n"))))
        .select("__host", "h")
    )
    lost = (
        measured.select("__text", "__host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x"))
        .select("__text", "__host", F.col("x.line_hash").alias("h"), F.col("x.line_words").alias("w"))
        .join(common, ["__host", "h"])
        .groupBy("__text", "__host")
        .agg(F.sum("w").alias("n_common_words"), *([F.collect_set("h").alias("__common")] if texts else []))
    )
    judged = measured.join(lost, ["__text", "__host"], "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = judged.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("n_words") - F.col("n_common_words") >= least_kept * F.col("n_words")))
    judged = judged.select("__text", "__host", *_OWN[:8], *(["__common"] if texts else []))
    out = docs.withColumn("__text", digest(text_of())).withColumn("__host", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    if not texts:
        return out.join(judged, ["__text", "__host"]).select(*[F.col(f"`{c}`") for c in docs.columns], *_OWN[:8])
    schema = ", ".join([f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{f.name}` {f.dataType.simpleString()}" for c in _OWN[:8] for f in [judged.schema[c]]])
    joined = out.withColumn("text", text_of()).join(judged, ["__text", "__host"])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *_OWN[:8], "__common").mapInArrow(_without_common, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs, texts=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")
