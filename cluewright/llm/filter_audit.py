"""What filters do to each other: kept, redundant and lost documents for every order of five filters.

Documents are routed by the xxhash of their text. Each task first settles what
it can by itself: of equal texts it has only rows of the least id go on, the
others are copies whatever happens elsewhere. Where routed texts meet, those
of one fingerprint form a chain of full texts, each with its least id, so that
two texts of one fingerprint are never taken for one; rows of other ids are
copies. Every document is then a mask of the filters that it fails. Masks are
counted into one vector per part, vectors are merged by combineByKey, and all
orders and steps are read off them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import load, stored, text_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes of texts that a task remembers to settle copies by itself. What is over goes on, and copies meet where they are routed.
HELD = 32 << 20
#: Bytes of texts that are routed to one task at most, about.
TASK_BYTES = 256 << 20
FLAGS = "doc_id long, part string, mask int, n long"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def text_masks(texts: list[str]) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits."""
    out = []
    for _, _, data, offs in K.chunks(pa.array(texts, pa.large_string())):
        n = len(offs) - 1
        start, end, row = K.words(data, offs)
        words = np.bincount(row, minlength=n)
        _, own = K.distinct_per_row(K.hash_spans(data, start, end), row)
        distinct = np.bincount(own, minlength=n)
        total = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offs])
        fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * total(_UPPER[data]) > MOST_UPPER * total((data & 0xC0) != 0x80), total(_SYMBOL[data]) > 0]
        out.append(sum(f.astype(np.int64) << i for i, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: Of one text: [text, mask, least id, {part: rows of that id}].
Entry = list


def _settled(entry: Entry, doc_id: int, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
    """Let rows of an id meet a text's entry; (doc_id, part, mask, n) of those that turn out to be copies."""
    if doc_id == entry[2]:
        for part, n in parts.items():
            entry[3][part] = entry[3].get(part, 0) + n
        return
    later = (doc_id, parts) if doc_id > entry[2] else (entry[2], entry[3])
    if doc_id < entry[2]:
        entry[2], entry[3] = doc_id, parts
    for part, n in later[1].items():
        yield later[0], part, entry[1] | COPY, n


def _routed(limit: int):
    """(route, what is routed): entries of texts by fingerprint, and rows that are settled by their id, so that they are spread evenly."""

    def run(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        def worked(run: list) -> Iterator[tuple[int, tuple]]:
            nonlocal held
            for r, mask in zip(run, text_masks([r.text for r in run]).tolist()):
                entry = seen.get(r.text)
                if r.doc_id is None:  # no id is smaller, and it is smaller than none
                    nameless[r.part, mask] = nameless.get((r.part, mask), 0) + 1
                elif entry is None:
                    seen[r.text] = [r.fingerprint, mask, r.doc_id, {r.part: 1}]
                    held += len(r.text) + 400
                else:
                    for x in _settled(entry, r.doc_id, {r.part: 1}):
                        yield x[0], x
            if held > limit:
                yield from emptied()

        def emptied() -> Iterator[tuple[int, tuple]]:
            nonlocal held
            for text, (fingerprint, *rest) in seen.items():
                yield fingerprint, (text, *rest)
            seen.clear()
            held = 0

        seen: dict[str, Entry] = {}
        nameless: dict[tuple[str, int], int] = {}
        held, some, size = 0, [], 0
        for r in rows:
            some.append(r)
            size += len(r.text)
            if size > K.CHUNK_BYTES:
                yield from worked(some)
                some, size = [], 0
        yield from worked(some)
        yield from emptied()
        for i, ((part, mask), n) in enumerate(sorted(nameless.items())):
            yield i, (None, part, mask, n)

    return run


def _chained(routed: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(doc_id, part, mask, n) of all that was routed here, in order of fingerprints: one chain is held at a time."""
    chain: dict[str, Entry] = {}
    now = None

    def closed() -> Iterator[tuple[int, str, int, int]]:
        for _, mask, doc_id, parts in chain.values():
            for part, n in parts.items():
                yield doc_id, part, mask, n
        chain.clear()

    for key, x in routed:
        if not isinstance(x[0], str):
            yield x
            continue
        if key != now:
            yield from closed()
            now = key
        text, mask, doc_id, parts = x
        if text in chain:
            yield from _settled(chain[text], doc_id, parts)
        else:
            chain[text] = [None, mask, doc_id, parts]
    yield from closed()


def failed_filters(docs: DataFrame, part: str = "lang", fingerprint: Column | None = None, held: int = HELD) -> DataFrame:
    """(doc_id, part, mask, n): rows of an id with one text, their part, and the filters they fail as bits, A the lowest.

    A: under 200 words; B: under half of them distinct; C: over 3 percent of
    the code points in A-Z; D: has one of #$%&*|; E: equal to the text of a
    smaller id. n counts rows of one id, text and part; a row with another,
    smaller id is no reason for E against rows of its own id. Rows without an
    id are never E and make none. A null text is empty, a null part the empty
    string. Only doc_id, text and the part's column are read, so that other
    columns cannot clash. An empty table gives no rows. Texts of any length are
    taken whole. docs has to give the same rows in the same order when a lost
    task reads them again, as a table does.

    A text goes over the network once for each task and `held` bytes of texts
    that have it, however many rows do. Tasks sort what reaches them by
    fingerprint, on disk where it does not fit, and hold one chain at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text") if fingerprint is None else fingerprint)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    flags = rows.rdd.mapPartitions(_routed(held)).repartitionAndSortWithinPartitions(tasks, lambda k: k % tasks).mapPartitions(_chained)
    return spark.createDataFrame(flags, FLAGS, verifySchema=False)


def copies(flags: DataFrame) -> DataFrame:
    """(doc_id,) of the documents that equal one of a smaller id, of failed_filters()."""
    return flags.where(F.col("mask").bitwiseAND(COPY) > 0).select("doc_id").distinct()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, vector): of a batch's rows the counts of all, good and toxic ones by mask."""
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        mask, n, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        at = parts.indices.to_numpy() * MASKS + mask
        made = np.zeros((3, len(parts.dictionary) * MASKS), np.int64)
        for k, own in enumerate((n, n * good, n * toxic)):
            np.add.at(made[k], at, own)
        vectors = [made[:, k * MASKS : (k + 1) * MASKS].tobytes() for k in range(len(parts.dictionary))]
        yield pa.RecordBatch.from_arrays([parts.dictionary, pa.array(vectors, pa.binary())], ["part", "vector"])


def interactions(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of OUT for a part: counts has all, good and toxic documents by mask."""
    masks = np.arange(MASKS)
    everything, good, toxic = counts
    shapley = dict.fromkeys(FILTERS, 0)
    rows = []
    for order in permutations(FILTERS):
        gone = np.zeros(MASKS, bool)
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = masks & bit > 0
            new = fails & ~gone
            removed = int(everything[new].sum())
            shapley[name] += removed
            rows.append((name, "".join(order), step, removed, int(everything[fails & gone].sum()), int(everything[bit]), int(good[new].sum()), int(toxic[new].sum())))
            gone |= fails
            rows[-1] += (int(everything[~gone].sum()),)
    for name, order, step, removed, redundant, unique, good_lost, toxic_lost, kept in rows:
        yield part, order, step, kept, removed, redundant, unique, good_lost, toxic_lost, shapley[name]


def audit(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    flags are of failed_filters(); labels have doc_id, quality and toxic. A
    document with several labels is good or toxic if one of them says so; one
    without any is neither, as is a row without an id. Without rows there is no
    part and no result.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    zero = F.lit(0).cast("long")
    known = flags.where("doc_id is not null").join(stored(said, "labels"), "doc_id", "left")
    rows = known.unionByName(flags.where("doc_id is null").withColumns({"good": zero, "toxic": zero})).select("part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    vectors = rows.mapInArrow(_counted, "part string, vector binary").rdd.map(lambda r: (r.part, np.frombuffer(bytes(r.vector), np.int64).reshape(3, MASKS)))
    add = lambda a, b: a + b
    merged = vectors.combineByKey(lambda v: v, add, add, int(flags.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return flags.sparkSession.createDataFrame(merged.flatMap(lambda x: interactions(*x)), OUT, verifySchema=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = stored(failed_filters(load(spark, sf_dir, "documents")), "flags")
    return audit(flags, load(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(ws) < 200 AS INT) AS a,
         CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) AS b,
         CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) AS c,
         CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
         CAST(coalesce(w.doc_id > least, false) AS INT) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p JOIN x q ON q.k <> p.k JOIN x r ON r.k NOT IN (p.k, q.k) JOIN x s ON s.k NOT IN (p.k, q.k, r.k) JOIN x t ON t.k NOT IN (p.k, q.k, r.k, s.k)),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
c AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM c
"""
