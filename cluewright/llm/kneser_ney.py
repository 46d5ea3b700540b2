"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, per language.

Training counts the n-grams of trusted texts, and every count the model needs
(continuations, contexts, counts of counts) is an aggregate of that table.
Scoring goes through joins on sharded tables: a batch of documents asks for
the distinct n-grams it has, these are resolved against the model order by
order, and the answers meet the batch again, which sums them up per document.
So what moves is each batch's own n-grams and the compressed batch, and no
table of the model has to fit anywhere. Perplexities are held against a
quantile of the trusted documents of the same language that the model was
not trained on, as its own texts would look better than any new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import load, stored, text_of

#: Bytes of an n-gram, 4 at most.
ORDER = 4
#: A document is kept up to this quantile of its language's held-out trusted perplexities; SLACK multiplies its logarithm.
QUANTILE, SLACK = 0.95, 1.0
#: One in HELD trusted documents, by a hash of the id, is held out of training and sets the thresholds.
HELD = 5
#: Text bytes of a batch.
BATCH_BYTES = 12 << 20
#: Text bytes that are worked on at once.
CHUNK = 1 << 20
#: Trusted ids are broadcast up to this number, 16 MB, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Perplexities are ranked by thousandths of their logarithm.
GRAIN = 1000
LEAST_DISCOUNT = 0.05


def _grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as an integer, and its row. Before a row's first byte there are zeros."""
    g = data.astype(np.uint32)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    place = (np.arange(len(data)) - offs[row]).astype(np.int32)
    out = g.copy()
    for back in range(1, order):
        earlier = np.zeros_like(g)
        earlier[back:] = g[:-back] if back < len(g) else 0
        earlier[place < back] = 0
        out |= earlier << np.uint32(8 * back)
    return out, row


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    names = batch.column(batch.schema.get_field_index("lang"))
    for lang in names.unique().to_pylist():
        yield lang, batch.filter(pa.compute.equal(names, lang))


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_language(batch):
                for _, _, data, offs in K.chunks(part.column(part.schema.get_field_index("t")), CHUNK):
                    g, n = np.unique(_grams(data, offs, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "g", "n"])

    return run


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table]]:
    """Batches of about limit bytes, each with an id made from what it holds."""
    held: list[pa.RecordBatch] = []
    size = 0

    def closed() -> tuple[int, pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        told = hashlib.blake2b(digest_size=8)
        for _, _, data, offs in K.chunks(table.column("t"), CHUNK):
            told.update(data)
            told.update(offs)
        for lang in table.column("lang").unique().to_pylist():
            told.update(lang.encode() + b"\0")
        return int.from_bytes(told.digest(), "little", signed=True), table

    for batch in batches:
        at = 0
        for first, last, data, _ in K.chunks(batch.column(batch.schema.get_field_index("t")), CHUNK):
            held.append(batch.slice(at, last - first))
            at, size = last, size + len(data)
            if size >= limit:
                yield closed()
                held, size = [], 0
    if held:
        yield closed()


def _requests(order: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in _cut(batches, limit):
            for lang, part in _by_language(table.to_batches()[0]):
                seen = [np.unique(_grams(data, offs, order)[0]) for _, _, data, offs in K.chunks(part.column(part.schema.get_field_index("t")), CHUNK)]
                g = np.unique(np.concatenate(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), name)), pa.array([lang] * len(g), pa.string()), pa.array(g)], ["batch", "lang", "g"])

    return run


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, table in _cut(batches, limit):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "body"])

    return run


def _scored(order: int):
    def run(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for body in bodies.column("body"):
            table = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()
            if not table.num_rows:
                continue
            for lang, part in _by_language(table.to_batches()[0]):
                text = part.column(part.schema.get_field_index("t"))
                own = answers.filter(pa.compute.equal(answers.column("lang"), lang))
                if not own.num_rows:  # no model of this language
                    ids = pa.Table.from_batches([part.drop_columns(["t"])])
                    size = pa.compute.binary_length(text).cast(pa.int64())
                    out.append(ids.append_column("total", pa.nulls(len(part), pa.float64())).append_column("n_bytes", size))
                    continue
                g = own.column("g").to_numpy().astype(np.uint32)
                rank = np.argsort(g)
                g, lp = g[rank], own.column("lp").to_numpy()[rank].astype(np.float64)
                sums, sizes = [], []
                for _, _, data, offs in K.chunks(text, CHUNK):
                    # Each distinct n-gram is looked up once.
                    grams, slot = np.unique(_grams(data, offs, order)[0], return_inverse=True)
                    at = np.minimum(np.searchsorted(g, grams), len(g) - 1)
                    total = np.r_[0, np.cumsum(lp[at][slot])]
                    if (g[at] != grams).any():
                        raise RuntimeError("a batch of documents differs between two reads of its source, so its n-grams were not asked for; the source has to be a table or another repeatable plan")
                    sums.append(total[offs[1:]] - total[offs[:-1]])
                    sizes.append(np.diff(offs))
                ids = part.drop_columns(["t"])
                out.append(pa.Table.from_batches([ids]).append_column("total", pa.array(np.concatenate(sums))).append_column("n_bytes", pa.array(np.concatenate(sizes).astype(np.int64))))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "total": pa.array([], pa.float64()), "n_bytes": pa.array([], pa.int64())})

    return run


def _levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """(lang, g, n) for orders 1 to order: occurrences at the highest, distinct left neighbours below."""
    out = [counts]
    for k in range(order - 1, 0, -1):
        out.insert(0, out[0].groupBy("lang", F.col("g").bitwiseAND((1 << (8 * k)) - 1).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    return out


def train(texts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to order: (lang, g, p) of the n-grams seen and (lang, h, back) of their contexts.

    texts has lang and t. p is the interpolated probability of an n-gram's
    last byte; for an n-gram that was not seen it is back of its context, 1 if
    that was not seen, times the next lower order's.
    """
    if not 2 <= order <= 4:
        raise ValueError("order has to be from 2 to 4")
    counts = stored(texts.mapInArrow(_counts(order), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, level in enumerate(_levels(counts, order), 1):
        level = stored(level.withColumn("h", F.shiftright("g", 8)), "level")
        times = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Counts of counts that are missing give no estimate: then 0.5, 1, 1.5. An estimate is LEAST_DISCOUNT at least, so that no probability is 0.
        cut = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(LEAST_DISCOUNT), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = level.groupBy("lang").agg(*times).select("lang", *cut)
        context = level.groupBy("lang", "h").agg(F.sum("n").cast("double").alias("s"), *times[:2], F.sum(F.when(F.col("n") > 2, 1).otherwise(0)).cast("double").alias("n3"))
        context = context.join(discounts, "lang").withColumn("back", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("s"))
        context = stored(context.select("lang", "h", "s", "back", "d1", "d2", "d3"), "context")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = level.join(context, ["lang", "h"]).withColumn("q", F.greatest(F.lit(0.0), F.col("n") - less) / F.col("s"))
        if k == 1:
            seen = seen.withColumn("low", F.lit(1 / 256))
        else:
            lower = out[-1][0].select("lang", F.col("g").alias("lower"), F.col("p").alias("low"))
            seen = seen.withColumn("lower", F.col("g").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(lower, ["lang", "lower"])
        out.append((stored(seen.select("lang", "g", (F.col("q") + F.col("back") * F.col("low")).alias("p")), "seen"), context.select("lang", "h", "back")))
    return out


def resolve(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, g, lp): the log of the probability of each n-gram's last byte, for languages that the model has."""
    out = grams.join(model[0][1].select("lang").distinct(), "lang", "left_semi").withColumn("p", F.lit(1 / 256))
    for k, (seen, context) in enumerate(model, 1):
        out = out.withColumn("x", F.col("g").bitwiseAND((1 << (8 * k)) - 1)).withColumn("h", F.shiftright("x", 8))
        out = out.join(seen.select("lang", F.col("g").alias("x"), F.col("p").alias("q")), ["lang", "x"], "left").join(context, ["lang", "h"], "left")
        out = out.select("lang", "g", F.coalesce("q", F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
    return out.select("lang", "g", F.log("p").cast("float").alias("lp"))


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, lang, log_perplexity, n_bytes) per row of docs (doc_id, lang, t); log_perplexity is null for an empty text or a language that the model has not."""
    order = len(model)
    ask = stored(docs.mapInArrow(_requests(order, batch_bytes), "batch long, lang string, g long"), "requests")
    known = stored(resolve(ask.select("lang", "g").distinct(), model), "resolved")
    answers = ask.join(known, ["lang", "g"]).select("batch", "lang", "g", "lp")
    packed = docs.mapInArrow(_packed(batch_bytes), "batch long, body binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored(order), f"doc_id {kind}, lang string, total double, n_bytes long")
    return scored.select("doc_id", "lang", F.when(F.col("n_bytes") > 0, -F.col("total") / F.col("n_bytes")).alias("log_perplexity"), "n_bytes")


def _held(ids: DataFrame) -> DataFrame:
    return ids.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0)


def _thresholds(trusted: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(lang, most): the log perplexity up to which documents are kept. Exact ranks over a histogram of bounded grain.

    trusted has held: a language without held-out text goes by what it was trained on.
    """
    from pyspark.sql import Window as W

    trusted = trusted.where("log_perplexity is not null")
    any_held = trusted.groupBy("lang").agg(F.max("held").alias("any"))
    bins = trusted.join(any_held, "lang").where("held = any").groupBy("lang", F.ceil(F.col("log_perplexity") * GRAIN).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    up = bins.withColumn("below", F.sum("k").over(W.partitionBy("lang").orderBy("bin"))).withColumn("all", F.sum("k").over(W.partitionBy("lang")))
    return up.where(F.col("below") >= quantile * F.col("all")).groupBy("lang").agg((F.min("bin") / GRAIN * slack).alias("most"))


def quality_classifier(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of docs: doc_id, lang, n_bytes, perplexity, threshold, kept.

    trusted_ids has doc_id: rows of docs with these ids are trusted. Most of
    them train the model of their language, one in HELD sets its threshold.
    kept says whether the perplexity is at most that. Texts are scored whole, byte by byte. An empty
    or null text has no perplexity and is not kept. A null lang is a language
    of its own. Documents of a language without training text have neither
    perplexity nor threshold and are kept, as nothing speaks against them.
    Null ids are never trusted; repeated rows and ids are scored each by
    itself. Only doc_id, lang and text are read, so other columns cannot
    clash. An empty table gives an empty result. docs has to be a table or
    another plan that gives the same rows each time; the operator fails
    rather than score batches that changed.
    """
    slim = docs.select("doc_id", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")).alias("lang"), text_of().alias("t"))
    ids = _held(trusted_ids.select(F.col("doc_id")).where("doc_id is not null").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    model = train(slim.join(ids, "doc_id").where("not held").select("lang", "t"), order)
    scores = stored(perplexities(slim, model, batch_bytes), "scores")
    most = stored(_thresholds(scores.join(ids, "doc_id"), quantile, slack), "thresholds")
    return scores.join(most, "lang", "left").select(
        "doc_id",
        F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("lang"),
        "n_bytes",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("most").alias("threshold"),
        ((F.col("n_bytes") > 0) & F.coalesce(F.col("log_perplexity") <= F.col("most"), F.lit(True))).alias("kept"),
    )


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that labels call good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(load(spark, sf_dir, "documents"), trusted(load(spark, sf_dir, "labels")))
