"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the bytes over its
present share. Each document inverts the Poisson distribution of that mean at
a point seeded by a hash of the document, is exploded by the count it gets,
and all copies are dealt out anew by a hash. Every step is a DataFrame
operation; the copies move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stored, text_of, without

SEED, TEMPERATURE = "mix-1", 0.5
#: A mean above this is split into equal parts with a draw each, which keeps exp(-mean) from underflow.
MOST_MEAN = 64.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0) -> DataFrame:
    """Per source: __source, size, rate. weights are target shares by source (missing ones: 0); without them a source weighs as its bytes to the power temperature."""
    sizes = docs.groupBy(_source().alias("__source")).agg(F.sum(F.octet_length(text_of()).cast("long") + 1).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [(f"s{k}", float(v)) for k, v in weights.items()] or [("s", 0.0)]
        given = docs.sparkSession.createDataFrame(pairs, "__source string, w double")
        sizes = sizes.join(given, "__source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_size") * F.lit(float(scale)) / F.col("size")).otherwise(F.lit(0.0))
    return sizes.join(F.broadcast(totals)).select("__source", "size", rate.alias("rate"))  # totals is one row


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an md5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """The distribution function at 0, 1, ... until what is left is below the draws' grain."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0) -> DataFrame:
    """docs with each row repeated by its Poisson count, plus copy (from 1) and shuffle_key, dealt out by a hash.

    The draw depends on doc_id and text, so repeated rows repeat alike and the
    order of the input does not matter. A null source is a source of its own,
    a null text has no bytes, a null doc_id draws as the empty id. A source
    with target weight 0 leaves no copies. Columns named copy, rate or
    shuffle_key are replaced, others kept. An empty table gives an empty result.
    """
    docs = without(docs, ["copy", "rate", "shuffle_key", "__source", "__n", "__id"])
    plan = rates(docs, weights, temperature, scale)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    # As a table its size is known: Spark broadcasts it up to its threshold and shuffles beyond.
    plan = stored(plan.select("__source", "rate", draws.alias("__draws"), _cdf(F.col("rate") / draws).alias("__cdf")), "rates")
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of()))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__draws")),
        F.lit(0),
        lambda n, j: n + F.size(F.filter("__cdf", lambda c: c <= _uniform(j.cast("string"), F.col("__id")))),
    )
    counted = docs.withColumn("__source", _source()).withColumn("__id", ident).join(plan, "__source").withColumn("__n", count)
    copies = counted.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(SEED), F.lit("order"), F.col("copy").cast("string"), F.col("__id"))))
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key").select(*[F.col(f"`{c}`") for c in docs.columns], "copy", "rate", "shuffle_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", F.octet_length(text_of()).cast("long").alias("n_bytes"), "shuffle_key")


SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce('s' || source, '') AS s, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size FROM documents GROUP BY 1),
weights AS (SELECT s, size, pow(CAST(size AS DOUBLE), 0.5) AS w FROM sizes),
rates AS (SELECT s, w / (SELECT sum(w) FROM weights) * (SELECT CAST(sum(size) AS DOUBLE) FROM weights) / size AS rate FROM weights),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
ids AS (
  SELECT doc_id, source, text, coalesce('s' || source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS id, row_number() OVER () AS rid
  FROM documents),
draws AS (SELECT *, CAST(CAST(concat('0x', substr(md5('mix-1:1:' || id), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM ids),
counts AS (
  SELECT d.rid, count(*) AS n FROM draws d JOIN cdf ON cdf.s = d.s AND cdf.c <= d.u GROUP BY d.rid)
SELECT doc_id, source, CAST(k AS INTEGER) AS copy, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
       md5('mix-1:order:' || CAST(k AS VARCHAR) || ':' || id) AS shuffle_key
FROM (SELECT d.*, unnest(range(1, c.n + 1)) AS k FROM draws d JOIN counts c ON d.rid = c.rid)
"""
