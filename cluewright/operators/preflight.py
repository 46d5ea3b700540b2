"""A look at a sample before a full scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import whole_hit
from ..plans.ranking import least_hashes

CLEAR, DUBIOUS = 0.05, 0.01
VERDICTS = ["方向明确", "方向存疑", "方向否定"]


def sample(df: DataFrame, key: list[str], ratio: float = 0.01, least: int = 200) -> DataFrame:
    """Exactly max(floor(n ratio), min(least, n)) rows, the same in each run: those of the least hashes of key. All rows if that is all."""
    n = df.count()
    target = max(int(n * ratio), min(least, n))
    return df if target >= n else least_hashes(df, key, target)


def bucket_sample(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """About percent of the rows, chosen by a hash of key alone: no sort, and the same rows in any engine."""
    return df.where(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent)


def verdict(rate: Column) -> Column:
    return F.when(rate >= CLEAR, VERDICTS[0]).when(rate >= DUBIOUS, VERDICTS[1]).otherwise(VERDICTS[2])


def preflight(rows: DataFrame, hypotheses: dict[str, Column | None], modulus: int = 10000) -> DataFrame:
    """(hypothesis, sampled_rows, hit_rows, hit_rate, verdict, overall): one pass over the sample for all hypotheses; a hypothesis without a predicate of its own looks for round amounts."""
    default = whole_hit(F.col("amount"), modulus)
    ids = list(hypotheses)
    hits = [F.coalesce(F.sum(F.coalesce(hypotheses[h] if hypotheses[h] is not None else default, F.lit(False)).cast("long")), F.lit(0)).alias(f"h{i}") for i, h in enumerate(ids)]
    one = rows.agg(F.count(F.lit(1)).alias("sampled_rows"), *hits)
    out = one.select("sampled_rows", F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.col(f"h{i}").alias("hit_rows")) for i, h in enumerate(ids)])).alias("x"), F.array_max(F.array(*[F.col(f"h{i}") for i in range(len(ids))])).alias("most"))
    rate = lambda c: F.when(F.col("sampled_rows") > 0, F.col(c) / F.col("sampled_rows")).otherwise(F.lit(0.0))
    out = out.select("sampled_rows", "x.*", "most").withColumn("hit_rate", rate("hit_rows"))
    return out.select("hypothesis", "sampled_rows", "hit_rows", "hit_rate", verdict(F.col("hit_rate")).alias("verdict"), verdict(rate("most")).alias("overall"))
