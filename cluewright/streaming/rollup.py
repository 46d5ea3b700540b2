"""Flow files that arrive over time, rolled up by subject and month.

Each micro-batch writes its own partial sums under its batch number, so a
batch that is run again after a failure replaces itself, and late rows are
just more partials of an old month. Readers add partials up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scans import merge_partials, period_totals


def flow_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_rollup(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Start a run over what has arrived; it ends when that is done."""

    def write(batch: DataFrame, number: int) -> None:
        period_totals(batch, "month").write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(spark: SparkSession, to: str) -> DataFrame:
    """Subject and month totals of all batches."""
    return merge_partials(spark.read.parquet(to).drop("batch"), ["subject", "period"])


def windowed(stream: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts and sums by subject in event-time windows; rows later than delay are dropped by the watermark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "subject").agg(F.count(F.lit(1)).alias("cnt"), F.sum("amount").alias("total")).select("subject", F.col("window.start").alias("start"), "cnt", "total")
