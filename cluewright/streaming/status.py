"""Statuses of clues while requests arrive: files that come twice count once, and requests are played in the order of their time.

A request waits in the state until the watermark has passed its time, when no
earlier one can come any more. Then it is judged by the same rules as in
operators.disposal, and the clue's new status is kept for the next one. Clues
are dealt into buckets, and a bucket's clues have one state and are played in
one call, as a call for each clue would cost more than playing it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.disposal import TRANSITIONS
from ..operators.lineage import PENDING

REQUESTS = "request_id string, clue_id string, at timestamp, seq long, status string"
STEPS = "clue_id string, at timestamp, seq long, status string, before string, valid boolean"
STATE = "clue array<string>, status array<string>, of array<string>, at array<long>, seq array<long>, asked array<string>"
#: Buckets of clues. A checkpoint belongs to one number of them.
BUCKETS = 4096


def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(requests: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each request_id once, however often its file is delivered; requests that come later than `delay` are dropped."""
    return requests.withWatermark("at", delay).dropDuplicatesWithinWatermark(["request_id"])


def _play(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests of a bucket whose time the watermark has passed, each with its clue's status before it; the others wait."""
    status, waiting = {}, []
    if state.exists:
        clues, known, *columns = state.get
        status = dict(zip(clues, known))
        waiting = list(zip(*columns))
    if not state.hasTimedOut:
        for frame in frames:
            waiting += zip(frame["clue_id"].tolist(), frame["at"].astype("datetime64[us]").astype("int64").tolist(), frame["seq"].tolist(), frame["status"].tolist())
    passed = state.getCurrentWatermarkMs() * 1000
    out = []
    for clue, at, seq, asked in sorted(w for w in waiting if w[1] < passed):
        before = status.get(clue, PENDING)
        valid = asked in TRANSITIONS[before]
        out.append((clue, pd.Timestamp(at, unit="us"), seq, asked, before, valid))
        status[clue] = asked if valid else before
    waiting = [w for w in waiting if w[1] >= passed]
    state.update((list(status), list(status.values()), *([list(c) for c in zip(*waiting)] or [[], [], [], []])))
    if waiting:  # once its first request can be played
        state.setTimeoutTimestamp(max(min(w[1] for w in waiting), passed) // 1000 + 1)
    yield pd.DataFrame(out, columns=["clue_id", "at", "seq", "status", "before", "valid"])


def steps(requests: DataFrame, delay: str = "2 days", buckets: int = BUCKETS) -> DataFrame:
    """STEPS of a stream of REQUESTS. A bucket's state is its clues' statuses and their requests of the last `delay`; requests without a clue belong to none."""
    keyed = once(requests.where("clue_id is not null"), delay).withColumn("bucket", F.pmod(F.xxhash64("clue_id"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(_play, STEPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(requests: DataFrame, to: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Play what has arrived into a table of steps at `to`; the run ends when that is done, and the next one goes on from its state."""
    return steps(requests, delay).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(played: DataFrame) -> DataFrame:
    """(clue_id, status) after the steps of a table."""
    last = played.groupBy("clue_id").agg(F.max_by(F.struct("status", "before", "valid"), F.struct("at", "seq")).alias("x"))
    return last.select("clue_id", F.when(F.col("x.valid"), F.col("x.status")).otherwise(F.col("x.before")).alias("status"))
