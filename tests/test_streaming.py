from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from cluewright.operators import disposal
from cluewright.operators.lineage import CONFIRMED, EXCLUDED, FILED, PENDING, STATUSES, VERIFYING
from cluewright.streaming import rollup, status

DAY = datetime.datetime(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, status.REQUESTS).coalesce(1).write.mode("append").parquet(folder)


def played(spark, place):
    status.start(status.request_stream(spark, place("in"), 1), place("out"), place("offsets")).awaitTermination()
    return spark.read.schema(status.STEPS).parquet(place("out"))


def test_repeated_file_late_and_early_rows(spark, tmp_path):
    """A file that comes twice counts once, requests out of order are played in order, one that is too late is dropped, and runs go on from each other."""
    place = lambda n: str(tmp_path / n)
    first = [("r1", "a", day(1), 1, CONFIRMED), ("r2", "a", day(0), 2, FILED), ("r3", "b", day(1), 3, EXCLUDED)]
    arrive(spark, place("in"), first)
    arrive(spark, place("in"), first)
    assert played(spark, place).count() == 0  # nothing is sure yet
    arrive(spark, place("in"), [("r4", "a", day(10), 4, FILED), ("r5", "b", day(10), 5, PENDING), ("r6", None, day(10), 6, PENDING)])
    got = sorted((r.clue_id, r.seq, r.before, r.valid) for r in played(spark, place).collect())
    assert got == [("a", 1, PENDING, True), ("a", 2, PENDING, False), ("b", 3, PENDING, True)]
    arrive(spark, place("in"), [("late", "b", day(2), 7, VERIFYING)])
    arrive(spark, place("in"), first)
    arrive(spark, place("in"), [("end", "z", day(100), 8, VERIFYING)])
    out = played(spark, place)
    got = sorted((r.clue_id, r.seq, r.before, r.valid) for r in out.collect())
    assert got == [("a", 1, PENDING, True), ("a", 2, PENDING, False), ("a", 4, CONFIRMED, True), ("b", 3, PENDING, True), ("b", 5, EXCLUDED, True)]
    assert {r.clue_id: r.status for r in status.current(out).collect()} == {"a": FILED, "b": PENDING}


def test_the_stream_plays_as_the_batch_does(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i}", f"c{rng.randint(0, 5)}", day(i // 20) + datetime.timedelta(hours=rng.randint(-20, 20)), i, rng.choice(STATUSES)) for i in range(200)]
    place = lambda n: str(tmp_path / n)
    for k in range(0, 200, 50):
        arrive(spark, place("in"), rows[k : k + 50])
    arrive(spark, place("in"), [("end", "z", day(100), 999, VERIFYING)])
    got = sorted((r.seq, r.before, r.valid) for r in played(spark, place).collect())
    batch = disposal.replay(spark.createDataFrame(rows, status.REQUESTS).drop("request_id"))
    assert got == sorted((r.seq, r.before, r.valid) for r in batch.collect())


def test_windows_with_a_late_row(spark, tmp_path):
    """Sums by day; a row that comes after its window has closed is not added."""
    place = lambda n: str(tmp_path / n)
    schema = "subject string, amount long, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place("in"))
        out = rollup.windowed(rollup.flow_stream(spark, place("in"), spark.createDataFrame([], schema).schema))
        out.writeStream.format("parquet").option("path", place("out")).option("checkpointLocation", place("offsets")).trigger(availableNow=True).start().awaitTermination()

    run([("a", 1, day(0)), ("a", 2, day(0)), ("b", 5, day(1))])
    run([("a", 3, day(9)), ("a", 4, day(1))])
    run([("a", 100, day(0)), ("b", 7, day(20))])
    run([("c", 1, day(30))])
    got = {(r.subject, r.start.day): (r.cnt, r.total) for r in spark.read.parquet(place("out")).where(F.col("start") < F.lit(day(15))).collect()}
    assert got == {("a", 1): (2, 3), ("b", 2): (1, 5), ("a", 2): (1, 4), ("a", 10): (1, 3)}


def test_one_call_plays_all_clues_of_a_bucket():
    """Clues of a bucket have statuses of their own, those that wait stay in the state, and the timeout is the first one's."""
    import pandas as pd

    class State:
        exists, hasTimedOut, get, timeout = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def getCurrentWatermarkMs(self):
            return int(day(5).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)

    asked = [("b", day(2), 1, EXCLUDED), ("a", day(3), 2, FILED), ("a", day(1), 3, CONFIRMED), ("b", day(9), 4, PENDING), ("c", day(8), 5, VERIFYING)]
    frame = pd.DataFrame(asked, columns=["clue_id", "at", "seq", "status"])
    state = State()
    [out] = status._play((7,), iter([frame]), state)
    assert list(zip(out.clue_id, out.seq, out.before, out.valid)) == [("a", 3, PENDING, True), ("a", 2, CONFIRMED, True), ("b", 1, PENDING, True)]
    clues, known, of, _, seq, _ = state.get
    assert dict(zip(clues, known)) == {"a": FILED, "b": EXCLUDED} and sorted(zip(of, seq)) == [("b", 4), ("c", 5)]
    assert state.timeout == int(day(8).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) + 1
