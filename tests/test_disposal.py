from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cluewright.operators import disposal
from cluewright.operators.lineage import CONFIRMED, EXCLUDED, FILED, PENDING, STATUSES, VERIFYING
from cluewright.plans import statescan

LOG = "clue_id string, at long, seq long, status string"


def by_hand(log, start=None):
    """{(clue_id, at, seq): (before, reason)} of a log of (clue_id, at, seq, status[, operator, note]), played one by one."""
    now, out = dict(start or {}), {}
    for r in sorted(log, key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        before = now.get(r[0], None if start is not None else PENDING)
        reason = None
        if before is None:
            reason = "unknown clue"
        elif len(r) > 4 and (not (r[4] or "").strip() or r[4].lower() in disposal.NOT_A_PERSON):
            reason = "no named operator"
        elif r[3] not in disposal.TRANSITIONS[before]:
            reason = "step not permitted"
        elif len(r) > 5 and r[3] in (EXCLUDED, FILED) and not (r[5] or "").strip():
            reason = "note missing"
        out[r[:3]] = before, reason
        if reason is None:
            now[r[0]] = r[3]
    return out


def played(df):
    return {(r.clue_id, r.at, r.seq): (r.before, r.reason) for r in df.collect()}


def test_refused_steps_leave_the_state(spark):
    log = spark.createDataFrame([("a", 1, 0, FILED), ("a", 2, 0, CONFIRMED), ("a", 3, 0, FILED), ("a", 4, 0, PENDING)], LOG)
    assert [(r.before, r.valid) for r in disposal.replay(log).orderBy("turn").collect()] == [(PENDING, False), (PENDING, True), (CONFIRMED, True), (FILED, False)]


@pytest.mark.parametrize("chunk", [1 << 9, 4])
def test_against_a_fold(spark, monkeypatch, chunk):
    """Random logs of a hot clue, a null one and many small ones, over one level of chunks and over many."""
    monkeypatch.setattr(statescan, "CHUNK", chunk)
    rng = random.Random(chunk)
    log = [(rng.choice(["hot"] * 6 + [None] + [f"c{i}" for i in range(20)]), rng.randint(0, 40), i, rng.choice([*STATUSES, CONFIRMED, FILED, "other"]), rng.choice(["Li", "Wang", "bot", "", None]), rng.choice(["why", " ", None])) for i in range(700)]
    df = spark.createDataFrame(log, LOG + ", operator string, note string").repartition(5)
    assert played(disposal.replay(df.drop("operator", "note"))) == by_hand([r[:4] for r in log])
    start = {"hot": VERIFYING, **{f"c{i}": STATUSES[i % 5] for i in range(15)}}
    clues = spark.createDataFrame(list(start.items()), "clue_id string, status string")
    assert played(disposal.replay(df, clues)) == by_hand(log, start)
    now, steps = disposal.board(clues, df)
    want = by_hand(log, start)
    last = {}
    for r in sorted(log, key=lambda r: (r[0] or "", r[1], r[2])):
        if want[r[:3]][1] is None:
            last[r[0]] = r[3], r[4], r[5]
    assert {r.clue_id: (r.status, r.last_operator, r.last_note) for r in now.collect()} == {c: last.get(c, (s, None, None)) for c, s in start.items()}
    assert steps.count() == sum(x[1] is None for x in want.values())


def test_one_clue_of_many_requests(spark):
    """100,000 requests of one clue are dealt out in chunks, none of which has more than CHUNK of them."""
    pick = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"))
    log = spark.range(100_000).select(F.lit("hot").alias("clue_id"), F.col("id").alias("at"), F.lit(0).cast("long").alias("seq"), pick.alias("status"))
    rows = [(r.clue_id, r.at, r.seq, r.status) for r in log.collect()]
    assert played(disposal.replay(log)) == by_hand(rows)


def test_no_requests(spark):
    assert disposal.replay(spark.createDataFrame([], LOG)).count() == 0


def test_requests_of_one_time(spark):
    """Without seq, requests of one time that disagree are refused; equal ones are not."""
    log = spark.createDataFrame([("a", 1, VERIFYING), ("a", 1, EXCLUDED), ("a", 2, CONFIRMED), ("b", 1, CONFIRMED), ("b", 1, CONFIRMED)], "clue_id string, at long, status string")
    got = sorted((r.clue_id, r.at, r.before, r.reason) for r in disposal.replay(log).collect() if r.clue_id == "a")
    assert got == [("a", 1, PENDING, "requests of one time disagree")] * 2 + [("a", 2, PENDING, None)]
    assert sorted(r.valid for r in disposal.replay(log).where("clue_id = 'b'").collect()) == [False, True]


def test_candidates_whose_digests_begin_alike_are_told_apart(spark):
    """The digests of these two agree in their first 8 digits; a decision on one of them is not one on the other."""
    found = spark.createDataFrame([(True, f"c#{k}", [f"Customer#{k:09d}", f"x{k}"]) for k in (22104, 30075)], "needs_review boolean, canonical string, variants array<string>")
    queue = disposal.review_queue(found, "org")
    said = queue.select("candidate_id", F.when(F.col("canonical") == "c#22104", "REJECTED").otherwise("ACCEPTED").alias("decision"), F.lit("Li").alias("operator"), F.lit("why").alias("note"))
    done = disposal.decided(queue, said)
    assert sorted((r.canonical, r.decision) for r in done.collect()) == [("c#22104", "REJECTED"), ("c#30075", "ACCEPTED")]
    assert disposal.review_summary(done).first().total == 2
