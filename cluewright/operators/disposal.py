"""The status workflow of clues as joins: transitions, audit, snapshot, review decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.statescan import BITS, states_before
from ..plans.storage import stored
from .lineage import CONFIRMED, EXCLUDED, FILED, PENDING, STATUSES, VERIFYING
from .scans import latest

# Which status may follow which, and who may not decide.
TRANSITIONS = {
    PENDING: [VERIFYING, EXCLUDED, CONFIRMED],
    VERIFYING: [PENDING, EXCLUDED, CONFIRMED],
    EXCLUDED: [PENDING],
    CONFIRMED: [EXCLUDED, FILED],
    FILED: [],
}
NOT_A_PERSON = ["system", "ai", "assistant", "model", "bot", "auto", "llm"]


def named(operator: Column) -> Column:
    """A person's name was given."""
    return F.coalesce((F.trim(operator) != "") & ~F.lower(F.trim(operator)).isin(NOT_A_PERSON), F.lit(False))


def allowed(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for s, next_ in TRANSITIONS.items():
        out = out | ((before == s) & after.isin(next_) if next_ else F.lit(False))
    return F.coalesce(out, F.lit(False))


def _objection(before: Column, requests: DataFrame) -> Column:
    """Why a request is refused in state before; null if it is not. What a log has no column for does not count."""
    said = F.coalesce(F.trim("note") != "", F.lit(False)) if "note" in requests.columns else F.lit(True)
    person = named(F.col("operator")) if "operator" in requests.columns else F.lit(True)
    return (
        F.when(before.isNull(), "unknown clue")
        .when(~person, "no named operator")
        .when(~allowed(before, F.col("status")), "step not permitted")
        .when(F.col("status").isin(EXCLUDED, FILED) & ~said, "note missing")
    )


def replay(log: DataFrame, clues: DataFrame | None = None) -> DataFrame:
    """log (clue_id, at, seq, status) with before, the clue's status when the request came, its reason, valid, and turn, its place in order.

    A refused request leaves the clue as it is, and the next one finds it so.
    Clues start with their status in clues, where a log's clue that they lack
    is unknown; without clues all start as pending. operator and note are
    judged where the log has them. seq orders requests of one time; in a log
    without it, requests of one clue and time that ask for different statuses
    are refused, as nothing says which came first. Requests without a clue_id
    are unknown, or one clue's.
    """
    codes = F.array(*[F.lit(s) for s in STATUSES])
    coded = lambda c: F.array_position(codes, c) - 1
    rows = log.withColumn("__first", F.lit(PENDING)) if clues is None else log.join(clues.select("clue_id", F.col("status").alias("__first")), "clue_id", "left")
    # The map of a request: from each status to the one it asks for, or back to itself where that is refused.
    twice = F.lit(False)
    if "seq" not in log.columns:
        asked = log.groupBy("clue_id", "at").agg((F.min("status") != F.max("status")).alias("__twice")).where("__twice")
        both = rows.join(asked.select(F.col("clue_id").alias("__c"), F.col("at").alias("__t"), "__twice"), F.expr("clue_id <=> __c and at <=> __t"), "left")
        rows, twice = both.drop("__c", "__t"), F.coalesce("__twice", F.lit(False))
    parts = [F.call_function("shiftleft", F.when(_objection(F.lit(s), log).isNull() & ~twice, coded(F.col("status"))).otherwise(F.lit(i)).cast("long"), F.lit(BITS * i)) for i, s in enumerate(STATUSES)]
    order = [F.col("at"), *([F.col("seq")] if "seq" in log.columns else []), F.col("status")]
    start = F.coalesce(coded(F.col("__first")), F.lit(0))
    found = states_before(rows, "clue_id", order, reduce(Column.bitwiseOR, parts), start, len(STATUSES), "__state")
    before = F.when(F.col("__first").isNotNull(), F.element_at(codes, (F.col("__state") + 1).cast("int")))
    out = found.withColumn("before", before)
    out = out.withColumn("reason", F.coalesce(_objection(F.col("before"), log), F.when(twice, "requests of one time disagree"))).withColumn("valid", F.col("reason").isNull())
    return out.select(*log.columns, "before", "reason", "valid", "turn")


def transitions(clues: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (clue_id, status, operator, note) with the clue's status before, valid and reason.

    A request is valid for a known clue, a permitted step and a named person;
    exclusion needs a note, filing a note as its basis. Requests with a column
    at follow each other, and each finds what those before it have left;
    without it each is judged against the clue's status as it stands.
    """
    if "at" in requests.columns:
        return replay(requests, clues)
    known = clues.select("clue_id", F.col("status").alias("before"))
    out = requests.join(known, "clue_id", "left")
    return out.withColumn("reason", _objection(F.col("before"), requests)).withColumn("valid", F.col("reason").isNull())


def applied(clues: DataFrame, checked: DataFrame) -> DataFrame:
    """Clues with the status that their valid requests have led to.

    Of requests that follow each other, with columns at and turn, the last
    valid one counts. Without at a clue with different valid requests keeps its status,
    as nothing says which came last.
    """
    valid = checked.where("valid")
    if "at" in checked.columns:
        new = valid.groupBy("clue_id").agg(F.max_by("status", "turn").alias("__new"))
    else:
        new = valid.groupBy("clue_id").agg(F.min("status").alias("__new"), F.max("status").alias("__other")).where("__new = __other").drop("__other")
    return clues.join(new, "clue_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def board(clues: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clues as requests have left them, with last_operator and last_note of their last valid request; the audit of all valid steps). The basis of a filing is its note."""
    checked = stored(replay(requests, clues), "replayed")
    last = checked.where("valid").groupBy("clue_id").agg(F.max_by(F.struct("operator", "note"), "turn").alias("x"))
    now = applied(clues, checked).join(last, "clue_id", "left")
    return now.select(*clues.columns, F.col("x.operator").alias("last_operator"), F.col("x.note").alias("last_note")), audit(checked)


def audit(checked: DataFrame) -> DataFrame:
    """The steps taken, with their turn and time where checked has them."""
    when = [c for c in ("at", "turn") if c in checked.columns]
    return checked.where("valid").select("clue_id", F.col("before").alias("from_status"), F.col("status").alias("to_status"), "operator", "note", *when)


def snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest (clue_id, status, note, operator, updated_at) by clue: an upsert that a rerun repeats without effect."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(rows, ["clue_id"], ["updated_at", "__new"]).drop("__new")


def restored(clues: DataFrame, saved: DataFrame) -> DataFrame:
    """Clues with their saved status; changed tells which differ from before."""
    out = clues.join(saved.select("clue_id", F.col("status").alias("__saved")), "clue_id", "left")
    changed = F.col("__saved").isNotNull() & (F.col("__saved") != F.col("status"))
    return out.withColumn("changed", changed).withColumn("status", F.coalesce("__saved", "status")).drop("__saved")


def histogram(clues: DataFrame) -> DataFrame:
    """(status, n) for all five statuses, zeros included."""
    spark = clues.sparkSession
    dim = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return dim.join(clues.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def review_queue(found: DataFrame, kind: str) -> DataFrame:
    """Clusters that need review as pending decisions; ids are from content, the whole digest of it, as decisions are joined to them."""
    return found.where("needs_review").select(
        F.concat(F.lit(f"rev_{kind}_"), F.md5(F.concat_ws("|", "canonical", F.array_join("variants", ",")))).alias("candidate_id"),
        F.lit(kind).alias("entity_type"),
        "canonical",
        "variants",
        F.lit("PENDING").alias("decision"),
    )


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue with decisions (candidate_id, decision, operator, note) that are in order: ACCEPTED by a named person, REJECTED by one with a note, DEFERRED by anyone."""
    ok = F.when(F.col("__d") == "ACCEPTED", named(F.col("operator"))).when(F.col("__d") == "REJECTED", named(F.col("operator")) & F.coalesce(F.trim("note") != "", F.lit(False))).otherwise(F.col("__d") == "DEFERRED")
    return queue.join(decisions.withColumnRenamed("decision", "__d"), "candidate_id", "left").withColumn("decision", F.when(ok, F.col("__d")).otherwise(F.col("decision"))).drop("__d")


def accepted_names(queue: DataFrame) -> DataFrame:
    return queue.where("decision = 'ACCEPTED'").select(F.explode("variants").alias("name"), "canonical")


def rejected_names(queue: DataFrame) -> DataFrame:
    return queue.where("decision = 'REJECTED'").select(F.explode("variants").alias("name"))


def review_summary(queue: DataFrame) -> DataFrame:
    """One row: total, pending, accepted, rejected, deferred."""
    kind = lambda d: F.coalesce(F.sum((F.col("decision") == d).cast("long")), F.lit(0)).alias(d.lower())
    return queue.agg(F.count(F.lit(1)).alias("total"), *[kind(d) for d in ("PENDING", "ACCEPTED", "REJECTED", "DEFERRED")])


def suggestion(status: Column, channels: Column) -> Column:
    """What to do next."""
    return (
        F.when(status == FILED, "已立案，转入侦查")
        .when(status == EXCLUDED, "已排除，留档")
        .when(status == CONFIRMED, "可报立案审批")
        .when(channels >= 2, "多源印证，优先核查")
        .otherwise("补充其他来源后核查")
    )
