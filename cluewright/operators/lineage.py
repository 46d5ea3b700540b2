"""Clues with their evidence: overlap, merging, scoring, escalation.

A clue row: clue_id, ord, skill_id, title, assumption_chain, n_rows, channels,
needs_human_review, policy, status. Evidence is a table of its own, (clue_id,
x) with a row for each evidence row, as a clue may cite any number of them;
n_rows counts them. Evidence rows are compared by content (evidence_key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.overlap import overlaps
from ..plans.ranking import ranked
from ..plans.storage import stored

# Channels of evidence by weight, confidences of hypotheses, escalation levels.
CHANNEL_WEIGHT = {"内间": 5, "死间": 4, "因间": 3, "反间": 2, "生间": 1}
CONFIDENCE, OTHER_CONFIDENCE = {"H1": 0.9, "H4": 0.7}, 0.7
LEVELS = {3: "可立案依据候选", 2: "线索", 1: "观察"}
CHANNELS = ["生间", "反间", "因间", "死间", "内间"]
FILED, CONFIRMED, VERIFYING, PENDING, EXCLUDED = "已立案", "已固证", "查证中", "待查", "已排除"
# Scopes of the scans by a word in the title.
SCOPES = {"flow": "现金", "call": "通话", "trajectory": "轨迹"}
#: Where clues come from: scans, crossed channels, a plan of tasks.
SCAN, CROSSING, PLAN = "scan", "crossing", "plan"
#: Order in lists: the furthest status first.
STATUSES = [FILED, CONFIRMED, VERIFYING, PENDING, EXCLUDED]


def evidence_key(*columns: str) -> Column:
    """Identity of an evidence row: its values under sorted column names."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])))


def clue_id(*columns: str) -> Column:
    """An id from content, so that reruns give the same clues the same ids."""
    return F.substring(evidence_key(*columns), 1, 8)


def duplicate_links(clues: DataFrame, evidence: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """(u, v) between clues that overlap in evidence, if it is given, or share both a hypothesis and a channel.

    The second kind goes through a hub vertex for each hypothesis and channel: links grow with the clues, not their pairs.
    """
    hubs = clues.select(F.concat(F.lit("c:"), "clue_id").alias("u"), F.explode("assumption_chain").alias("h"), "channels").select("u", "h", F.explode("channels").alias("j"))
    shared = hubs.select("u", F.concat_ws(":", F.lit("h"), "h", "j").alias("v")).distinct()
    if evidence is None:
        return shared
    rows = evidence.select(F.concat(F.lit("c:"), "clue_id").alias("id"), "x")
    near = overlaps(rows, "id", "x", threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return near.union(shared)


def merged_clues(clues: DataFrame, evidence: DataFrame, threshold: float = 0.5, apart: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clues with duplicates merged, and the evidence of what they were merged to.

    A merged clue has the first member's id, skill and policy, titles joined,
    lists united, the furthest status; its evidence is that of its members,
    each row once. apart (clue_id, n), the number of different rows of each
    clue, is given where no two clues can have a row in common: then evidence
    is not read until its caller does.
    """
    found = stored(components(duplicate_links(clues, evidence if apart is None else None, threshold)).where(F.col("vertex").startswith("c:")), "merged")
    label = found.select(F.expr("substring(vertex, 3)").alias("clue_id"), "component")
    rows = clues.join(label, "clue_id", "left").withColumn("component", F.coalesce("component", "clue_id"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    first = lambda c: F.min_by(c, "ord").alias(c)
    far = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    named = rows.groupBy("component").agg(F.min_by("clue_id", "ord").alias("to")).select("component", "to")
    cited = evidence.join(rows.select("clue_id", "component"), "clue_id").join(named, "component").select(F.col("to").alias("clue_id"), "x").distinct()
    counts = cited.groupBy("clue_id").agg(F.count(F.lit(1)).alias("n_rows"))
    if apart is not None:
        counts = rows.select("clue_id", "component").join(apart, "clue_id").join(named, "component").groupBy(F.col("to").alias("clue_id")).agg(F.sum("n").alias("n_rows"))
    out = rows.groupBy("component").agg(
        first("clue_id"),
        F.min("ord").alias("ord"),
        first("skill_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("title") != "", F.col("title")))), " | ").alias("title"),
        union("assumption_chain"),
        union("channels"),
        F.max("needs_human_review").alias("needs_human_review"),
        first("policy"),
        F.min_by("status", far).alias("status"),
        F.array_sort(F.collect_list("clue_id")).alias("merged_from"),
    )
    return out.drop("component").join(counts, "clue_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long"))), cited


def _weight(channel: Column) -> Column:
    out = F.lit(1)
    for name, w in CHANNEL_WEIGHT.items():
        out = F.when(channel == name, w).otherwise(out)
    return out


def _confidence(hypothesis: Column) -> Column:
    out = F.lit(OTHER_CONFIDENCE)
    for name, c in CONFIDENCE.items():
        out = F.when(hypothesis == name, F.lit(c)).otherwise(out)
    return out.cast("double")


def score(confidence: Column, weight: Column, rows: Column) -> Column:
    """0.4 confidence + 0.35 channel weight of 5 + 0.25 evidence of 10 rows, in doubles."""
    part = lambda x, y: F.least(F.lit(1.0), x.cast("double") / F.lit(y))
    return confidence * F.lit(0.4).cast("double") + part(weight, 5.0) * F.lit(0.35).cast("double") + part(rows, 10.0) * F.lit(0.25).cast("double")


def _raw_score(clues: DataFrame) -> DataFrame:
    conf = F.coalesce(F.array_max(F.transform("assumption_chain", _confidence)), F.lit(OTHER_CONFIDENCE).cast("double"))
    weight = F.aggregate(F.transform("channels", _weight), F.lit(0), lambda a, x: a + x)
    return clues.withColumn("__score", score(conf, weight, F.col("n_rows")))


def scored(clues: DataFrame) -> DataFrame:
    """Clues with priority_score alone, not ranked."""
    return _raw_score(clues).withColumn("priority_score", F.round("__score", 3)).drop("__score")


def prioritised(clues: DataFrame) -> DataFrame:
    """Clues with priority_score and priority_rank; ranks follow the unrounded score, then arrival."""
    return ranked(_raw_score(clues), [F.desc("__score"), F.asc("ord"), F.asc("clue_id")], "priority_rank").withColumn("priority_score", F.round("__score", 3)).drop("__score")


def level(channels: Column) -> Column:
    return F.when(channels >= 3, LEVELS[3]).when(channels == 2, LEVELS[2]).otherwise(LEVELS[1])


def cross_level(clues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, channels, level): how many different channels speak, over all clues or per key."""
    rows = clues.select(*(by or []), F.explode_outer("channels").alias("channel"))
    return rows.groupBy(*(by or [])).agg(F.count_distinct("channel").alias("channels")).withColumn("level", level(F.col("channels")))


def ids_by(clues: DataFrame, column: str) -> DataFrame:
    """(column, clue_ids): clues by status, or by each of their channels."""
    key = F.explode(column) if dict(clues.dtypes)[column].startswith("array") else F.col(column)
    return clues.select(key.alias(column), "clue_id").groupBy(column).agg(F.array_sort(F.collect_set("clue_id")).alias("clue_ids"))


def evidence_conflicts(evidence: DataFrame) -> DataFrame:
    """(a, b, common): hypotheses that cite the same evidence rows. evidence has id and x."""
    rows = evidence.select("id", "x").distinct()
    a, b = rows.select(F.col("id").alias("a"), "x"), rows.select(F.col("id").alias("b"), "x")
    return a.join(b, "x").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def active(clues: DataFrame) -> DataFrame:
    return clues.where(~F.col("status").isin(EXCLUDED, FILED))


def listed(clues: DataFrame, text: str = "", status: str | None = None, rows: int = 50) -> DataFrame:
    """The report's list: text in title, one status, furthest status first."""
    out = clues.where(F.lower("title").contains(text.lower())) if text else clues
    out = out if status is None else out.where(F.col("status") == status)
    return out.orderBy(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")), "ord").limit(rows)


def scoped(clues: DataFrame, scope: str = "all") -> DataFrame:
    """Clues of the scans whose title has the scope's keyword; all of them for 'all'."""
    own = clues.where(F.col("skill_id") == SCAN)
    return own if scope == "all" else own.where(F.col("title").contains(SCOPES[scope]))


def inferred(clues: DataFrame, needs: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Clues whose empty assumption_chain is filled with the hypotheses that draw on a source their skill needs.

    needs has skill_id and source, hypotheses has id and data_sources. It is an
    equi-join on sources; a clue that has a chain keeps it.
    """
    drawn = hypotheses.select("id", F.explode("data_sources").alias("source"))
    chains = needs.join(drawn, "source").groupBy("skill_id").agg(F.array_sort(F.collect_set("id")).alias("__chain"))
    chain = F.when(F.size("assumption_chain") > 0, F.col("assumption_chain")).otherwise(F.coalesce("__chain", F.array().cast("array<string>")))
    return clues.join(chains, "skill_id", "left").withColumn("assumption_chain", chain).select(*clues.columns)


def _clue(df: DataFrame, skill: str, title: Column, chain: Column, channels: Column, rows: Column, order: list[str]) -> DataFrame:
    """Clue rows of a few findings or channels; their number does not grow with the data, so that one window numbers them."""
    return df.select(
        clue_id(*order).alias("clue_id"),
        F.row_number().over(W.orderBy(*order)).cast("long").alias("ord"),
        F.lit(skill).alias("skill_id"),
        title.alias("title"),
        chain.alias("assumption_chain"),
        rows.cast("long").alias("n_rows"),
        channels.alias("channels"),
        F.lit(True).alias("needs_human_review"),
        F.lit("只标反常，不给定性").alias("policy"),
        F.lit(PENDING).alias("status"),
    )


def finding_clues(findings: DataFrame, evidence: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues of findings and their evidence. patterns (ord, keyword, hypothesis, channels): the first pattern with a keyword in candidate or basis supplies chain and channel."""
    text = F.concat(F.col("candidate"), F.col("basis"))
    hit = findings.join(F.broadcast(patterns.withColumnRenamed("ord", "p")), text.contains(F.col("keyword")), "left")  # patterns are a list of a few rules
    best = hit.groupBy("candidate", "basis", "n_rows").agg(F.min_by(F.struct("hypothesis", "channels"), "p").alias("k"))
    fallback = F.when(text.contains("过桥"), F.array(F.lit("反间"))).otherwise(F.array(F.lit("生间")))
    chain = F.when(F.col("k.hypothesis").isNull(), F.array().cast("array<string>")).otherwise(F.array("k.hypothesis"))
    clues = _clue(best, SCAN, F.col("candidate"), chain, F.coalesce(F.col("k.channels"), fallback), F.col("n_rows"), ["candidate", "basis"])
    return clues, evidence.select(clue_id("candidate", "basis").alias("clue_id"), "x")


def channel_hits(crossing: DataFrame) -> DataFrame:
    """Clues of channels that were hit. crossing has channel and hit; such clues cite no rows."""
    hit = crossing.where("hit").select("channel")
    return _clue(hit, CROSSING, F.concat("channel", F.lit("命中")), F.array().cast("array<string>"), F.array("channel"), F.lit(0), ["channel"])


def plan_clue(tasks: DataFrame, channels: list[str]) -> DataFrame:
    """One clue for a plan of tasks, if it has any. tasks has side and task."""
    plan = tasks.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("奇正分工方案").alias("title"), "n")
    return _clue(plan, PLAN, F.col("title"), F.array().cast("array<string>"), F.array(*[F.lit(c) for c in channels]), F.lit(0), ["title"])
