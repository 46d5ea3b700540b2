"""Hypotheses as tables: mapping of findings, coverage, restrictions, the enumeration space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import either_contains, without_note
from ..plans.storage import stored
from .lineage import CHANNELS, evidence_conflicts

MOST, DIMENSION_ALARM = 5, 0.8
# Sections of a report, the one that closes it, and what must not be deduced by a machine.
SECTIONS = ["庙算基线", "双向盘点", "虚实扫描", "奇正分工", "用间交叉", "全胜校验"]
CLOSING, JUDGEMENT, DEDUCIBLE = "全胜校验", "收受财物", "可推演"
# Dimensions; patterns of findings and the hypotheses they lead to.
DIMENSIONS = ["资金", "通讯", "行为", "关系", "时间"]
PATTERNS = [
    (1, "整数", "H1"), (1, "存入", "H1"), (2, "过桥", "H4"), (3, "频次", "H3"), (3, "突增", "H3"), (4, "同框", "H3"), (5, "利益关联", "H2"),
]
COLUMNS = "id string, description string, evidence_needed array<string>, data_sources array<string>, dimensions array<string>, channels array<string>"


def pattern_table(hypotheses: DataFrame, patterns: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """(ord, keyword, hypothesis, channels): patterns with the channels of their hypotheses."""
    rules = hypotheses.sparkSession.createDataFrame(patterns or PATTERNS, "ord int, keyword string, hypothesis string")
    return rules.join(hypotheses.select(F.col("id").alias("hypothesis"), "channels"), "hypothesis").select("ord", "keyword", "hypothesis", "channels")


def from_findings(findings: DataFrame, evidence: DataFrame, hypotheses: DataFrame, patterns: list[tuple[int, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Hypotheses that findings lead to, each once, MOST at most, with n_rows; and (id, x), their evidence rows, each once.

    Findings with n_distinct, as scans.findings() gives them, are taken to have
    no row in common: rows are counted by it and evidence is not read.
    """
    text = F.concat("candidate", "basis")
    hits = findings.join(F.broadcast(pattern_table(hypotheses, patterns)), text.contains(F.col("keyword")))  # the patterns are a few rules
    one = hits.groupBy("candidate", "basis").agg(F.min_by("hypothesis", "ord").alias("id"))
    first = one.select("id").distinct().orderBy("id").limit(MOST)
    cited = evidence.join(F.broadcast(one.join(first, "id")), ["candidate", "basis"]).select("id", "x").distinct()  # a row for each finding
    counts = cited.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
    if "n_distinct" in findings.columns:
        counts = findings.join(F.broadcast(one.join(first, "id")), ["candidate", "basis"]).groupBy("id").agg(F.sum("n_distinct").alias("n_rows"))
    return hypotheses.join(counts, "id"), cited


def admitted(standing: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standing hypotheses with those found that are new, the log of what became of each found one).

    A description that stands is not added again, so that a rerun adds nothing.
    A new one whose id is taken gets the next free one after the MOST-th;
    beyond MOST in all, new ones are skipped and logged, in order of their ids.
    Both tables are of a few rows.
    """
    new = found.join(standing.select("description"), "description", "left_anti")
    taken = standing.select(F.col("id")).union(new.select("id"))
    counts = standing.agg(F.count(F.lit(1)).alias("stood"))
    placed = new.join(standing.select(F.col("id"), F.lit(True).alias("clash")), "id", "left").withColumn("place", F.row_number().over(W.orderBy("id")))
    placed = placed.join(F.broadcast(counts)).withColumn("added", F.col("place") + F.col("stood") <= MOST)  # counts is one row
    clash = F.when(F.col("clash") & F.col("added"), F.sum(F.when(F.col("clash") & F.col("added"), 1)).over(W.orderBy("place")))
    numbers = found.sparkSession.range(MOST + 1, 3 * MOST + 2).select(F.concat(F.lit("H"), "id").alias("free"), F.col("id").alias("number"))
    free = numbers.join(taken.select(F.col("id").alias("free")), "free", "left_anti").withColumn("k", F.row_number().over(W.orderBy("number")))
    named = placed.withColumn("k", clash).join(free.select("k", "free"), "k", "left").withColumn("own", F.coalesce("free", "id"))
    named = stored(named, "admitted")
    rows = named.where("added").select(*[F.col("own").alias("id") if c == "id" else F.col(c) for c in found.columns])
    action = F.when(~F.col("added"), "skipped").when(F.col("own") != F.col("id"), "added under another id").otherwise("added")
    return standing.unionByName(rows, True), named.select("id", F.col("own").alias("given_id"), "description", action.alias("action"))


def coverage_report(hypotheses: DataFrame, evidence: DataFrame, sources: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """(section, document): coverage of sources, dimensions and channels, conflicts of evidence, and the backlog, each as one JSON document.

    evidence has id and x, sources name, left id, behaviour and hypothesis.
    Conflicts are pairs of a few hypotheses, the backlog a row for each
    behaviour, so that documents stay small.
    """
    told = [(name, summary(found)) for name, found in (("sources", source_coverage(hypotheses, sources)), ("dimensions", dimension_coverage(hypotheses)), ("channels", channel_coverage(hypotheses)))]
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document")) for name, df in told]
    met = evidence_conflicts(evidence.join(F.broadcast(hypotheses.select("id")), "id", "left_semi"))
    lists = [("conflicts", met.select("a", "b", "common"))] + ([] if left is None else [("backlog", left.select("id", "behaviour", "hypothesis"))])
    parts += [df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("document")).select(F.lit(name).alias("section"), "document") for name, df in lists]
    return reduce(DataFrame.union, parts)


def marked(hypotheses: DataFrame, available: list[str], unavailable: list[str]) -> DataFrame:
    """restricted where needed evidence touches an unavailable source; degraded with the sources that are missing. Nothing is deleted."""
    near = lambda x, names: reduce(lambda a, b: a | b, [either_contains(x, F.lit(n)) for n in names], F.lit(False))
    absent = F.filter(F.transform("data_sources", without_note), lambda s: ~near(s, available))
    return hypotheses.withColumn("restricted", F.exists("evidence_needed", lambda e: near(e, unavailable))).withColumn("missing_sources", absent).withColumn("degraded", F.size("missing_sources") > 0)


def _coverage(hypotheses: DataFrame, column: str, expected: DataFrame, clean=lambda c: c) -> DataFrame:
    used = hypotheses.select(F.explode(column).alias("x")).select(clean(F.col("x")).alias("name")).distinct().withColumn("used", F.lit(True))
    return expected.join(used, "name", "left").select("name", F.coalesce("used", F.lit(False)).alias("covered"))


def source_coverage(hypotheses: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, covered) of data sources. sources has name."""
    return _coverage(hypotheses, "data_sources", sources, without_note)


def dimension_coverage(hypotheses: DataFrame) -> DataFrame:
    return _coverage(hypotheses, "dimensions", hypotheses.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "name string"))


def channel_coverage(hypotheses: DataFrame) -> DataFrame:
    return _coverage(hypotheses, "channels", hypotheses.sparkSession.createDataFrame([(d,) for d in CHANNELS], "name string"))


def summary(coverage: DataFrame, alarm_below: float = DIMENSION_ALARM) -> DataFrame:
    """One row: covered, expected, percent, alarm, missing names."""
    n, k = F.count(F.lit(1)), F.coalesce(F.sum(F.col("covered").cast("long")), F.lit(0))
    out = coverage.agg(k.alias("covered"), n.alias("expected"), F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("name")))).alias("missing"))
    share = F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(F.lit(0.0))
    return out.select("covered", "expected", F.round(100 * share, 1).alias("percent"), (share < alarm_below).alias("alarm"), "missing")


def combinations(spark: SparkSession, space: dict[str, list[str]]) -> DataFrame:
    """All combinations of the dimensions' values, numbered from C1 in order; the number is computed from the values' places, so nothing is sorted."""
    out, place = spark.range(1).select(F.lit(0).cast("long").alias("place")), 1
    for name, values in space.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("__i", name)).withColumn("place", F.col("place") * len(values) + F.col("__i")).drop("__i")
        place *= len(values)
    return out.withColumn("id", F.concat(F.lit("C"), F.col("place") + 1))


def backlog(combos: DataFrame, hypotheses: DataFrame, supported: DataFrame) -> DataFrame:
    """(id, behaviour, hypothesis): the first combination of each behaviour, without those whose hypothesis stands already.

    supported (behaviour, hypothesis) says which scan speaks for a behaviour;
    hypothesis is null where none does.
    """
    first = combos.groupBy("behaviour").agg(F.min("place").alias("place"))
    out = first.join(supported, "behaviour", "left").join(hypotheses.select(F.col("id").alias("hypothesis")), "hypothesis", "left_anti")
    return out.select(F.concat(F.lit("C"), F.col("place") + 1).alias("id"), "behaviour", "hypothesis")


def missing_sections(report: DataFrame, required: list[str] | None = None) -> DataFrame:
    """(report_id, error): sections that a report lacks, and sources that are empty in its closing section.

    report has report_id, section, field, value. A row for each thing wrong;
    a report without rows here passes.
    """
    ids = report.select("report_id").distinct()
    have = report.select("report_id", "section").distinct()
    wanted = ids.withColumn("section", F.explode(F.array(*[F.lit(s) for s in required or SECTIONS])))
    absent = wanted.join(have, ["report_id", "section"], "left_anti").select("report_id", F.concat(F.lit("缺少段落："), "section").alias("error"))
    empty = report.where((F.col("section") == CLOSING) & F.col("field").contains("溯源") & (F.col("value") == "")).select("report_id", F.concat(F.lit("红线："), "field", F.lit(" 溯源为空")).alias("error"))
    return absent.unionByName(empty)


def red_lines(hypotheses: DataFrame, own_side: DataFrame) -> DataFrame:
    """(warning,): no facts of one's own side; or a hypothesis of a crime that is marked as one to deduce. hypotheses has description and status."""
    spark = hypotheses.sparkSession
    none = spark.createDataFrame([("红线：知己栏为空",)], "warning string").join(own_side.limit(1).select(F.lit(1).alias("one")), how="left_anti")
    judged = hypotheses.where(F.col("description").contains(JUDGEMENT) & (F.col("status") == DEDUCIBLE)).select(F.lit("红线：定性类假设不得标记为可推演，应交由正兵").alias("warning"))
    return none.unionByName(judged)
