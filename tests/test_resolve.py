from __future__ import annotations

import itertools
import random

import pytest

from cluewright.functions import names as N
from cluewright.operators import resolve as R
from cluewright.plans.storage import stored
from pyspark.sql import functions as F

ORG = "name string, credit_code string, legal_rep string, address string, source_row_id string, ord long"


@pytest.mark.parametrize(
    ("raw", "core"),
    [("宏业建设有限公司", "宏业建设"), ("宏业建设（集团）", "宏业建设"), ("宏业建设第一项目部", "宏业建设"), ("A建材北京分公司", "a建材"), ("财政局（预算处）", "财政局"), ("ＡＢＣ株式会社", "abc株式会社"), (None, "")],
)
def test_organisation_names(spark, raw, core):
    assert spark.createDataFrame([(raw,)], "n string").select(N.org_core(F.col("n"))).first()[0] == core


def test_organisations_merge_by_evidence(spark):
    rows = [("宏业建设有限公司", "9133AAA", "李志强", "杭州市", "b1", 0), ("宏业建设（集团）", "9133AAA", "李志强", "杭州市", "b2", 1), ("宏业建设第一项目部", None, None, None, "b3", 2), ("泰和建材", "9133CCC", None, None, "c1", 3), ("泰和建材公司", "9133CCC", None, None, "c2", 4), (" ", None, None, None, "x", 5)]
    clusters = R.flagged(R.clusters(spark.createDataFrame(rows, ORG), R.ORG_KEYS))
    found = clusters.collect()
    by = {frozenset(r.variants): r for r in found}
    assert set(by) == {frozenset(x[0] for x in rows[:3]), frozenset(["泰和建材", "泰和建材公司"])}
    taihe = by[frozenset(["泰和建材", "泰和建材公司"])]
    assert taihe.confidence == 1.0 and taihe.needs_review and taihe.canonical == "泰和建材"
    named = dict(map(tuple, R.mapping(clusters).collect()))
    assert named["泰和建材公司"] == "泰和建材"


def test_shared_representative_links_groups(spark):
    rows = [("宏业建设有限公司", None, "李志强", None, "x1", 0), ("A建材", None, "李志强", None, "x2", 1)]
    found = R.clusters(spark.createDataFrame(rows, ORG), R.ORG_KEYS).collect()
    assert len(found) == 1 and found[0].confidence == 1.0 and found[0].legal_reps == ["李志强"]


def test_aliases(spark):
    rows = [("宏业建设工程局", None, None, None, "a", 0), ("宏业建设有限公司", None, None, None, "b", 1)]
    aliases = spark.createDataFrame([("宏业建设工程局", "宏业建设")], "variant string, canonical string")
    found = R.clusters(spark.createDataFrame(rows, ORG), R.ORG_KEYS, aliases=aliases).collect()
    assert len(found) == 1 and found[0].canonical == "宏业建设" and found[0].confidence == 1.0


def test_persons_are_flagged_not_merged(spark):
    rows = [("张卫国", "13800001111", "r1", 0), ("张卫国（董事长）", "13800001111", "r2", 1), ("张卫国", None, "r3", 2), ("张卫国弟", None, "r4", 3)]
    found = R.flagged(R.clusters(spark.createDataFrame(rows, "name string, phone string, source_row_id string, ord long"), R.PERSON_KEYS, "person"), "person", 0.6).collect()
    by = {frozenset(r.variants): r for r in found}
    assert by[frozenset(["张卫国弟"])].needs_review and len(found) == 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_fuzzy_pairs_lose_none(spark, threshold):
    rng = random.Random(2)
    cores = {"".join(rng.choice("abc国") for _ in range(rng.randint(1, 12))) for _ in range(120)}
    got = {(r.a, r.b): round(r.similarity, 9) for r in R.fuzzy_pairs(spark.createDataFrame([(c,) for c in cores], "core string"), threshold).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(cores), 2):
        s = 1 - distance(a, b) / max(len(a), len(b))
        if s >= threshold:
            want[a, b] = round(s, 9)
    assert got == want


def test_prefixes_by_hand(spark):
    cores = ["ab", "abc", "abcd", "b", "bc", "国家", "国家局", "a"]
    got = {tuple(r) for r in R.prefix_pairs(spark.createDataFrame([(c,) for c in cores], "core string"), 2).collect()}
    assert got == {(a, b) for a in cores for b in cores if a != b and len(a) >= 2 and b.startswith(a)}


def test_write_back(spark):
    flow = spark.createDataFrame([("宏业建设第一项目部", "A建材"), ("宏业建设（集团）", "现金"), (None, "x")], "subject string, counterparty string")
    known = spark.createDataFrame([("宏业建设第一项目部", "宏业建设"), ("宏业建设（集团）", "宏业建设")], "name string, canonical string")
    got = {(r.subject, r.canonical_subject, r.canonical_counterparty) for r in R.write_back(flow, ["subject", "counterparty", "none"], known).collect()}
    assert got == {("宏业建设第一项目部", "宏业建设", "A建材"), ("宏业建设（集团）", "宏业建设", "现金"), (None, None, "x")}


def test_numbered_names_meet_those_one_edit_apart_alone(spark):
    """Names of one prefix and many numbers: what is joined grows with the names, not with their pairs."""
    names = [f"C{i:06d}" for i in range(3000)] + ["C00001", "CC000100", "x"]
    df = spark.createDataFrame([(n,) for n in names], "core string")
    same, longer = R._one_letter_apart(df, 0.85)
    assert max(r.n for r in same.select(F.size("many").alias("n")).collect()) == 10 and longer.count() == 2
    got = sorted((r.a, r.b) for r in R.fuzzy_pairs(df).collect())
    numbers = [n for n in names if len(n) == 7]
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1
    swaps = [(a, a[:k] + c + a[k + 1 :]) for a in numbers for k in range(1, 7) for c in "0123456789"]
    held = set(numbers)
    want = {(a, b) for a, b in swaps if a < b and b in held and near(a, b)} | {tuple(sorted((x, y))) for x, y in (("C00001", n) for n in numbers) if x in {y[:k] + y[k + 1 :] for k in range(7)}} | {("C000100", "CC000100")}
    assert got == sorted(want)
    close = R.fuzzy_cores(df, 0.85, 2)
    assert {r.core for r in close.collect()} == {x for pair in want for x in pair}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85])
def test_fuzzy_cores_are_those_of_the_pairs(spark, threshold):
    rng = random.Random(7)
    df = spark.createDataFrame([("".join(rng.choice("abc") for _ in range(rng.randint(1, 22))),) for _ in range(150)] + [("aab张三",), ("aab张",)], "core string")
    for least in (2, 6):
        want = {x for r in R.fuzzy_pairs(df, threshold).collect() if max(len(r.a), len(r.b)) >= least for x in (r.a, r.b)}
        assert {r.core for r in R.fuzzy_cores(df, threshold, least).collect()} == want


def test_no_join_of_names_is_sent_to_the_driver(spark):
    """Stored tables are small as files; joins of what is made of them are sorted all the same."""
    df = spark.createDataFrame([(f"C{i}",) for i in range(50)], "core string").withColumn("cluster", F.col("core"))
    found = stored(df.select("cluster", F.col("core").alias("canonical"), F.array("core").alias("variants"), F.lit(False).alias("needs_review")), "found")
    for kind in ("person", "org"):
        plan = R.flagged(found, kind)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    back = R.write_back(df, ["core"], stored(df.select(F.col("core").alias("name"), F.col("core").alias("canonical")), "names"))
    assert "BroadcastHashJoin" not in back._jdf.queryExecution().sparkPlan().toString() and back.where("canonical_core = core").count() == 50
