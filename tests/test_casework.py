from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from cluewright.operators import disposal, graph, hypotheses, lineage, preflight, scans
from cluewright.plans import casework, overlap, ranking

from .demo import CALLS, SPACE, SUPPORTED, tables, theory


@pytest.fixture(scope="module")
def case(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def result(spark, case):
    return {k: v.collect() for k, v in casework.solve(case, theory(spark), ["何志远", "之舅"], ["周启明"]).items()}


def test_findings_lead_to_hypotheses_and_clues(result):
    assert {r.candidate for r in result["findings"]} == {"整数现金存入", "第三方过桥结构", "通话频次突增", "工商登记利益关联"}
    assert sorted(r.id for r in result["hypotheses"]) == ["H1", "H2", "H3", "H4"]
    clues = {r.title: r for r in result["clues"] if r.skill_id == lineage.SCAN}
    assert {t: (r.assumption_chain, r.channels) for t, r in clues.items()} == {
        "整数现金存入": (["H1"], ["生间"]),
        "第三方过桥结构": (["H4"], ["反间"]),
        "通话频次突增": (["H3"], ["生间"]),
        "工商登记利益关联": (["H2"], ["因间"]),
    }
    assert {t: r.priority_score for t, r in clues.items()} == {"整数现金存入": 0.555, "工商登记利益关联": 0.565, "第三方过桥结构": 0.495, "通话频次突增": 0.375}
    assert [r.title for r in sorted(result["clues"], key=lambda r: r.priority_rank)][0] == "奇正分工方案"
    assert result["crossing"][0].level == "可立案依据候选"
    assert {r.status: r.n for r in result["statuses"]} == {lineage.PENDING: 9, lineage.VERIFYING: 0, lineage.EXCLUDED: 0, lineage.CONFIRMED: 0, lineage.FILED: 0}


def test_clues_of_plan_and_channels(result):
    """Beside the scans' clues one of the plan and one for each channel with evidence, in the order of their scores."""
    got = [(r.title, r.skill_id, tuple(r.channels), r.priority_score) for r in sorted(result["clues"], key=lambda r: r.priority_rank)]
    assert got == [
        ("奇正分工方案", "plan", ("生间", "反间", "因间"), 0.63),
        ("工商登记利益关联", "scan", ("因间",), 0.565),
        ("死间命中", "crossing", ("死间",), 0.56),
        ("整数现金存入", "scan", ("生间",), 0.555),
        ("第三方过桥结构", "scan", ("反间",), 0.495),
        ("因间命中", "crossing", ("因间",), 0.49),
        ("反间命中", "crossing", ("反间",), 0.42),
        ("通话频次突增", "scan", ("生间",), 0.375),
        ("生间命中", "crossing", ("生间",), 0.35),
    ]
    assert {r.channel for r in result["channels"] if not r.hit} == {"内间"}


def test_members_of_merged_clues_are_told(spark, case):
    """Calls and movements speak for one hypothesis by one channel, so that their clues are one; each is told with its own rows and score too."""
    moves = spark.createDataFrame([("a", "x", "2020-01-01"), ("b", "x", "2020-01-02"), ("c", "x", "2020-01-02")], "subject string, place string, date string")
    done = casework.solve(case | {"moves": moves}, theory(spark), ["何志远"], ["周启明"])
    rows = lambda df: {r.title: (r.n_rows, r.priority_score) for r in df.collect() if r.assumption_chain == ["H3"]}
    assert rows(done["clues"]) == {"轨迹同框 | 通话频次突增": (4, 0.45)}
    assert rows(done["members"]) == {"通话频次突增": (1, 0.375), "轨迹同框": (3, 0.425)}
    assert done["members"].count() == done["clues"].count() + 1 == 10


def test_coverage_report(result, spark, case, tmp_path):
    told = {r.section: json.loads(r.document) for r in result["coverage"]}
    assert told["dimensions"]["percent"] == 100.0 and told["channels"]["missing"] == ["内间", "死间"] and told["conflicts"] == []
    assert told["sources"]["covered"] == 5
    casework.write_documents(casework.solve(case, theory(spark), ["何志远"], ["周启明"]), str(tmp_path))
    assert spark.read.json(str(tmp_path / "lineage_clues.json")).count() == 9
    assert {p.name for p in tmp_path.iterdir()} == {"lineage_clues.json", "entity_mapping.json", "review_queue.json", "coverage.json"}


def test_hypotheses_are_added_once(spark):
    """A rerun adds nothing, an id that is taken is replaced by a free one, and what is over the limit is skipped."""
    h = lambda *rows: spark.createDataFrame([(i, d, [], [], [], []) for i, d in rows], hypotheses.COLUMNS)
    standing = h(("H1", "one"), ("H2", "two"), ("H7", "seven"))
    after, log = hypotheses.admitted(standing, h(("H1", "other"), ("H2", "two"), ("H3", "three"), ("H4", "four")))
    assert sorted((r.id, r.description) for r in after.collect()) == [("H1", "one"), ("H2", "two"), ("H3", "three"), ("H6", "other"), ("H7", "seven")]
    assert sorted((r.id, r.given_id, r.action) for r in log.collect()) == [("H1", "H6", "added under another id"), ("H3", "H3", "added"), ("H4", "H4", "skipped")]
    again, log = hypotheses.admitted(after, h(("H1", "other"), ("H2", "two"), ("H3", "three")))
    assert again.count() == 5 and log.count() == 0
    assert hypotheses.admitted(standing.limit(0), h(("H1", "x")))[0].count() == 1


def test_evidence_is_whole(result):
    cited = {r.title: sum(e.clue_id == r.clue_id for e in result["clue_evidence"]) for r in result["clues"]}
    cited = {t: n for t, n in cited.items() if n}
    assert cited == {"整数现金存入": 5, "第三方过桥结构": 3, "通话频次突增": 1, "工商登记利益关联": 3}
    assert {r.title: r.n_rows for r in result["clues"] if r.n_rows} == cited and len(result["evidence"]) == 12


def test_names_are_resolved_before_the_scans(spark, case, result):
    names = {r.name: r.canonical for r in result["names"]}
    assert {"周启明", "何志远", "远图工程"} <= set(names) and names["远图工程"] == "远图工程"
    assert {r.kind for r in result["report"]} == {"person", "org"} and len(result["flow"]) == 23
    queue = [r for r in result["review"] if "青石贸易" in r.variants]
    # 周启明 begins 周启明之妹, so both are for a person to look at; what is rejected leaves the names.
    asked = [r for r in result["review"] if set(r.variants) & {"周启明", "周启明之妹"} and r.entity_type == "person"]
    assert len(asked) == 2 and all(r.decision == "PENDING" for r in result["review"]) and not queue
    no = spark.createDataFrame([(r.candidate_id, "REJECTED", "Li", "two people") for r in asked if r.variants == ["周启明之妹"]], "candidate_id string, decision string, operator string, note string")
    again = casework.solve(case, theory(spark), ["何志远"], ["周启明"], decisions=no)
    assert "周启明之妹" not in {r.name for r in again["names"].collect()}
    assert disposal.review_summary(again["review"]).first().rejected == 1


def test_paths_collisions_preflight(result):
    assert [tuple(r) for r in result["paths"]] == [("远图工程", "青石贸易", "周启明之妹", 3200000, 900000)]
    assert sorted(r.offset_days for r in result["collisions"]) == [4, 6, 9, 11, 15]
    assert {(r.sampled_rows, r.hit_rows, r.verdict) for r in result["preflight"]} == {(23, 7, "方向明确")}


def test_rollups(case):
    flow = case["flow"]
    assert scans.period_totals(flow, "month").count() == 22
    assert scans.period_totals(flow, "quarter", modulus=10000).count() == 7
    quarters = {r.period: (r.cnt, int(r.total)) for r in scans.period_totals(flow, "quarter", by_subject=False, modulus=10000).collect()}
    assert len(quarters) == 5 and quarters.pop(datetime.date(2020, 7, 1)) == (3, 4180000) and set(quarters.values()) == {(1, 80000)}
    assert {(r.subject, int(r.total)) for r in scans.pair_totals(flow).collect()} == {("周启明", 400000), ("远图工程", 3200000), ("青石贸易", 900000)}


def test_graph(case):
    flow = case["flow"]
    assert graph.nodes(flow).count() == 6 and graph.edges(flow).count() == 23
    assert {r.name for r in graph.neighbours(flow, "远图工程", 2).collect()} == {"青石贸易", "周启明之妹"}
    paths = graph.bridges(flow)
    other = paths.withColumn("amount_in", F.lit(1))
    assert graph.consistency(paths, other).first().consistent
    assert not graph.consistency(paths, paths.withColumn("dest", F.lit("Z"))).first().consistent
    assert graph.consistency(paths, paths.where("false")).first().only_left == 1


def test_spike(spark, case):
    row = scans.frequency_spike(case["calls"]).first()
    assert (row.c, row.median, row.hit) == (CALLS, None, True)
    few = spark.createDataFrame([("a", "b")] * 29 + [("a", "c")] * 15, "subject string, callee string")
    assert not scans.frequency_spike(few).first().hit
    assert scans.frequency_spike(few.where("callee = 'b'")).first().hit is False
    assert scans.frequency_spike(few.where("false")).count() == 0


def test_range_join_is_a_filtered_cross_join(spark):
    import random

    rng = random.Random(1)
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(-200, 200))
    a, b = [(i, day()) for i in range(60)], [(i, day()) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, d date"), spark.createDataFrame(b, "j long, e date")
    for before, after in ((20, 20), (0, 3), (7, 0)):
        got = {(r.i, r.j) for r in scans.range_join(left, right, "d", "e", before, after).collect()}
        assert got == {(i, j) for i, d in a for j, e in b if -before <= (e - d).days <= after}


def test_co_location_bands(spark):
    moves = spark.createDataFrame([("a", "x", "2020-01-01 23:59:00"), ("b", "x", "2020-01-02 00:01:00"), ("c", "x", "2020-01-03 00:00:00"), ("a", "y", "2020-01-01 00:00:00")], "subject string, place string, date string")
    pairs = {(r.subject_a, r.subject_b) for r in scans.co_location(moves).collect()}
    assert pairs == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_merging_clues(spark):
    row = lambda i, chain, rows, channels, status: (f"c{i}", i, "s", f"t{i}", chain, len(rows), channels, False, "p", status, rows)
    both = spark.createDataFrame(
        [
            row(0, ["H1"], ["r1", "r2"], ["生间"], lineage.PENDING),
            row(1, ["H9"], ["r1", "r2", "r3"], ["反间"], lineage.CONFIRMED),  # overlaps c0 by 2/3
            row(2, ["H1"], ["r9"], ["生间"], lineage.EXCLUDED),  # hypothesis and channel of c0
            row(3, ["H1"], ["r8"], ["死间"], lineage.PENDING),  # hypothesis alone
            row(4, [], [], [], lineage.PENDING),
        ],
        "clue_id string, ord long, skill_id string, title string, assumption_chain array<string>, n_rows long, channels array<string>, needs_human_review boolean, policy string, status string, x array<string>",
    )
    clues, evidence = lineage.merged_clues(both.drop("x"), both.select("clue_id", F.explode("x").alias("x")))
    merged = {r.clue_id: r for r in clues.collect()}
    assert set(merged) == {"c0", "c3", "c4"}
    assert merged["c0"].merged_from == ["c0", "c1", "c2"] and merged["c0"].title == "t0 | t1 | t2" and merged["c0"].status == lineage.CONFIRMED
    assert set(merged["c0"].channels) == {"生间", "反间"} and {c: r.n_rows for c, r in merged.items()} == {"c0": 4, "c3": 1, "c4": 0}
    assert sorted(tuple(r) for r in evidence.collect()) == [("c0", "r1"), ("c0", "r2"), ("c0", "r3"), ("c0", "r9"), ("c3", "r8")]


@pytest.mark.parametrize("way", ["bitmaps", "meetings", "rarest"])
@pytest.mark.parametrize("items", [6, 60, 4000])
def test_overlaps_all_ways(spark, monkeypatch, items, way):
    """Few items, which are in most sets, and many, which are in few, by each of the plans; blocks of a few sets."""
    import random

    monkeypatch.setattr(overlap, "BLOCK", 7)
    monkeypatch.setattr(overlap, "BITMAP_ITEMS", 1 << 16 if way == "bitmaps" else 0)
    monkeypatch.setattr(overlap, "WORDS_A_MEETING", 1 << 40)
    monkeypatch.setattr(overlap, "SET_STEPS", 1e-9 if way == "meetings" else 1e18)
    rng = random.Random(items)
    sets = {f"k{i:03d}": {rng.randrange(items) for _ in range(rng.randint(1, 12))} for i in range(120)}
    sets |= {f"z{i}": set(sorted(sets[f"k{i:03d}"])[1:]) | {items + i} for i in range(40)}
    df = spark.createDataFrame([(k, str(x)) for k, xs in sets.items() for x in xs], "k string, x string")
    got = {(r.a, r.b): (r.common, round(r.score, 9)) for r in lineage.overlaps(df, "k", "x", 0.4).collect()}
    want = {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.4 - 1e-9}
    assert lineage.overlaps(df.where("false"), "k", "x", 0.4).count() == 0


def test_ranks_and_least_hashes(spark):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    got = [(r.rank, r.a, r.b) for r in ranking.ranked(df, [F.desc("a"), F.asc("b")]).collect()]
    assert sorted(got) == [(i + 1, a, b) for i, (a, b) in enumerate(sorted(((i % 50, i) for i in range(3000)), key=lambda x: (-x[0], x[1])))]
    assert ranking.ranked(df.where("false"), [F.asc("a")]).count() == 0
    for target in (0, 1, 77, 2999):
        want = {r.b for r in df.orderBy(F.md5(F.concat_ws("|", "b")), "b").limit(target).collect()}
        assert {r.b for r in ranking.least_hashes(df, ["b"], target).collect()} == want
    assert ranking.least_hashes(df.withColumn("b", F.lit(1)), ["b"], 40).count() == 40


def test_last_request_counts(spark):
    clues = spark.createDataFrame([(c, lineage.PENDING) for c in "abc"], "clue_id string, status string")
    asked = spark.createDataFrame([("a", lineage.VERIFYING, 1), ("a", lineage.EXCLUDED, 2), ("b", lineage.VERIFYING, 1), ("b", lineage.CONFIRMED, 1)], "clue_id string, status string, at int").withColumns({"operator": F.lit("Li"), "note": F.lit("x")})
    state = lambda checked: {r.clue_id: r.status for r in disposal.applied(clues, checked).collect()}
    checked = disposal.transitions(clues, asked)
    assert state(checked) == {"a": lineage.EXCLUDED, "b": lineage.PENDING, "c": lineage.PENDING}
    assert state(checked.drop("at")) == {c: lineage.PENDING for c in "abc"}


def test_workflow(spark):
    clues = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate([lineage.PENDING, lineage.CONFIRMED, lineage.EXCLUDED, lineage.FILED])], "clue_id string, status string")
    asked = [("c0", lineage.FILED, "Li", "x"), ("c0", lineage.EXCLUDED, "Li", " "), ("c1", lineage.FILED, "Li", "basis"), ("c1", lineage.FILED, "llm", "basis"), ("c2", lineage.PENDING, "Li", None), ("c3", lineage.PENDING, "Li", "x"), ("c9", lineage.PENDING, "Li", "x")]
    checked = disposal.transitions(clues, spark.createDataFrame(asked, "clue_id string, status string, operator string, note string"))
    got = {(r.clue_id, r.status, r.operator): r.reason for r in checked.collect()}
    assert got == {
        ("c0", lineage.FILED, "Li"): "step not permitted",
        ("c0", lineage.EXCLUDED, "Li"): "note missing",
        ("c1", lineage.FILED, "Li"): None,
        ("c1", lineage.FILED, "llm"): "no named operator",
        ("c2", lineage.PENDING, "Li"): None,
        ("c3", lineage.PENDING, "Li"): "step not permitted",
        ("c9", lineage.PENDING, "Li"): "unknown clue",
    }
    assert {r.clue_id: r.status for r in disposal.applied(clues, checked).collect()} == {"c0": lineage.PENDING, "c1": lineage.FILED, "c2": lineage.PENDING, "c3": lineage.FILED}
    assert {r.clue_id for r in disposal.audit(checked).collect()} == {"c1", "c2"}


def test_hypotheses(spark):
    table = theory(spark)
    combos = hypotheses.combinations(spark, SPACE)
    assert combos.count() == 240
    assert hypotheses.summary(hypotheses.dimension_coverage(table)).first().percent == 100.0
    alarm = hypotheses.summary(hypotheses.dimension_coverage(table.where("id = 'H1'"))).first()
    assert alarm.alarm and alarm.covered == 2
    supported = spark.createDataFrame(SUPPORTED, "behaviour string, hypothesis string")
    left = {r.behaviour for r in hypotheses.backlog(combos, table, supported).collect()}
    assert left == {"礼券", "转账", "代持"}
    marks = {r.id: r.missing_sources for r in hypotheses.marked(table, ["银行流水", "工商"], ["言词"]).collect()}
    assert marks["H1"] == ["招投标档案"] and marks["H4"] == []


def test_samples(spark):
    df = spark.range(5000).withColumn("amount", F.col("id") * 5000)
    assert preflight.sample(df, ["id"]).count() == 200 and preflight.sample(df, ["id"], ratio=0.1).count() == 500
    assert preflight.sample(df.limit(50), ["id"]).count() == 50
    empty = preflight.preflight(df.where("false"), {"H1": None}).first()
    assert (empty.sampled_rows, empty.hit_rate, empty.verdict) == (0, 0.0, "方向否定")
