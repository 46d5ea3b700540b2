from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from cluewright.llm import filter_audit as A
from tests.compare import check


def masks(rows):
    """Counter of (doc_id, part, mask) of rows of (doc_id, lang, text)."""
    least: dict = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    for i, lang, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        out[i, lang or "", sum(f << k for k, f in enumerate(fails))] += 1
    return out


def by_hand(rows, labels):
    found = masks(rows)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for (i, part, mask), n in found.items():
        parts[part] += [(i, mask)] * n
    out = []
    for part, own in parts.items():
        removed_by = Counter()
        made = []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                new = [x for x in left if x[1] & bit]
                row = (part, "".join(order), step, len(left) - len(new), len(new), sum(bool(m & bit) for _, m in gone), sum(m == bit for _, m in own), sum(i in good for i, _ in new), sum(i in toxic for i, _ in new))
                removed_by[name] += len(new)
                made.append((name, row))
                gone, left = gone + new, [x for x in left if not x[1] & bit]
        out += [(*row, removed_by[name]) for name, row in made]
    return sorted(out)


def flagged(df):
    out = Counter()
    for r in df.collect():
        out[r.doc_id, r.part, r.mask] += r.n
    return out


def test_sql(spark, sf):
    check(spark, A.op11_filter_audit, A.SQL, sf)


def test_by_hand(spark, sf):
    docs = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = A.op11_filter_audit(spark, sf)
    assert sorted(map(tuple, got.collect())) == by_hand(docs, labels)
    assert got.count() % 600 == 0


def test_colliding_fingerprints(spark, sf):
    """All texts under one fingerprint, or two, and tasks that forget texts again and again: chains tell texts apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = masks([(r.doc_id, r.lang, r.text) for r in docs.collect()])
    for mark in (F.lit(7).cast("long"), F.char_length("text").cast("long") % 2):
        assert flagged(A.failed_filters(docs.repartition(5), fingerprint=mark)) == want
    assert flagged(A.failed_filters(docs.union(docs).repartition(2), held=500)) == Counter({x: 2 * n for x, n in want.items()})


def test_many_copies(spark):
    """A third of all rows are one text, some of them twice under the least id; ids come in any order."""
    rows = [((i * 7919) % 1000 + 5, ["en", "de"][i % 2], "one much copied text") for i in range(300)] + [(5, "en", "one much copied text"), (5, "fr", "one much copied text")]
    rows += [(2000 + i, "en", f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    flags = A.failed_filters(docs)
    assert flagged(flags) == masks(rows)
    ids = [i for i, _, t in rows if t == "one much copied text"]
    assert {r.doc_id for r in A.copies(flags).collect()} == set(ids) - {5}


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect()]
    flags = A.failed_filters(odd.withColumn("mask", F.lit("x")).withColumn("N", F.lit(1)))
    assert flagged(flags) == masks(rows)
    labels = [(1, 1, None), (1, 0, 1), (None, 1, 1), (3, 1, 0), (77, 1, 1), (4, None, None)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(flags, said)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, [x for x in labels if x[0] is not None])
    assert A.audit(A.failed_filters(none), said).count() == 0
    assert sorted(map(tuple, A.audit(flags, said.where("false")).collect())) == by_hand(rows, [])
