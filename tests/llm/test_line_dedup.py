from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from cluewright.llm import line_dedup as L
from tests.compare import check

BLANK, LOW = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(texts, documents):
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(BLANK).translate(LOW) for x in own] for own in lines]
    found = Counter(k for own in keys for k in set(own) if k)
    out = []
    for own, ks in zip(lines, keys):
        kept = [x for x, k in zip(own, ks) if not (k and found[k] >= documents)]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def by_copies(texts, documents):
    """As by_hand, where equal texts count once."""
    found = Counter(k for t in {t or "" for t in texts} for k in {x.strip(BLANK).translate(LOW) for x in t.split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[x.strip(BLANK).translate(LOW)] < documents]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_copies_once(spark, odd, none, documents):
    texts = [t for _, t in documents]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(docs, copies_once=True, min_documents=3).collect())
    assert got == [(i, *x) for i, x in enumerate(by_copies(texts, 3))]
    got = L.line_dedup(odd, min_documents=2, copies_once=True).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == sorted(by_copies([r.text for r in odd.collect()], 2))
    assert L.line_dedup(none, copies_once=True).count() == 0


def test_sql(spark, sf):
    check(spark, L.op6_line_dedup, L.SQL, sf)


def test_by_hand(spark, sf, documents):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in L.op6_line_dedup(spark, sf).collect()}
    want = by_hand([t for _, t in documents], 10)
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, d, t) in zip(documents, want)}


def test_odd_rows(odd, none):
    rows = odd.collect()
    got = L.line_dedup(odd.withColumn("N_LINES", F.lit(7)), min_documents=2).collect()
    want = by_hand([r.text for r in rows], 2)
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got) == sorted(want)
    assert L.line_dedup(none).count() == 0
    assert [c.lower() for c in L.line_dedup(odd).columns].count("n_lines") == 1


def test_threshold_counts_documents_not_lines(spark):
    docs = spark.createDataFrame([(1, "x\nx\nx"), (2, "x\ny"), (3, "Y ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.line_dedup(docs, min_documents=2).collect()}
    assert got == {1: "", 2: "", 3: ""}
    assert {r.doc_id: r.text for r in L.line_dedup(docs, min_documents=3).collect()}[1] == "x\nx\nx"


def test_boilerplate_goes_and_copies_stay(spark):
    """60 pages of which navigation is most of the bytes lose all of it; 15 copies of a page of its own lines keep theirs."""
    menu = ["home products contact imprint and a long list of links " * 3, "search the whole site for anything you like " * 3, "all rights reserved by the owner of this page " * 3]
    texts = ["\n".join([menu[0], f"own sentence number {i}", *menu[1:]]) for i in range(60)] + ["one line\nand another\nof a copied page"] * 15
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in L.line_dedup(docs, copies_once=True).collect()}
    assert got == {i: f"own sentence number {i}" if i < 60 else t for i, t in enumerate(texts)}
