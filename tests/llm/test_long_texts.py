"""Whole texts of some megabytes: blanks, line breaks, one endless word, prose. Each operator takes them as one text among short ones."""

from __future__ import annotations

import base64
import random

import pytest

from cluewright.llm import filter_audit, kneser_ney, licences, line_dedup, mixing, ngram_join, packing, quality_rules, sentencepieces, sharding, suffix_dedup, telephony

MB = 1_000_000


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    prose = " ".join(rng.choices(words, k=MB)) + "\nend"
    texts = [" " * MB + "x", "\n" * MB, base64.b64encode(rng.randbytes(3 * MB)).decode(), prose, prose, "short text of a few words", None]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_long_texts_pass_through(spark, long_docs, tmp_path):
    long_docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    every = list(range(7))
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs, texts=False).collect()}
    assert sorted(rules) == every and rules[0].n_words == 1 and rules[1].n_words == 0 and rules[2].word_chars == 4 * MB and rules[3].n_words == MB + 1
    cleaned = {r.doc_id: r.text for r in quality_rules.quality_rules(docs).collect()}
    assert cleaned == {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    once = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(docs, copies_once=True, min_documents=2).collect()}
    assert once == dict.fromkeys(every, 0)
    assert ids(ngram_join.one_of_each(docs)) == [0, 1, 2, 3, 5, 6]
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert groups[4] == groups[3] and groups[3][1] == 3 and groups[2] == (1, 2) and groups[1] == (0, 1)
    calls = {r.doc_id: r for r in telephony.media_columns(docs).select("doc_id", "feature", "payload").collect()}
    assert sorted(calls) == every and calls[3].feature == calls[4].feature and len(calls[2].payload) >= 4 * MB
    pieces = packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(r.doc_id for r in pieces) == every and {r.doc_id: r[1] for r in pieces}[0] > 100
    spans = {r.doc_id: r.spans for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "spans").collect()}
    assert [(x.start, x.end) for x in spans[3]] == [(x.start, x.end) for x in spans[4]] and spans[3][0].start == 0 and not spans[2]
    lines = {r.doc_id: r.n_lines for r in line_dedup.line_dedup(docs).collect()}
    assert lines[1] == MB + 1 and lines[3] == 2
    assert ids(sharding.shard_plan(docs, 2)) == every and set(ids(mixing.mix(docs))) <= set(every)
    parts = {r.doc_id: r for r in sentencepieces.encode(docs, decode=True).selectExpr("doc_id", "size(ids) n", "decoded").collect()}
    assert sorted(parts) == every and all(parts[r.doc_id].decoded == (r.text or "") for r in docs.collect()) and parts[1].n == MB + 1
    failed = {r.doc_id: r["mask"] for r in filter_audit.failed_filters(docs).collect()}
    assert failed == {0: 1, 1: 1, 2: 5, 3: 2, 4: 2 + filter_audit.COPY, 5: 1, 6: 1}
    assert ids(licences.license_scan(docs)) == every
    scored = kneser_ney.quality_classifier(docs, docs.where("doc_id in (3, 5)").select("doc_id"))
    assert ids(scored) == every
