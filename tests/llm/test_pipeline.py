"""The stages one after another, each against a plain version on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cluewright.llm import mixing as M
from cluewright.llm import packing as P
from tests.llm import test_line_dedup, test_ngram_join, test_packing, test_quality_rules


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def plain(docs, spark):
    """Counters of rows after each of the first three stages."""
    source = [tuple(r) for r in docs.collect()]
    at = docs.columns.index
    put = lambda r, text: tuple(text if i == at("text") else len(text) if i == at("n_chars") else x for i, x in enumerate(r))
    judged = test_quality_rules.by_hand([(r[at("text")], r[at("source")]) for r in source])
    one = [put(r, j[7]) for r, j in zip(source, judged) if j[6]]
    yield Counter(one)
    two = []
    for r, (_, dropped, text) in zip(one, test_line_dedup.by_copies([r[at("text")] for r in one], 10)):
        if not dropped or text.strip():
            two.append(put(r, text))
    yield Counter(two)
    label = {i: c for i, _, c in test_ngram_join.by_hand([(r[at("doc_id")], r[at("text")]) for r in two], 5, 80)}
    yield Counter(r for r in two if label[r[at("doc_id")]] == r[at("doc_id")])


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    want = plain(docs, spark)
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert rows(docs) == next(want)
            assert docs.count() > 0
        if k == 3:
            sizes = before.groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("size")).collect()
            total, weight = sum(r["size"] for r in sizes), sum(r["size"] ** 0.5 for r in sizes)
            rate = {r.source: r["size"] ** 0.5 / weight * total / r["size"] for r in sizes}
            seen = {r.source: r.rate for r in M.rates(before).select(F.expr("substring(__source, 2)").alias("source"), "rate").collect()}
            assert {s: round(x, 9) for s, x in seen.items()} == {s: round(x, 9) for s, x in rate.items()}
            assert set(rows(docs)) <= set(rows(before))
        if k == 4:
            out = docs.collect()
            pieces = Counter(r.doc_id for r in out if r.piece == 0)
            assert pieces == Counter(r.doc_id for r in before.select("doc_id").collect())
            used = test_packing.valid(out, P.ROOM)
            assert used <= test_packing.best_fit([r.length for r in out], P.ROOM)


def test_run_over_many_chunks(spark):
    """Over a table whose tasks have several runs of texts, with and without common lines, run() gives whole packed documents."""
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows_ = out.collect()
    assert test_packing.valid(rows_, P.ROOM) <= test_packing.best_fit([r.length for r in rows_], P.ROOM)
    assert len({r.doc_id for r in rows_}) > 500


def test_clean_documents_stay(spark, tmp_path):
    """What is not repetitive, short, copied or boilerplate goes through the filtering stages unchanged."""
    rows_ = [(i, "\n".join(" ".join(f"word{(i * 7919 + j * 104729 + k * 31) % 100003}" for k in range(14)) for j in range(8)), "en", f"src{i % 3}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"c{k}"))
        docs = spark.read.parquet(str(tmp_path / f"c{k}"))
    assert {(r.doc_id, r.text) for r in docs.collect()} == {(r[0], r[1]) for r in rows_}


def test_near_copies_by_five_words(spark):
    """The stage against a brute force of 5-word Jaccard 0.8, with pairs that 3 words and 0.9 would leave, and rows that share an id."""
    base = [f"word{k}" for k in range(80)]
    texts = [" ".join([*base[:-n], *(f"new{n}x{k}" for k in range(n))]) for n in range(1, 9)]
    texts += [" ".join(f"other{i}x{k}" for k in range(60)) for i in range(3)]
    rows_ = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    label = {i: c for i, _, c in test_ngram_join.by_hand(list(enumerate(texts)), 5, 80)}
    narrow = {i: c for i, _, c in test_ngram_join.by_hand(list(enumerate(texts)), 3, 90)}
    assert label != narrow
    repeated = docs.unionByName(docs).unionByName(docs.withColumn("lang", F.lit("de")))
    kept = corpus_pipeline.keep_one_copy(spark, repeated, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c in label.values()})


def test_one_of_many_copies_stays(spark, tmp_path):
    """A clean document with many exact copies keeps one row; lines that many different texts share go from all of them."""
    body = lambda name: [" ".join(f"{name}{j}x{k}" for k in range(14)) for j in range(8)]
    menu = [" ".join(f"menu{j}x{k}" for k in range(60)) for j in range(3)]
    texts = ["\n".join(body("exact"))] * 15 + ["\n".join([*menu, *body(f"own{i}y")]) for i in range(12)] + ["\n".join(menu)] * 3
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:3]):
        stage(spark, docs, "").write.parquet(str(tmp_path / f"m{k}"))
        docs = spark.read.parquet(str(tmp_path / f"m{k}"))
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {0: texts[0]} | {15 + i: "\n".join(body(f"own{i}y")) for i in range(12)}
