from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cluewright.llm import kneser_ney as K


class ByHand:
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            b = b"\0" * (order - 1) + t.encode()
            top.update(b[i : i + order] for i in range(len(b) - order + 1))
        self.levels = [top]
        for _ in range(order - 1):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.cut = []
        for level in self.levels:
            n = [0, *(sum(1 for c in level.values() if c == i) for i in (1, 2, 3, 4))]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.cut.append([0, *(max(K.LEAST_DISCOUNT, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] else i / 2 for i in (1, 2, 3))])
        self.contexts = []
        for level in self.levels:
            own = defaultdict(list)
            for g, c in level.items():
                own[g[:-1]].append(c)
            self.contexts.append(own)

    def p(self, gram):
        p = 1 / 256
        for k in range(1, self.order + 1):
            g = gram[-k:]
            counts = self.contexts[k - 1].get(g[:-1])
            if counts:
                d, s = self.cut[k - 1], sum(counts)
                c = self.levels[k - 1].get(g, 0)
                p = (max(0, c - d[min(c, 3)]) + sum(d[min(x, 3)] for x in counts) * p) / s
        return p

    def log_perplexity(self, text):
        b = b"\0" * (self.order - 1) + text.encode()
        n = len(b) - self.order + 1
        return -sum(math.log(self.p(b[i : i + self.order])) for i in range(n)) / n


ENGLISH = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on the mat sat a cat, é and 日本", "the end of the day"] * 2
GERMAN = ["der hund und die katze", "die katze auf der matte", "das ende vom tag"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_perplexities_by_hand(spark, order, monkeypatch):
    monkeypatch.setattr(K, "HELD", 2)
    rows = [(i, t, "en") for i, t in enumerate(ENGLISH)] + [(100 + i, t, "de") for i, t in enumerate(GERMAN)]
    rows += [(200, "zzz qqq xxx", "en"), (201, "the cat", "de"), (202, "", "en"), (203, "bonjour", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i,) for i in [*range(len(ENGLISH)), 100, 101, 102, 103]], "doc_id long")
    got = {r.doc_id: r for r in K.quality_classifier(docs, good, order=order, batch_bytes=64).collect()}
    held = {r.doc_id: r.held for r in K._held(good).collect()}
    assert set(held.values()) == {True, False}
    text = {i: t for i, t, _ in rows}
    trained = {"en": [i for i in range(len(ENGLISH)) if not held[i]], "de": [i for i in range(100, 103) if not held[i]]}
    models = {lang: ByHand([text[i] for i in ids], order) for lang, ids in trained.items() if ids}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        if t and lang in models:
            assert math.log(got[i].perplexity) == pytest.approx(models[lang].log_perplexity(t), rel=1e-5)
        else:
            assert got[i].perplexity is None
    assert not got[202].kept and got[203].kept and not got[200].kept
    for ids in (range(len(ENGLISH)), range(100, 103)):
        ids = [i for i in ids if held[i]] or list(ids)
        ranked = sorted(math.ceil(math.log(got[i].perplexity) * K.GRAIN) for i in ids)
        least = ranked[math.ceil(K.QUANTILE * len(ranked)) - 1] / K.GRAIN * K.SLACK
        assert all(math.log(got[i].threshold) == pytest.approx(least) for i in ids)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([(t, "len") for t in ENGLISH], "t string, lang string").select("lang", "t")
    model = K.train(texts, 3)
    contexts = [b"the", b" ca", b"zz", b"\0\0"]
    grams = [(int.from_bytes((c[-2:] + bytes([x])), "big"), c[-2:]) for c in contexts for x in range(256)]
    asked = spark.createDataFrame([("len", g) for g, _ in grams], "lang string, g long").distinct()
    lp = {r.g: r.lp for r in K.resolve(asked, model).collect()}
    for c in contexts:
        assert sum(math.exp(lp[g]) for g, own in grams if own == c[-2:]) == pytest.approx(1, abs=1e-4)


def test_held_out_documents(spark):
    """Trained on half of the good labels: good documents of the other half are kept far more often than bad ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = K.quality_classifier(docs, K.trusted(labels).where("doc_id % 2 = 0"))
    seen = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy((F.col("quality") == 1).alias("good")).agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()
    share = {r.good: r.share for r in seen}
    assert share[True] > 0.9 and share[False] < share[True] - 0.2


def test_odd_rows(spark, odd, none):
    ids = spark.createDataFrame([(3,), (None,), (7,), (8,)], "doc_id long")
    docs = odd.withColumn("kept", F.lit("mine")).withColumn("g", F.lit(1))
    out = K.quality_classifier(docs, ids, batch_bytes=500).collect()
    assert len(out) == odd.count()
    assert sum(r.lang is None for r in out) == sum(r.lang is None for r in odd.collect())
    assert all((r.perplexity is None) == (not r.n_bytes or r.threshold is None) for r in out)
    assert K.quality_classifier(none, ids).count() == 0
    assert K.quality_classifier(odd, ids.where("false")).where("kept").count() == odd.where("length(text) > 0").count()


def test_rates_by_language(spark):
    """Trained on half of the good labels: in each language most good documents of the other half are kept and few bad ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = K.quality_classifier(docs, K.trusted(labels).where("doc_id % 2 = 0"))
    seen = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()
    assert len(seen) == 8
    assert all(r.share > 0.85 if r.quality else r.share < 0.15 for r in seen), seen
