from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cluewright.llm import ngram_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def by_hand(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_query(spark, sf, documents):
    assert result(J.op8_ngram_join(spark, sf)) == by_hand(documents)


def varied(seed, n, length, edits):
    """n texts in chains of edits of a few seeds, so that links meet in long chains and near misses."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [[word() for _ in range(rng.randint(3, length))] for _ in range(4)]
    while len(texts) < n:
        own = list(rng.choice(texts[-12:]))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(own))
            what = rng.random()
            if what < 0.4:
                own[k] = word()
            elif what < 0.7:
                own.insert(k, word())
            elif len(own) > 3:
                del own[k]
        texts.append(own)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


def test_product():
    """The sparse product, of thin and thick columns, against sets."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60 if i % 2 else 400, rng.integers(1, 80))).astype(np.uint64) for i in range(70)]
    rows += [np.unique(np.r_[np.arange(500, 700), rng.integers(0, 400, 9)]).astype(np.uint64) for _ in range(60)]
    got = J.overlaps(np.concatenate(rows), np.array([len(r) for r in rows]))
    want = [[len(np.intersect1d(a, b)) for b in rows] for a in rows]
    assert np.triu(got, 1).tolist() == np.triu(want, 1).tolist() and (got == got.T).all()


def difference(x, y):
    """Of two signatures, by a column of one row and by one of rows of several lengths."""
    column = lambda *v: pa.array([w.tobytes() for w in v], pa.binary())
    other = np.zeros(8, np.uint8)
    one, many = J.differences(column(x), column(y)), J.differences(column(other, x, y, x), column(x, y, x, x))
    assert one[0] == many[1] == many[2] and many[3] == 0
    return int(one[0])


def test_signatures_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 60, 64, 65, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0, 0.1, 0.9):
            b = np.unique(np.r_[a[rng.random(len(a)) > share], rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)])
            bound, apart = difference(J.signature(a), J.signature(b)), len(np.setxor1d(a, b))
            assert bound <= apart and bound >= min(apart, n / 4) * 0.25


def test_sets_that_signatures_let_link():
    """The blocked comparison of signatures against one pair at a time."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    for percent in (50, 80, 90, 100):
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
            sets = [np.unique(np.r_[base[rng.random(len(base)) > rng.choice([0, 0.05, 0.3])], rng.integers(0, 1 << 63, rng.integers(1, 6), dtype=np.uint64)]) for _ in range(rng.integers(1, 30))]
            n, part, told = np.array([len(x) for x in sets]), rng.integers(0, 4, len(sets)), [J.signature(x) for x in sets]

            def may(i, j):
                near = difference(told[i], told[j]) <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
                return part[i] != part[j] and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and near

            want = [any(may(i, j) for j in range(len(sets))) for i in range(len(sets))]
            assert J.may_link(n, part, pa.array([x.tobytes() for x in told], pa.binary()), percent).tolist() == want


def test_linked_sets_share_a_key():
    """Whatever the sizes: sets that link have a key in common, also where blocks are empty."""
    import numpy as np

    rng = np.random.default_rng(4)
    for percent in (50, 80, 90, 99):
        for _ in range(150):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) > (100 - percent) / 130], rng.integers(0, 1 << 63, rng.integers(0, 1 + n * (100 - percent) // 130), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if len(b) and common < max(len(a), len(b)) and J.linked(common, len(a), len(b), percent):
                found = [set() for _ in range(2)]
                for key, row in J.block_keys(np.r_[a, b], np.array([len(a), len(b)]), percent):
                    for i in range(2):
                        found[i] |= set(key[row == i].tolist())
                assert found[0] & found[1]


def test_family_of_near_copies(spark):
    """2000 near copies of one text, most of which do not link with each other, and a chain of links among them."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"e{i}x{k}" if rng.random() < 0.06 else w for k, w in enumerate(base))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, block=256).collect()}
    assert len(set(got.values())) > 100
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in range(len(rows)):
        least.setdefault(root(i), i)
    assert got == {i: least[root(i)] for i in range(len(rows))}


@pytest.mark.parametrize(("seed", "length", "edits"), [(1, 60, 2), (2, 120, 3)])
def test_chains(spark, seed, length, edits):
    rows = varied(seed, 220, length, edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.jaccard_components(docs)) == by_hand(rows)


def test_blocks_of_large_clusters(spark):
    """Small blocks, a weak bitmap and frequent passages, so that every path of the product is walked."""
    rng = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = varied(7, 120, 50, 3)
    rows += [(10_000 + i, " ".join(f"u{i}x{k}" for k in range(rng.randint(2, 40))) + " " + shared) for i in range(120)]
    rows += [(20_000 + i, f"head{i % 40} " + " ".join(f"b{k}" for k in range(40))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand(rows)
    assert result(J.jaccard_components(docs, most_bits=8, block=8)) == want
    assert result(J.jaccard_components(docs, most_bits=8, block_grams=150)) == want


def test_other_thresholds(spark):
    rows = varied(5, 150, 40, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((5, 80), (2, 100)):
        assert result(J.jaccard_components(docs, words=n, percent=percent)) == by_hand(rows, n, percent)


def test_odd_rows(odd, none):
    docs = odd.withColumn("component_id", F.lit("mine")).withColumn("s", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(J.jaccard_components(docs)) == by_hand(rows)
    assert J.jaccard_components(none).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and {0, 1, 2} <= set(ids) and not {8, 9} <= set(ids)


def test_lists_hold_shared_keys_alone(spark, monkeypatch):
    """However small the bitmaps are, a key that one set has is in no list."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(30)]
    texts += [texts[0] + " end", texts[0], texts[1] + " end"]
    put, alone = J.stored, []

    def seen(df, name="part", result=False):
        out = put(df, name, result)
        if name == "postings":
            alone.append(out.groupBy("k").count().where("count = 1").count())
        return out

    monkeypatch.setattr(J, "stored", seen)
    out = J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_bits=8)
    assert {r.doc_id: r.component_id for r in out.collect() if r.doc_id != r.component_id} == {30: 0, 31: 0, 32: 1}
    assert alone == [0]


def test_keys_of_very_many_sets_fill_no_bucket():
    """Two pairs of a key for each sort, the others elsewhere; no pair of a shared key is lost, none of another stays."""
    texts = ["one two three four five six seven eight nine ten " * 2 + f"w{i % 40} v{i % 40}" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["rid", "t"])
    rows, want = np.full(8, 255, np.uint8), defaultdict(set)
    for h, size, a, _ in J._incidence([batch], 3, rows):
        for k, row in J.block_keys(h, size, 80):
            for key, f in zip(k.tolist(), a[row].tolist()):
                want[key].add(f)
    want = {(k, f) for k, fs in want.items() if len(fs) > 1 for f in fs}
    assert want
    made = [pa.Table.from_batches([b]) for part in (batch.slice(i, 50) for i in range(0, 400, 50)) for b in J._keys(3, 80, rows, 4)([part])]
    table = pa.concat_tables(made)
    got = set()
    for bucket in set(table.column("bucket").to_pylist()):
        mine = table.filter(pa.array([b == bucket for b in table.column("bucket").to_pylist()]))
        if bucket < 4:
            counts = defaultdict(int)
            for k in J._joined(mine.column("k"))[0].tolist():
                counts[k] += 1
            assert max(counts.values()) <= 2 * 8
        out = J._shared(4)(mine)
        got |= set(zip(out.column("k").to_numpy().view(np.uint64).tolist(), out.column("f").to_numpy().view(np.uint64).tolist()))
    assert got == want


def test_keys_go_to_buckets_in_passes(spark, monkeypatch):
    """Each pass deals its own share of the keys, so that the disk holds no more than that at once; links are those of one pass."""
    rows = varied(3, 60, 50, 2)
    put, passes = J.stored, []

    def seen(df, name="part", result=False):
        out = put(df, name, result)
        if name == "postings":
            passes.append({r.k for r in out.collect()})
        return out

    monkeypatch.setattr(J, "stored", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.jaccard_components(docs)) == by_hand(rows) and len(passes) == 1
    monkeypatch.setattr(J, "PASS_GRAMS", 1)
    assert result(J.jaccard_components(docs)) == by_hand(rows)
    whole, first, second = passes
    assert first and second and not first & second and first | second == whole


def test_lists_of_the_same_sets_are_one(spark):
    """Pairs of sets are met by one of the lists that have the same sets, and by each of those that do not."""
    lists = {1: "ab", 2: "ab", 3: "abc", 4: "abc", 5: "bc", 6: "ac"}
    df = spark.createDataFrame([(k, s.encode(), 9, "x") for k, names in lists.items() for s in names], "k long, s binary, n long, c string")
    got = {}
    for r in J._each_once(df).collect():
        got.setdefault(r.k, set()).add(bytes(r.s).decode())
    assert got == {1: {"a", "b"}, 3: {"a", "b", "c"}, 5: {"b", "c"}, 6: {"a", "c"}}
