from __future__ import annotations

import re

from pyspark.sql import functions as F

from cluewright.llm import licences as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate(LOW))


def bigrams(w):
    return set(zip(w, w[1:]))


def by_hand(text, templates=None, threshold=L.THRESHOLD):
    templates = templates or L.all_templates()
    lines = (text or "").split("\n")
    own = [words(x) for x in lines]
    solid = [bool(re.search(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", x.translate(LOW))) for x in lines]
    segments, run, blocks = [], [], []
    for i, w in enumerate(own):
        if solid[i]:
            segments.append(("line", i, w))
            run.append(i)
        elif run:
            blocks.append(run)
            run = []
    if run:
        blocks.append(run)
    segments += [("block", b[0], sum((own[i] for i in b), [])) for b in blocks if len(b) > 1]
    if len(blocks) > 1:
        segments.append(("text", 0, sum(own, [])))
    sets = {n: bigrams(words(t)) for n, t in templates.items()}
    out = []
    for kind, line, w in segments:
        b = bigrams(w)
        if not b:
            continue
        score, name = max(((2 * len(b & t) / (len(b) + len(t)), n) for n, t in sorted(sets.items())), key=lambda x: x[0])
        if score >= threshold:
            out.append((line, kind, name, round(score, 9)))
    return sorted(out)


def found(rows):
    return {r.doc_id: sorted((m.line, m.kind, m.license, round(m.score, 9)) for m in r.matches) for r in rows}


def test_all_segments_by_hand(spark, sf, documents):
    got = found(L.license_scan(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect())
    assert got == {i: by_hand(t) for i, t in documents}
    assert any(got.values())


def test_query(spark, sf, documents):
    for r in L.op10_licences(spark, sf).collect():
        own = by_hand(dict(documents)[r.doc_id])
        assert r.n_matches == len(own)
        if own:
            best = min(own, key=lambda m: (-m[3], m[2]))
            assert (r.license, round(r.score, 9)) == (best[2], best[3])


def test_templates_near_and_far(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0 header"]
    wrapped = re.sub(r"((?:\S+ ){9})", r"\1\n", mit)
    rows = [
        (1, mit), (2, "code\n\n" + wrapped.upper() + "\n\nmore code here"), (3, mit.replace("free of charge", "at no charge")), (4, " ".join(mit.split()[:30])),
        (5, apache + " " + mit), (6, "/* " + wrapped.replace("\n", "\n * ") + " */"), (7, "Released under the MIT License."), (8, "released to the public"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(L.license_scan(docs).collect())
    assert got == {i: by_hand(t) for i, t in rows}
    assert {m[2] for m in got[2]} == {"MIT"} and got[3] and not got[4] and not got[5] and not got[8] and got[7][0][2] == "MIT notice"
    assert {m[2] for m in got[6]} == {"MIT"}


def test_odd_rows(odd, none):
    out = L.license_scan(odd.withColumn("Matches", F.lit(1)))
    assert out.count() == odd.count() and out.where("size(matches) > 0").count() == 0
    assert L.license_scan(none).count() == 0


def test_passages_over_blocks_and_within_lines(spark, tmp_path):
    """Licences in their usual layout of several paragraphs, in comments above code and within longer lines."""
    T = L.TEMPLATES
    cut = lambda t, *marks: re.sub("|".join(f"(?={re.escape(m)})" for m in marks), "\n\n", t)
    mit = "MIT License\n\nCopyright (c) 2020 A Name\n\n" + cut(T["MIT"], "The above copyright") + "\n\n" + T["MIT warranty"]
    apache = "Copyright 2020 A Name\n\n" + cut(T["Apache-2.0 header"], "You may obtain", "Unless required")
    gpl = cut(T["GPL-3.0 header"], "This program is distributed", "You should have")
    bsd = "Copyright (c) 2020, A Name\nAll rights reserved.\n\n" + cut(T["BSD-3-Clause"], "1. ", "2. ", "3. ") + "\n\n" + T["BSD warranty"]
    code = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(60))
    above = "".join(f"# {x}\n" for x in apache.split("\n")) + "\n" + code
    inline = "Some words before that. Released under the MIT License. And as many words after it, in one long line."
    texts = {1: mit, 2: apache, 3: gpl, 4: bsd, 5: above, 6: inline, 7: code, 8: "prose of no licence " * 300, 9: code + "\n" + mit}
    want = {1: {"MIT", "MIT warranty"}, 2: {"Apache-2.0 header"}, 3: {"GPL-3.0 header"}, 4: {"BSD-3-Clause", "BSD warranty"}, 5: {"Apache-2.0 header"}, 6: {"MIT notice"}, 7: set(), 8: set(), 9: {"MIT", "MIT warranty"}}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.passages for r in L.license_scan(docs).collect()}
    assert {i: {m.license for m in p} for i, p in got.items()} == want
    assert min(m.line for m in got[9]) == code.count("\n") + 5
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in L.op10_licences(spark, str(tmp_path)).collect()}
    assert all(want[i] <= set(out[i].licenses) and bool(out[i].license) == bool(want[i]) for i in texts)


def test_whole_licences(spark):
    """Whole licence files, as they are, rewrapped, or below code, are found as themselves; half of one is not."""
    whole = {n: t for n, t in L.all_templates().items() if n not in L.TEMPLATES}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} == set(whole) and len(L.TEMPLATES) == 19
    code = "\n".join(f"int f{i}(int x) {{ return x + {i}; }}" for i in range(80))
    names = [*sorted(whole), "Unlicense", "zlib", "BSL-1.0"]
    rows = []
    for name in names:
        text = L.all_templates()[name]
        rows += [(name, text), (name, re.sub(r"\s+", " ", text)), (name, code + "\n\n" + text + "\n\n" + code), ("", text[: len(text) // 2])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {m.license for m in [*r.passages, *r.matches]} for r in L.license_scan(docs).collect()}
    for i, (name, _) in enumerate(rows):
        assert (name in got[i]) if name else not got[i] & set(names), (i, name, got[i])
