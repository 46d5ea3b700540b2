from __future__ import annotations

import pytest

#: Texts that operators have to take: null, empty, blank, short, repeated, non-ASCII, of one line and of many.
ODD = [None, "", " \t\n", "a", "one two", "é ü ñ", "line\n\n line \nLINE\n", "x" * 3000, "repeat it now " * 40, "repeat it now " * 40, "日本語 テキスト " * 20, "a\x0bb\x0cc\rd"]


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text, lang, source, n_chars with nulls in every column and repeated rows."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None, "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "a", 1), (None, "one two three four", "en", "a", 18), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(doc_id, text) as Python rows."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
