from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from cluewright.plans.storage import CLEANUP, stored


def test_threads_share_the_setting(spark):
    """Tables written by several threads are whole, and the session's setting is what it was."""
    before = spark.conf.get(CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda n: stored(spark.range(n).selectExpr("id % 7 as k").groupBy("k").count()), range(1, 9)))
    assert [t.agg({"count": "sum"}).first()[0] for t in tables] == list(range(1, 9))
    assert spark.conf.get(CLEANUP, "false") == before
