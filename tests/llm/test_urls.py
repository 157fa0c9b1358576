import re

import pytest
from pyspark.sql import functions as F

from loomwork.llm import bloom, urls

CASES = [
    ("http://A.org/x", "a.org", "/x", "org/", "allow"), ("https://sub.Example.ORG/es/1", "sub.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/#a", "x.com", "/de/", "com/de/", "block"), ("http://x.com/fr", "x.com", "/fr", None, "allow"),
    ("http://a.org", "a.org", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("", "", "", None, "allow"), ("x://?q://y", "", "", None, "allow"), ("http://bad.net/page/index.html", "bad.net", "/page/index.html", None, "block"),
    ("http://www.bad.net/page/", "www.bad.net", "/page/", None, "block"), ("http://bad.net/other", "bad.net", "/other", None, "allow"), ("ftp://ÄB.com/de/x", "Äb.com", "/de/x", "com/de/", "block"), ("http://org/", "org", "/", "org/", "allow"),
]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_judge(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(CASES)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.net/page",), ("bad.net/page",), (None,), ("",)], "u string")
    got = {r.page_id: r for r in urls.judge(pages, listed).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), CASES[i]
    assert urls.judge(pages, listed.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0
    assert urls.judge(pages.limit(0), listed).count() == 0


def test_filter_loses_nothing(spark):
    listed = spark.range(5000).selectExpr("concat('h', id, '.net/p') AS u")
    pages = spark.range(20000).selectExpr("id AS page_id", "concat('http://h', id, '.net/p') AS url")
    got = urls.judge(pages, listed)
    assert got.where("verdict = 'block'").count() == 5000 and got.where("verdict = 'block' AND page_id >= 5000").count() == 0
    keys = pages.selectExpr("concat('h', page_id, '.net/p') AS u", "page_id")
    passed = bloom.Filter(listed, "u", 5000).marked(keys, F.col("u"), "maybe").where("maybe")
    assert passed.where("page_id < 5000").count() == 5000 and passed.where("page_id >= 5000").count() / 15000 < 0.02


@pytest.mark.parametrize("limit", [1 << 30, 100_000, 0])
def test_having_and_lacking(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", limit)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, *range(3000), 7])], "k long, i long")
    listed = spark.range(0, 6000, 3)
    got = {r.i for r in bloom.having(rows, F.col("k"), listed, "id").collect()}
    assert got == {r.i for r in rows.where("k % 3 = 0").collect()}
    assert {r.i for r in bloom.lacking(rows, F.col("k"), listed, "id").collect()} == set(range(3002)) - got
    assert bloom.having(rows, F.col("k"), listed.limit(0), "id").count() == 0 and bloom.lacking(rows, F.col("k"), listed.limit(0), "id").count() == 3002


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = urls.judge(pages, spark.createDataFrame([("a.b/c",)], "u string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
