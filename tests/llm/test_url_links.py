"""Links of pages: every one counts, targets of any form are resolved as browsers do."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from strandmill.llm import url_filter as uf


def test_targets_resolve(spark):
    pages = ["http://a.org/x/y/z.html?q=1#f", "http://a.org", "http://a.org/", "https://B.org/x/"]
    targets = ["home.html", "?id=3", "/top", "//c.org/d", "../up", "./here/", "../../../far/.", "d/../e?p=/../k", "http://e.org/a/../b"]
    rows = [(u, t) for u in pages for t in targets]
    table = spark.createDataFrame(rows, "url string, t string")
    got = {(r.url, r.t): r.b for r in table.withColumn("b", uf.address_of(uf.resolved(F.col("t"), F.col("url")))).collect()}
    for u, t in rows:
        want = t if "://" in t else urljoin(u.replace("#f", "") if t[0] != "?" else u, t)
        rest = want.split("://", 1)[1].split("#")[0]
        host, _, tail = rest.partition("/")
        want = host.lower() + ("/" + tail if _ else "")
        if u == "http://a.org" and t == "?id=3":
            want = "a.org?id=3"
        assert got[u, t] == want, (u, t)


def test_no_target(spark):
    rows = [(u, t) for u in ("http://a.org/x", "no scheme", None) for t in ("#top", "", "mailto:a@b.c", None)]
    table = spark.createDataFrame([*rows, ("no scheme", "x.html")], "url string, t string")
    assert table.where(uf.resolved(F.col("t"), F.col("url")).isNotNull()).count() == 0


def test_every_link_carries_the_verdict(spark):
    html = """<LINK href='two.html' rel=canonical><link rel="canonical" href="http://bad.net/x?a=1&amp;b=2">
    <meta http-equiv="refresh" content="0; url=three.html"><meta http-equiv=refresh content="1;URL=http://a.org/four">"""
    pages = [(1, "http://a.org/p/one", html), (2, "http://a.org/p/two.html", ""), (3, "http://a.org/p/three.html", None), (4, "http://a.org/four", ""), (5, "http://a.org/p/five", ""), (6, None, html)]
    table = spark.createDataFrame([(*p, "r", "v") for p in pages], "page_id int, url string, html string, rule string, own string")
    rules = spark.createDataFrame([("bad.net", "/", "block"), ("a.org", "/four", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.verdict, r.by) for r in uf.judge(table, rules).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "rule"), 5: ("allow", "default"), 6: ("allow", "default")}
    assert uf.judge(table.limit(0), rules).count() == 0
