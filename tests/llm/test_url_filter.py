from strandmill.llm import url_filter as uf

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
PAGES = [
    (1, "http://WWW.Example.com/en/1?x#y", "allow", "www.example.com/en/"),
    (2, "https://a.example.com/en/", "block", "example.com/en/"),
    (3, "https://example.com/EN/", "allow", "com/"),
    (4, "http://x.net/es/q", "block", "net/es/"),
    (5, "http://net/es", "allow", None),
    (6, None, "allow", None),
    (7, "no scheme/en/", "allow", None),
    (8, "http://notexample.com?/en/", "allow", None),
    (9, "x://y://com/", "allow", None),
]


def frame(spark, html="", pages=PAGES):
    return spark.createDataFrame([(i, u, html, "k") for i, u, *_ in pages], "page_id long, url string, html string, verdict string")


def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def test_rules_inline_and_joined(spark, monkeypatch):
    for most in (200, 0):
        monkeypatch.setattr(uf, "INLINE", most)
        got = {r.page_id: (r.verdict, r.rule) for r in uf.judge(frame(spark), rules(spark)).collect()}
        assert got == {i: (v, r) for i, _, v, r in PAGES}


def test_aliases_of_blocked_addresses(spark):
    def link(to):
        return f'<head><LINK href="{to}" rel=canonical></head>'

    pages = [
        (1, "http://a.org/1", link("http://b.org/1")),
        (2, "http://b.org/1", '<meta http-equiv="refresh" content="0; url=/2">'),
        (3, "http://b.org/2", link("https://x.net/es/9")),
        (4, "http://c.com/", link("http://b.org/2#frag")),
        (5, "http://d.org/", link("http://e.org/")),
        (6, "http://f.org/", None),
        (7, "https://A.org/1#top", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://f.org/", "http://g.org/"), ("http://g.org/", "http://a.org/1"), (None, "http://d.org/")], "source string, target string")
    got = {r.page_id: (r.verdict, r.by) for r in uf.judge(df, rules(spark), moved).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "rule"), 5: ("allow", "default"), 6: ("block", "alias"), 7: ("block", "alias")}


def test_long_chain_and_empty_table(spark):
    chain = spark.createDataFrame([(f"http://h{k}.org/", f"http://h{k + 1}.org/") for k in range(40)] + [("http://h40.org/", "http://h.net/es/")], "source string, target string")
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", "") for k in range(41)] + [(99, "http://h99.org/", "")], "page_id long, url string, html string")
    got = {r.page_id for r in uf.judge(pages, rules(spark), chain).where("verdict = 'block'").collect()}
    assert got == set(range(41))
    assert uf.judge(pages.limit(0), rules(spark)).count() == 0
