"""Verdicts over links between pages, against the SQL and against expected verdicts."""

import duckdb

from staygrid.llm import queries, redirects

PAGES = [
    (1, "http://a.example.net/x", '<html><link rel="canonical" href="https://www.shop.com/de/1"></html>', "block"),
    (2, "https://www.shop.com/de/1?utm_source=feed#top", "<html></html>", "block"),
    (3, "https://b.net/y", "<meta http-equiv='Refresh' content='0; URL=http://a.example.net/x#part'>", "block"),
    (4, "https://b.net/z", "<!-- <link rel=canonical href=http://a.example.net/x> -->", "allow"),
    (5, "https://fine.org/alias", '<LINK href="//a.example.net/x" REL="nofollow canonical"/>', "allow"),  # its own rule allows it
    (6, "https://c.net/d/e?q=1&utm_medium=m", "<link rel=canonical href='f'>", "allow"),
    (7, "https://c.net/d/f", '<script>"<link rel=canonical href=http://shop.com/de/1>"</script>', "allow"),
    (8, "https://C.NET/d/g", "<link rel='canonical' href='/d/f?a=1&amp;utm_campaign=2&amp;b=2#x'>", "allow"),
    (9, "https://d.net", "<link rel=canonical href='?x=1'>", "allow"),
    (10, "https://old.net/1", None, "block"),  # by the redirect table
    (11, None, "<link rel=canonical href='http://shop.com/de/1'>", "allow"),
    (12, "mailto:someone", "<link rel=canonical href='http://shop.com/de/1'>", "allow"),
    (13, "https://e.net/1", "<link rel=canonical href='javascript:void(0)'><link rel=stylesheet href='http://shop.com/de/1'><link rel=canonical href='#a'>", "allow"),
    (14, "https://example.org/es/1", "", "block"),
    (15, "https://sub.example.org/en/17", "", "block"),
    (16, "https://sub.example.org/en/2", "", "allow"),
    (17, "https://f.net/1", "<link rel=canonical href='https://sub.example.org/en/17'>", "block"),
    (18, "ftp://f.net:8080/1?#", "<meta content='5;url=\"/1\"' http-equiv=refresh>", "allow"),
    (None, "https://b.net/y", "", "block"),
    (3, "https://b.net/y", "", "block"),
]


def made(spark, rows=PAGES):
    pages = spark.createDataFrame([(i, u, h, "x", True) for i, u, h, _ in rows], "page_id long, url string, html string, address string, blocked boolean")
    extra = spark.createDataFrame([("https://old.net/1", "http://mid.net/2?"), ("http://mid.net/2", "https://f.net/1"), (None, "https://f.net/1"), ("x", "y")], "source string, target string")
    return pages, extra


def test_verdicts(spark):
    pages, extra = made(spark)
    found = redirects.verdicts(pages.repartition(3), redirects=extra).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in found) == sorted((i or 0, v) for i, _, _, v in PAGES)
    assert {r.alias_of for r in found if r.page_id in (1, 2, 3, 5)} == {"a.example.net/x"}


def test_equal_to_sql(spark):
    pages, extra = made(spark)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("more", extra.toArrow())
    sql = queries.redirect_sql("SELECT source, target FROM more")
    want = con.sql(sql)
    names = want.columns
    got = redirects.verdicts(pages, redirects=extra).select(*names).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def test_a_hub_and_an_empty_table(spark):
    rows = [(i, f"https://h{i}.net/", "<link rel=canonical href='https://hub.com/de/1'>", "") for i in range(3_000)]
    pages, _ = made(spark, rows)
    assert {r.verdict for r in redirects.verdicts(pages.repartition(4)).collect()} == {"block"}
    assert redirects.verdicts(pages.limit(0)).collect() == []


def test_equal_rules_allow(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a/b", None)], "page_id long, url string, html string")
    assert redirects.verdicts(pages, [("block", "net", "/a/"), ("allow", "net", "/a/")]).first().verdict == "allow"
    assert redirects.verdicts(pages, [("block", "net", "/a/"), ("allow", "net", "/")]).first().verdict == "block"
