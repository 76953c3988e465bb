"""Nodes and links of the URL filter: fragments, attributes and forms of one URL."""

import pytest
from pyspark.sql import functions as F

from trackgrid.llm import urlgroups

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
PAGES = "page_id long, url string, html string"


def judged(spark, rows):
    found = urlgroups.judge_urls(spark.createDataFrame(rows, PAGES), urlgroups.rule_table(spark, RULES))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}


def test_a_fragment_begins_behind_the_host(spark):
    got = judged(spark, [(1, "x#y://example.org/es/1", None), (2, "#://z.com/de/1#f", None), (3, "a#b", None), (4, "http://z.com#/de/1", None)])
    assert got == {1: ("example.org", "/es/1", "example.org/es/", "block"), 2: ("z.com", "/de/1", "com/de/", "block"), 3: ("", "", None, "allow"), 4: ("z.com", "", None, "allow")}


@pytest.mark.parametrize("tag", [
    '<link data-href="http://good.example/" rel="canonical" href="http://z.com/de/1">', "<LINK HREF=http://z.com/de/1 REL=canonical>", "<link rel='alternate canonical' title='a > b' href='http://z.com/de/1'/>",
    '<link rel=canonical href=" HTTP://Z.com:80/de/1#part ">', '<meta content="0; url=http://z.com/de/1" http-equiv="Refresh">', '<meta http-equiv=refresh content="5;URL=\'http://z.com/de/1\'">', "<meta http-equiv=refresh content='0;http://z.com/de/1'>"])
def test_links_that_count(spark, tag):
    assert judged(spark, [(1, "http://alias.net/x", f"<p>{tag}</p>")])[1][3] == "block"


@pytest.mark.parametrize("tag", [
    '<link rel="stylesheet" href="http://z.com/de/1">', '<link data-rel="canonical" href="http://z.com/de/1">', '<link title="rel=canonical" href="http://z.com/de/1">', '<link rel="canonical" data-href="http://z.com/de/1">',
    '<meta name="refresh" content="0; url=http://z.com/de/1">', "<!-- link rel=canonical href=http://z.com/de/1 -->", '<link rel="canonical">'])
def test_links_that_do_not(spark, tag):
    assert judged(spark, [(1, "http://alias.net/x", f"<p>{tag}</p>")])[1][3] == "allow"


def test_one_form_of_a_place(spark):
    link = '<link rel=canonical href="{}">'
    got = judged(spark, [(1, "HTTP://A.net:80/x#1", None), (2, "http://b.net/", link.format("http://a.net/x")), (3, "https://c.net", link.format("HTTPS://D.net:443")), (4, "http://A.NET/x", link.format("http://z.com/de/1")), (5, "https://d.net/", link.format("http://z.com/de/2")),
                         (6, "http://z.com:80/de/9", None), (7, "http://a.net:8080/x", None)])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert got[6][:3] == ("z.com:80", "/de/9", None)


def test_nodes(spark):
    df = spark.createDataFrame([("HTTP://A.B:80",), ("https://a.b:443/X?y#z",), ("ftp://a:80/",), ("none#x",), (None,)], "u string")
    assert [r[0] for r in df.select(urlgroups.node_of(F.col("u"))).collect()] == ["http://a.b/", "https://a.b/X?y", "ftp://a:80/", "none#x", None]
