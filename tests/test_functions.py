"""URL, tree, schedule and scope functions on inline fixtures."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.functions.urls import normalize_url, resolve_url, same_url
from siteloom.operators.crawl import custom_headers, next_run, wildcard_regex
from siteloom.operators.queries import parse_diff_id
from siteloom.operators.registry import DEFAULTS
from siteloom.sources.pages import cut_bytes, parse_page, xpath_to_css


def test_normal_forms():
    assert normalize_url("HTTPS://EXAMPLE.com:443/Path//to//page/#top") == "https://example.com/Path/to/page"
    assert normalize_url("https://example.com?b=2&a=1&a=0") == "https://example.com/?a=1&a=0&b=2"
    assert normalize_url("https://example.com/?q=a b") == "https://example.com/?q=a+b"
    assert normalize_url("not a url") is None and same_url("x", "y")


@settings(max_examples=60, deadline=None)
@given(st.text("abc/?&=.:é %#", max_size=20))
def test_normalising_twice_changes_nothing(path):
    once = normalize_url("https://a.example/" + path)
    assert once is None or normalize_url(once) == once


def test_resolving():
    assert resolve_url("https://a.b/x/y", "./post") == "https://a.b/x/post"
    assert resolve_url("https://a.b/x/y", "../post") == "https://a.b/post"
    assert resolve_url("https://a.b/x/y", "../post", compat=True) == "https://a.b/x/post"
    assert resolve_url("http://a.b/", "//c.d/e") == "https://c.d/e"
    assert resolve_url("http://a.b/", "mailto:x@y.z") is None


PAGE = """<!DOCTYPE html><html amp><head><title> T&amp;t </title><meta name="description" content=" d "><link rel="canonical" href="/c"><meta name="robots" content="NoIndex, follow">
<link rel="alternate" hreflang="de" href="/de"><link rel="amphtml" href="/amp"><link rel="next" href="/2"><meta property="og:title" content="o"><meta name="twitter:card" content="s">
<script type="application/ld+json">{"@type":"Product"}</script><script type="application/ld+json">{bad</script></head>
<body><h1>One</h1><h2>Two<h2>Three</h2><p>SKU: ABC-123<img src=a alt="x" width=1 height=1><img src=b alt=""><img src=c loading=lazy><img src=d>
<a href="/in" rel="nofollow">in</a><a href="https://other.example/">out</a><a href="/sitemap.xml">map</a>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">N</span><meta itemprop="sku" content="S"></div></body></html>"""


def test_page_record():
    rules = [{"id": 1, "name": "a", "rule_type": "css", "selector": "img[alt]", "attribute": "src"}, {"id": 2, "name": "b", "rule_type": "regex", "selector": r"SKU: (\S+?)<"}, {"id": 3, "name": "c", "rule_type": "css", "selector": "div["}, {"id": 4, "name": "d", "rule_type": "xpath", "selector": "//link[@rel='canonical']/@href"}]
    r = parse_page("https://a.b/x", PAGE, rules)
    assert (r["title"], r["meta_description"], r["canonical_url"], r["noindex"], r["nofollow"]) == ("T&t", " d ", "https://a.b/c", True, False)
    assert (r["h1_text"], r["headings_h2"], r["is_amp"], r["amp_html_url"], r["pagination_next"]) == (["One"], ["Two", "Three"], True, "https://a.b/amp", "https://a.b/2")
    assert (r["image_count"], r["images_without_alt"], r["images_missing_dimensions"], r["images_missing_lazy_loading"]) == (4, 3, 3, 1)
    assert r["open_graph"] == {"title": "o"} and r["twitter_card"] == {"card": "s"} and len(r["structured_data"]) == 2
    assert [(x["is_internal"], x["is_no_follow"], x["anchor_text"]) for x in r["links"]] == [(True, True, "in"), (False, False, "out"), (True, False, "map")]
    assert r["hreflang_alternates"] == ["de"] and r["sitemap_links"] == ["/sitemap.xml"]
    e = {x["id"]: x for x in r["extractions"]}
    assert e[1]["values"] == ["a", "b"] and e[2]["value"] == "ABC-123" and "Invalid CSS selector" in e[3]["error"] and e[4]["value"] == "/c"
    empty = parse_page("", "")
    assert empty["title"] is None and empty["word_count"] == 0


def test_small_helpers():
    assert cut_bytes("é" * 60) == "é" * 50
    assert xpath_to_css("//a[@rel='x'][2]/@href") == ('a[rel="x"]', "href")
    assert wildcard_regex("/a*b?$") == "^/a.*b.$"
    assert custom_headers('{"a": 1}') == [("a", "1")] and custom_headers("nope") == []
    assert parse_diff_id("10:11") == (10, 11)
    with pytest.raises(ValueError):
        parse_diff_id("10")
    assert len(DEFAULTS) == 63


def test_schedules():
    now = datetime(2024, 1, 31, 23, 59, 30)
    assert next_run("*/15 * * * *", now) == datetime(2024, 2, 1)
    assert next_run("0 0 29 2 4", now) == datetime(2024, 2, 29)
    assert next_run("0 0 30 2 *", now) is None
    with pytest.raises(ValueError):
        next_run("60 * * * *", now)


def test_references_without_semicolon():
    from siteloom.sources.dom import parse

    page = "<title>a &amp; b &amp</title><p title='x&amp'>&copy;&middot &#65;&#x42;"
    assert parse_page("", page)["title"] == "a & b &" and parse_page("", page, closed=True)["title"] == "a & b &amp"
    assert parse(page, closed=True).children[1].text() == "©&middot AB" and parse(page).children[1].text() == "©· AB"


def test_average_words_round_the_quotient_of_hundreds(spark):
    from pyspark.sql import functions as F

    from siteloom.operators import text_stats as S

    got = S.readability(spark.createDataFrame([(" ".join(["a"] * 364) + "." + " b." * 39,)], "text string"), F.col("text")).first()
    assert (got.words, got.sentence_count, got.avg_words_per_sentence) == (403, 40, 10.08)
