"""URL filters against rules applied one by one."""

import pytest
from pyspark.sql import functions as F

from causeway.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http:///en/", "https://EXAMPLE.com/en/x", "https://a.b.example.com/en/?q#f", "https://www.example.com/en/", "https://x.www.example.com/en/z", "http://notexample.com/en/", "http://example.com", "http://example.com?en/", "http://example.com#/en/",
    "http://com/", "http://.com/", "http://com./", "http://net/es/", "http://a.net/fr/1", "http://a.net/de/", "http://a.org/en/", "x://y://example.com/en/", "http://user@example.com:80/en/", "http://user.example.com:80/en/", "http://ÄÖ.example.com/en/é?x", "http://a..com/x", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://example.com/EN/",
    "http://xyz.com/en/abcd", "http://xyz.com/en/abcd",
]


def plain(url, rules, default="allow"):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), ""
    if rest[end : end + 1] == "/":
        path = rest[end : min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(min(fits)[1:] if fits else (None, default))


@pytest.mark.parametrize(("most", "hot", "blocks"), [(200_000, 10**6, 500_000), (2, 3, 0), (0, 10**6, 0)])
def test_against_rules(spark, monkeypatch, most, hot, blocks):
    """Small lists by broadcast; long ones shuffled, with and without hot keys."""
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", blocks)
    rules = [*urlfilter.RULES, ("com", "/en/abcd", "block"), ("xyz.com", "/en/", "allow"), ("org", "", "block"), ("", "/", "block")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "key", "row", "id", "block", "w0", "size", "best", "verdict2")}).repartition(3)
    got = urlfilter.judge(pages, urlfilter.entries(spark, rules), most=most, hot=hot)
    assert set(pages.columns) | {"verdict"} == set(got.columns)
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    for i, u in enumerate(URLS):
        assert rows[i] == plain(u, rules), (u and u[:60], rows[i])


def test_empty_lists_and_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    none = urlfilter.entries(spark, [])
    assert {tuple(r) for r in urlfilter.judge(pages, none, default="block").select("page_id", "host", "rule", "verdict").collect()} == {(1, "a.com", None, "block"), (2, "", None, "block")}
    assert urlfilter.judge(pages.limit(0), urlfilter.entries(spark, urlfilter.RULES)).count() == 0
    bad = spark.createDataFrame([(None, "/", "block"), ("a.com", None, "block"), ("a/b", "/", "block"), ("a.com", "x", "block"), ("A.com", "/", "block"), ("a.com", "/", "allow"), ("a.com", "/", None)], "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judge(pages.filter("page_id = 1"), bad).collect()] == [("a.com/", "allow")]


def test_filter_turns_away_what_is_not_listed_and_keeps_what_is(spark):
    listed = spark.range(5_000).select(F.concat(F.lit("host"), "id", F.lit(".com/")).alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id", F.lit(".com/")).alias("key"))
    blocks = 5_000 * urlfilter.BITS_A_KEY // 512
    filt = urlfilter.bloom(listed, blocks)
    assert filt.count() <= blocks and urlfilter.possible(listed, filt, blocks).count() == 5_000
    assert urlfilter.possible(others, filt, blocks).count() < 20_000 * 0.01
