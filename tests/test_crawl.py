"""Fetching without a network, walks and domains."""

import os
import tempfile
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from folioforge.operators import domains, perimeter, sitemaps
from folioforge.sources import fetching
from folioforge.sources.fetching import Answer


@pytest.mark.parametrize(
    ("url", "sent"),
    [
        ("https://bücher.test/ä b?q=ü#ß", "https://xn--bcher-kva.test/%C3%A4%20b?q=%C3%BC#%C3%9F"), ("https://a.test/%C3%A4", "https://a.test/%C3%A4"), ("http://a.test:8080/x", "http://a.test:8080/x"),
        ("http://u:p@a.test/", "http://u:p@a.test/"), ("http://[::1]:5/", "http://[::1]:5/"), (" https://a.test ", "https://a.test"),
    ],
)
def test_encoded_url(url, sent):
    assert fetching.encoded_url(url) == sent and fetching.encoded_url(sent) == sent


def test_retries():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) == 1:
            raise URLError("lost")
        return Answer(200, {}, b"x", url)

    assert fetching.with_retries(flaky, "u", sleep=waits.append).body == b"x" and waits == [fetching.DELAY]
    with pytest.raises(HTTPError):
        fetching.with_retries(lambda u: (_ for _ in ()).throw(HTTPError(u, 404, "no", {}, None)), "u", sleep=waits.append)
    assert len(waits) == 1  # what a client did wrong is not asked again
    assert fetching.with_retries(lambda u: Answer(503, {}, b"", u), "u", sleep=waits.append).status == 503 and len(waits) == 2


def test_fetch_pages_and_cache(spark):
    def opener(url):
        if "lost" in url:
            raise URLError("lost")
        if "xml" in url:
            return Answer(200, {"Content-Type": "application/xml"}, b"<a/>", url)
        if "big" in url:
            return Answer(200, {"content-type": "text/html"}, b"x" * (fetching.MOST_PAGE_BYTES + 1), url)
        if "gone" in url:
            return Answer(404, {"content-type": "text/html"}, b"no", url)
        return Answer(200, {"Content-Type": "text/html; charset=iso-8859-1"}, "für".encode("latin-1"), url + "/")

    urls = [("https://a.test/1",), ("https://a.test/1",), ("https://a.test/xml",), ("https://a.test/lost",), ("https://a.test/big",), ("https://a.test/gone",), (None,)]
    df = spark.createDataFrame(urls, "page_url string")
    with tempfile.TemporaryDirectory() as folder:
        got = {r["page_url"][15:]: r for r in fetching.fetch_pages(df, opener, cache=folder, delay=0.0).collect()}
        assert len(got) == 5
        assert got["1"]["status"] == "present" and got["1"]["html"] == "für" and got["1"]["final_url"].endswith("/1/") and got["1"]["headers"]["content-type"].startswith("text/html")
        assert got["xml"]["status"] == "not_html" and got["big"]["status"] == "not_html"
        assert got["lost"]["status"] == got["gone"]["status"] == "unavailable" and "lost" in got["lost"]["error"] and got["gone"]["error"] == "status 404"
        assert sum(len(f) for _, _, f in os.walk(folder)) == 1
        again = fetching.fetch_pages(df.where("page_url like '%1'"), lambda u: (_ for _ in ()).throw(AssertionError("asked")), cache=folder)
        assert again.first()["html"] == "für"


def test_sitemap_walk_ends(spark):
    files = spark.createDataFrame([("i", "<sitemapindex><loc>i</loc><loc>a.xml</loc><loc>no.xml</loc></sitemapindex>"), ("a.xml", "<urlset><loc>p</loc><loc>q</loc><loc>p</loc></urlset>")], "url string, text string")
    roots = spark.createDataFrame([("s", "i"), ("s", "i"), ("t", "nowhere")], "site string, url string")
    assert sorted(map(tuple, sitemaps.walk(roots, files).collect())) == [("s", "p", "a.xml", 1), ("s", "q", "a.xml", 1)]
    assert sitemaps.walk(roots, files, of_site=1).count() == 1 and sitemaps.walk(roots, files, of_file=1).count() == 1
    assert sitemaps.walk(roots.limit(0), files).count() == 0


def test_registrable_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("www.a.co.uk", "b.co.uk", "co.uk", "x.y.ck", "www.ck", "n.www.ck", "ck", "10.0.0.1", "one", "p.q.zz", "", None)], "host string")
    rules = spark.createDataFrame([(r,) for r in ("uk", "co.uk", "*.ck", "!www.ck", None)], "suffix string")
    got = {r["host"]: (r["suffix"], r["domain"], r["confidence"]) for r in domains.registrable_domains(hosts, rules).collect()}
    assert got["www.a.co.uk"] == ("co.uk", "a.co.uk", "high") and got["b.co.uk"] == ("co.uk", "b.co.uk", "high") and got["co.uk"][:2] == ("co.uk", None)
    assert got["x.y.ck"] == ("y.ck", "x.y.ck", "high") and got["www.ck"] == ("ck", "www.ck", "high") and got["n.www.ck"][1] == "www.ck"
    assert got["10.0.0.1"][:2] == (None, None) and got["p.q.zz"] == ("zz", "q.zz", "low") and got["one"] == ("one", None, "low") and len(got) == 10


@pytest.mark.parametrize(
    ("rule", "path", "meets"),
    [("/*.pdf$", "/a/b.pdf", True), ("/*.pdf$", "/a/b.pdf?x", False), ("/*.pdf$", "/a", False), ("/$", "/", True), ("/$", "/a", False), ("/a*b", "/axxb/c", True), ("/a.b", "/axb", False), ("/a(1)+", "/a(1)+x", True), ("*", "/x", True)],
)
def test_rule_patterns(spark, rule, path, meets):
    df = spark.createDataFrame([(rule, path)], "rule string, path string")
    assert df.select(F.rlike("path", perimeter.rule_pattern(F.col("rule"))).alias("m")).first()["m"] is meets


def test_a_rule_for_a_file_type_leaves_the_site_open(spark):
    robots = spark.createDataFrame([("s", "present", "User-agent: *\nDisallow: /*.pdf$\nAllow: /ok.pdf")], "site string, status string, text string")
    paths = spark.createDataFrame([("s", p) for p in ("/", "/x.pdf", "/ok.pdf", "/x.pdf.html")], "site string, path string")
    got = {r["path"]: r["allowed"] for r in perimeter.allowed(robots, ["GPTBot"], paths).collect()}
    assert got == {"/": True, "/x.pdf": False, "/ok.pdf": True, "/x.pdf.html": True}
