import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dom, signals, urls
from folioforge.functions import text as T
from folioforge.functions.html_blocks import extract_blocks
from folioforge.sources.connectors import decode_body, is_public_host


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://WWW.A.example:8080/x", "a.example"), ("http://m.b.test", "b.test"), ("c.example/x?y", "c.example"), ("https://u:p@d.test/", "d.test"), ("", ""), (None, None), ("https://[::1]:80/x", "[::1]")],
)
def test_host(spark, url, host):
    assert one(spark, url, urls.page_host) == host


@pytest.mark.parametrize(
    ("path", "key"), [("/blog/2024/my-post-1", "/blog/*/*"), ("/Pricing/", "/pricing"), ("/", "/"), ("/a/0123456789012345678901234", "/a/*"), ("/shop/red-shoe", "/shop/red-shoe")]
)
def test_template_key(spark, path, key):
    assert one(spark, path, urls.template_key) == key


@pytest.mark.parametrize(
    ("href", "url"),
    [("/x", "https://a.example/x"), ("y.html", "https://a.example/d/y.html"), ("//b.test/z", "https://b.test/z"), ("#top", None), ("mailto:a@b", None), ("https://c.test/q#f", "https://c.test/q"), ("", None)],
)
def test_resolve(spark, href, url):
    assert one(spark, href, lambda c: urls.resolve(c, F.lit("https://a.example/d/p?x=1"))) == url


@pytest.mark.parametrize(("path", "about"), [("/about", True), ("/roundabout", False), ("/x/About-Us.html", True), ("/Wiki:About", True), ("/company-news", False)])
def test_about(spark, path, about):
    assert one(spark, path, urls.is_about_path) is about


def test_sentences(spark):
    got = one(spark, "Dr. Bell came. She sat down! \"Why?\" asked he. It cost 3.5 crowns.", T.sentences)
    assert got == ["Dr. Bell came.", "She sat down!", '"Why?" asked he.', "It cost 3.5 crowns."]
    assert one(spark, None, T.sentences) is None


@pytest.mark.parametrize(("word", "n"), [("walked", 1), ("wanted", 2), ("boxes", 2), ("makes", 1), ("quickly", 2), ("the", 1), ("", 0), ("changes", 2)])
def test_syllables(spark, word, n):
    assert one(spark, word, T.syllables) == n


@pytest.mark.parametrize(
    ("style", "how"),
    [("display: none", "display:none"), ("display:none;display:block", None), ("text-indent:-9999px", "text-indent"), ("position:absolute;left:-2000px", "off to the left"), ("left:-2000px", None), ("", None),
     ("clip: rect(0, 0, 0, 0) !important", "clip"), ("WIDTH:0", "no width"), ("opacity:.5", None)],
)
def test_concealment(style, how):
    assert dom.conceals(dom.declarations(style)) == how


@pytest.mark.parametrize(("c", "d"), [("2024-03-05", "2024-03-05"), ("3/5/2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("Mar 5 2024", "2024-03-05"), ("soon", None)])
def test_claimed_date(spark, c, d):
    got = one(spark, c, signals.parse_claimed_date)
    assert (str(got) if got else None) == d


def test_decode_body():
    assert decode_body(gzip.compress("grün".encode()), "gzip", None) == "grün"
    assert decode_body(zlib.compress(b"x"), "deflate", "ascii") == "x"
    assert decode_body("grün".encode("cp1252"), None, None) == "grün"
    assert decode_body(b"x", "br", None) is None and decode_body(None, None, None) is None and decode_body(b"no gzip", "gzip", None) is None


@pytest.mark.parametrize(("host", "ok"), [("a.example", True), ("127.0.0.1", False), ("192.168.1.5", False), ("172.20.0.1", False), ("localhost", False), ("8.8.8.8", True), ("[::1]", False)])
def test_public_host(spark, host, ok):
    assert one(spark, host, is_public_host) is ok


def test_blocks_of_broken_html():
    assert extract_blocks(None) == [] and extract_blocks("") == []
    got = extract_blocks("<p>one<b>two<br><p>three<script>var t='</p>'</script><li>four &amp; more<!-- no -->")
    assert [b.text for b in got] == ["onetwo", "three", "four & more"]
    nested = extract_blocks("<title>T</title><main><h1>H</h1><blockquote>a<p>b</p>c</blockquote></main>bare <em>text</em>")
    assert [(b.text, b.in_main, b.heading) for b in nested] == [("T", False, None), ("a", True, "H"), ("b", True, "H"), ("c", True, "H"), ("bare text", False, "H")]
