"""Detectors over the markup of pages: forms, links, media, directives, hydration state, dates.

Each reads all fetched pages and the small examples of its family.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import dom, markup, signals
from folioforge.functions.urls import page_host, registrable_domain, resolve, url_path
from folioforge.operators import html_rows, perimeter
from folioforge.plans.examples import all_pages, all_pages_sql
from folioforge.plans.shared import SITE, A, Query, artifacts
from folioforge.sources import once

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def lit(s: str) -> str:
    return markup.sql_string(s)


def _value(name: str) -> str:
    return rf"""(?is)[ \t\r\n"']{name}[ \t\r\n]*=[ \t\r\n]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n>"']+))"""


def has(tag: Column, name: str) -> Column:
    """Whether a start tag carries an attribute."""
    return tag.rlike(rf"""(?is)[ \t\r\n"']{name}(?:[ \t\r\n=/>]|$)""")


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag; the empty string without."""
    return F.concat(*(F.regexp_extract(tag, _value(name), g) for g in (1, 2, 3)))


def sql_has(tag: str, name: str) -> str:
    pattern = rf"""(?is)[ \t\r\n"']{name}(?:[ \t\r\n=/>]|$)"""
    return f"regexp_matches({tag}, {lit(pattern)})"


def sql_attr(tag: str, name: str) -> str:
    return "(" + " || ".join(f"regexp_extract({tag}, {lit(_value(name))}, {g})" for g in (1, 2, 3)) + ")"


def found(df: DataFrame, pattern: str, *keep: str, group: int = 0) -> DataFrame:
    """``page_id, *keep, ord, t``: all matches in html, each page once."""
    return df.select("page_id", *keep, F.posexplode(html_rows.all_of(F.col("html"), pattern, group)).alias("ord", "t")).dropDuplicates(["page_id", "ord"])


def sql_found(name: str, pattern: str, *keep: str, group: int = 0) -> str:
    cols = "".join(f", {k}" for k in keep)
    return f"{name} AS (SELECT page_id{cols}, unnest(l) AS t, unnest(range(len(l))) AS ord FROM (SELECT page_id{cols}, regexp_extract_all(html, {lit(pattern)}, {group}) AS l FROM x))"


# ---- forms

_FORM_TOKENS = r"(?is)<label(?:[ \t\r\n][^>]*)?>|</label[ \t\r\n]*>|<(?:input|select|textarea)(?:[ \t\r\n/][^>]*)?>"
# Inputs that take no label.
_NO_LABEL = ("hidden", "submit", "button", "reset", "image")


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, ord, kind, labelled`` of the fields a reader can fill.

    A label wraps its field or names its id, in either order; ``aria-label`` and
    an ``aria-labelledby`` that names an id on the page count too.
    """

    def made() -> DataFrame:
        tokens = html_rows.all_of(F.col("html"), _FORM_TOKENS, 0)
        p = all_pages(spark, sf_dir, "forms").select("page_id", tokens.alias("tk"), html_rows.all_of(F.col("html"), r"""(?is)[ \t\r\n]id[ \t\r\n]*=[ \t\r\n]*["']([^"']+)["']""", 1).alias("ids"))
        is_label = lambda t: F.lower(F.left(t, F.lit(6))) == "<label"
        is_end = lambda t: F.left(t, F.lit(2)) == "</"
        fors = F.transform(F.filter("tk", is_label), lambda t: attr(t, "for"))
        p = p.where(F.size("tk") > 0).dropDuplicates(["page_id"]).withColumn("fors", fors)
        rows = p.select("page_id", "fors", "ids", "tk", F.posexplode("tk").alias("ord", "t"))
        before = F.slice("tk", 1, F.col("ord"))
        depth = F.size(F.filter(before, is_label)) - F.size(F.filter(before, is_end))
        t = F.col("t")
        tag = F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1))
        kind = F.when(tag == "input", F.coalesce(F.nullif(F.lower(F.trim(attr(t, "type"))), F.lit("")), F.lit("text"))).otherwise(tag)
        rows = rows.withColumns({"tag": tag, "kind": kind, "depth": depth}).where(F.col("tag").isin("input", "select", "textarea") & ~F.col("kind").isin(*_NO_LABEL))
        out_of_sight = (
            has(t, "hidden") | has(t, "disabled") | ((F.col("kind") == "range") & has(t, "readonly")) | (F.lower(F.trim(attr(t, "aria-hidden"))) == "true")
            | F.arrays_overlap(F.split(attr(t, "class"), " "), F.array(F.lit("hidden"), F.lit("d-none"))) | attr(t, "style").rlike(r"(?i)display[ \t]*:[ \t]*none")
        )
        by_id = (attr(t, "id") != "") & F.array_contains("fors", attr(t, "id"))
        by_text = (F.trim(attr(t, "aria-label")) != "") | F.arrays_overlap(F.filter(F.split(attr(t, "aria-labelledby"), " "), lambda i: i != ""), F.col("ids"))
        return rows.where(~out_of_sight).select("page_id", F.col("ord").cast("long").alias("ord"), "kind", ((F.col("depth") > 0) | by_id | by_text).alias("labelled"))

    return once("form_fields", made)


_ISL, _ISE = "lower(left({0}, 6)) = '<label'", "left({0}, 2) = '</'"
_FIELDS = f"""{all_pages_sql("forms")}, tk AS (SELECT page_id, regexp_extract_all(html, {lit(_FORM_TOKENS)}) AS tk, regexp_extract_all(html, {lit(r'''(?is)[ \t\r\n]id[ \t\r\n]*=[ \t\r\n]*["']([^"']+)["']''')}, 1) AS ids FROM x),
    tf AS (SELECT *, list_transform(list_filter(tk, lambda t: {_ISL.format("t")}), lambda t: {sql_attr("t", "for")}) AS fors FROM tk), tr AS (SELECT *, unnest(tk) AS t, unnest(range(len(tk))) AS ord FROM tf),
    tt AS (SELECT *, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS tag, len(list_filter(tk[1:ord], lambda b: {_ISL.format("b")})) - len(list_filter(tk[1:ord], lambda b: {_ISE.format("b")})) AS depth FROM tr),
    tg AS (SELECT *, CASE WHEN tag = 'input' THEN coalesce(nullif(lower(trim({sql_attr("t", "type")})), ''), 'text') ELSE tag END AS kind FROM tt WHERE tag IN ('input', 'select', 'textarea')),
    fields AS (SELECT page_id, ord, kind, depth > 0 OR ({sql_attr("t", "id")} <> '' AND list_contains(fors, {sql_attr("t", "id")})) OR trim({sql_attr("t", "aria-label")}) <> '' OR list_has_any(list_filter(string_split({sql_attr("t", "aria-labelledby")}, ' '), lambda i: i <> ''), ids) AS labelled
      FROM tg WHERE kind NOT IN ({", ".join(map(lit, _NO_LABEL))}) AND NOT ({sql_has("t", "hidden")} OR {sql_has("t", "disabled")} OR (kind = 'range' AND {sql_has("t", "readonly")}) OR lower(trim({sql_attr("t", "aria-hidden")})) = 'true'
        OR list_has_any(string_split({sql_attr("t", "class")}, ' '), ['hidden', 'd-none']) OR regexp_matches({sql_attr("t", "style")}, '(?i)display[ \\t]*:[ \\t]*none')))"""


@query("b13_form_fields", f"WITH {_FIELDS} SELECT * FROM fields")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_fields(spark, sf_dir)


@query("h01_unlabelled_fields", f"WITH {_FIELDS} SELECT page_id, kind, count(*) AS fields, count(*) FILTER (NOT labelled) AS unlabelled FROM fields GROUP BY page_id, kind HAVING count(*) FILTER (NOT labelled) > 0")
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = form_fields(spark, sf_dir).groupBy("page_id", "kind").agg(F.count("*").alias("fields"), F.count_if(~F.col("labelled")).alias("unlabelled"))
    return g.where("unlabelled > 0")


_ACTION = r"""(?i)"potentialAction"|[ \t\r\n](?:data-)?toolname[ \t\r\n]*=|navigator\.modelContext\.registerTool"""


@query(
    "h02_no_machine_action",
    f"WITH {_FIELDS}, n AS (SELECT page_id, count(*) AS fields FROM fields GROUP BY page_id) SELECT page_id, fields FROM n JOIN x USING (page_id) WHERE fields >= 2 AND regexp_matches(html, '(?i)<form[ >]') AND NOT regexp_matches(html, {lit(_ACTION)})",
)
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = all_pages(spark, sf_dir, "forms").where(F.col("html").rlike("(?i)<form[ >]") & ~F.col("html").rlike(_ACTION)).select("page_id").distinct()
    n = form_fields(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("fields")).where("fields >= 2")
    return n.join(bare, "page_id", "left_semi")


# ---- directives

_NOINDEX = ("noindex", "none")


def _tokens(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    return F.sort_array(F.array_distinct(F.filter(parts, lambda t: t != "")))


_TOKENS = "list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda t: lower(trim(t))), lambda t: t <> '')))"


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, page_url, host, meta, googlebot, header`` (lists of tokens), ``noai, noimageai, tdm`` of each page's head and headers."""
    entries = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "x-robots-tag")
    p = all_pages(spark, sf_dir, "directives").select(
        "page_id", "page_url", "host", F.get(entries, F.lit(0))["value"].alias("h"),
        html_rows.all_of(F.regexp_extract("html", "(?is)^(.*?)(?:</head[ \t\r\n]*>|$)", 1), html_rows.META, 0).alias("m"),
    ).dropDuplicates(["page_id"])
    named = lambda name: F.filter("m", lambda t: F.lower(F.trim(attr(t, "name"))) == name)
    content = lambda name: F.array_join(F.transform(named(name), lambda t: attr(t, "content")), ",")
    robots = _tokens(content("robots"))
    return p.select(
        "page_id", "page_url", "host", robots.alias("meta"), _tokens(content("googlebot")).alias("googlebot"), _tokens(F.col("h")).alias("header"),
        ((F.size(named("noai")) > 0) | F.array_contains(robots, "noai")).alias("noai"), ((F.size(named("noimageai")) > 0) | F.array_contains(robots, "noimageai")).alias("noimageai"),
        F.trim(F.get(F.transform(named("tdm-reservation"), lambda t: attr(t, "content")), F.lit(0))).alias("tdm"), F.col("h").isNotNull().alias("has_header"), (F.size(named("robots")) > 0).alias("has_meta"),
    )


def _sql_named(name: str) -> str:
    return f"list_filter(m, lambda t: lower(trim({sql_attr('t', 'name')})) = '{name}')"


def _sql_content(name: str) -> str:
    return f"array_to_string(list_transform({_sql_named(name)}, lambda t: {sql_attr('t', 'content')}), ',')"


_DIRECTIVES = f"""{all_pages_sql("directives")}, dm AS (SELECT page_id, page_url, host, list_filter(map_entries(headers), lambda e: lower(e.key) = 'x-robots-tag')[1].value AS h,
      regexp_extract_all(regexp_extract(html, '(?is)^(.*?)(?:</head[ \\t\\r\\n]*>|$)', 1), {lit(html_rows.META)}) AS m FROM x),
    dr AS (SELECT page_id, page_url, host, {_TOKENS.format(_sql_content("robots"))} AS meta, {_TOKENS.format(_sql_content("googlebot"))} AS googlebot, {_TOKENS.format("h")} AS header, len({_sql_named("noai")}) > 0 OR list_contains({_TOKENS.format(_sql_content("robots"))}, 'noai') AS noai,
      len({_sql_named("noimageai")}) > 0 OR list_contains({_TOKENS.format(_sql_content("robots"))}, 'noimageai') AS noimageai, trim(list_transform({_sql_named("tdm-reservation")}, lambda t: {sql_attr("t", "content")})[1]) AS tdm, h IS NOT NULL AS has_header, len({_sql_named("robots")}) > 0 AS has_meta FROM dm)"""


@query("b24_robots_directives", f"WITH {_DIRECTIVES} SELECT page_id, array_to_string(meta, ' ') AS meta, array_to_string(googlebot, ' ') AS googlebot, array_to_string(header, ' ') AS header, noai, noimageai, tdm FROM dr WHERE has_header OR has_meta OR len(googlebot) > 0 OR noai OR noimageai OR tdm IS NOT NULL")
def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = directives(spark, sf_dir).where("has_header or has_meta or size(googlebot) > 0 or noai or noimageai or tdm is not null")
    return d.select("page_id", *(F.array_join(c, " ").alias(c) for c in ("meta", "googlebot", "header")), "noai", "noimageai", "tdm")


def _no_index(c: str) -> Column:
    return F.arrays_overlap(c, F.array(*map(F.lit, _NOINDEX)))


@query("e18_header_meta_disagree", f"WITH {_DIRECTIVES} SELECT page_id, array_to_string(header, ' ') AS header, array_to_string(meta, ' ') AS meta FROM dr WHERE has_header AND has_meta AND list_has_any(header, ['noindex', 'none']) <> list_has_any(meta, ['noindex', 'none'])")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = directives(spark, sf_dir).where("has_header and has_meta").where(_no_index("header") != _no_index("meta"))
    return d.select("page_id", F.array_join("header", " ").alias("header"), F.array_join("meta", " ").alias("meta"))


_KEYED = r"regexp_replace(regexp_replace(regexp_replace(lower(split_part(split_part({0}, '#', 1), '?', 1)), '^[a-z]+://(?:www\.)?', ''), '\.md$', ''), '/+$', '')"
_LLMS_LINK = r"\[[^\]]*\]\((https?://[^) \t\r\n]+)\)"


def _url_key(c: str) -> Column:
    plain = F.lower(F.split_part(F.split_part(F.col(c), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^[a-z]+://(?:www\.)?", ""), r"\.md$", ""), "/+$", "")


@query(
    "e16_noindex_on_declared",
    f"""WITH {_DIRECTIVES}, {A}, decl AS (SELECT DISTINCT {_KEYED.format("url")} AS key, kind FROM (SELECT kind, trim(unnest(regexp_extract_all(text, {lit(r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>")}, 1))) AS url FROM a WHERE kind = 'sitemap' AND status = 'present'
      UNION ALL SELECT kind, unnest(regexp_extract_all(text, {lit(_LLMS_LINK)}, 1)) FROM a WHERE kind = 'llms' AND status = 'present'))
    SELECT page_id, min_by(kind, CASE kind WHEN 'sitemap' THEN 0 ELSE 1 END) AS declared_in, array_to_string(any_value(header), ' ') AS header, array_to_string(any_value(meta), ' ') AS meta FROM dr JOIN decl ON {_KEYED.format("dr.page_url")} = decl.key
    WHERE list_has_any(header, ['noindex', 'none', 'noai']) OR list_has_any(meta, ['noindex', 'none']) OR noai GROUP BY page_id""",
)
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a sitemap or llms file declares and that a header or meta directive takes back."""
    maps = perimeter.sitemap_urls(artifacts(spark, sf_dir, "sitemap")).select(F.lit("sitemap").alias("kind"), "url")
    llms = artifacts(spark, sf_dir, "llms").where("status = 'present'").select(F.lit("llms").alias("kind"), F.explode(html_rows.all_of(F.col("text"), _LLMS_LINK, 1)).alias("url"))
    decl = maps.unionByName(llms).select("kind", _url_key("url").alias("key")).distinct()
    d = directives(spark, sf_dir)
    d = d.where(F.arrays_overlap("header", F.array(*map(F.lit, ("noindex", "none", "noai")))) | _no_index("meta") | F.col("noai")).withColumn("key", _url_key("page_url"))
    g = d.join(decl, "key").groupBy("page_id").agg(F.max("kind").alias("declared_in"), F.first("header").alias("h"), F.first("meta").alias("m"))
    return g.select("page_id", "declared_in", F.array_join("h", " ").alias("header"), F.array_join("m", " ").alias("meta"))


# ---- links


def anchors(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """``page_id, page_url, host, ord, href, url, label`` of the anchors of all pages; ``url`` is null for other schemes."""

    def made() -> DataFrame:
        p = all_pages(spark, sf_dir, family).select("page_id", "page_url", "host", markup.without_hidden(F.col("html")).alias("html"))
        two = F.arrays_zip(html_rows.all_of(F.col("html"), html_rows.ANCHOR, 1).alias("href"), html_rows.all_of(F.col("html"), html_rows.ANCHOR, 2).alias("inner"))
        rows = p.select("page_id", "page_url", "host", F.posexplode(two).alias("ord", "a")).dropDuplicates(["page_id", "ord"])
        return rows.select("page_id", "page_url", "host", "ord", F.trim("a.href").alias("href"), resolve(F.col("a.href"), F.col("page_url")).alias("url"), markup.plain(F.col("a.inner")).alias("label"))

    return once(f"anchors_{family}", made)


def anchors_sql(family: str) -> str:
    return f"""{all_pages_sql(family)}, ah AS (SELECT page_id, page_url, host, {markup.sql_without_hidden("html")} AS c FROM x),
    al AS (SELECT page_id, page_url, host, regexp_extract_all(c, {lit(html_rows.ANCHOR)}, 1) AS l, regexp_extract_all(c, {lit(html_rows.ANCHOR)}, 2) AS t FROM ah), ar AS (SELECT page_id, page_url, host, trim(unnest(l)) AS r, unnest(t) AS inn, unnest(range(len(l))) AS ord FROM al),
    ab AS (SELECT *, regexp_replace(r, '#.*$', '') AS clean, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://.*/)', 1) AS f0 FROM ar),
    an AS (SELECT page_id, page_url, host, ord, r AS href, {markup.sql_plain("inn")} AS label, CASE WHEN r LIKE '#%' OR r = '' THEN NULL WHEN regexp_matches(r, '^(?i)https?://') THEN clean WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(r, '//') THEN scheme || clean
      WHEN starts_with(r, '/') THEN origin || clean ELSE CASE WHEN len(f0) <= len(origin) THEN origin || '/' ELSE f0 END || clean END AS url FROM ab)"""


_UHOST = SITE.replace("page_url", "url")
_PDF = r"(?i)^[^?#]*\.pdf(?:[?#]|$)"


@query("k09_pdf_links", f"WITH {anchors_sql('links')} SELECT page_id, count(*) AS links, array_to_string(list_sort(list_distinct(list(href)))[1:3], ' ') AS shown FROM an WHERE regexp_matches(href, {lit(_PDF)}) GROUP BY page_id")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = anchors(spark, sf_dir, "links").where(F.col("href").rlike(_PDF)).groupBy("page_id").agg(F.count("*").alias("links"), F.sort_array(F.collect_set("href")).alias("h"))
    return g.select("page_id", "links", F.array_join(F.slice("h", 1, 3), " ").alias("shown"))


# Words of service addresses.
_SERVICE = "support|help|docs|status"
_DOMAIN = r"coalesce(nullif(regexp_extract({0}, '([^.]+\.[^.]+)\.?$', 1), ''), {0})"


@query(
    "i09_outside_services",
    f"""WITH {anchors_sql("links")}, sv AS (SELECT {_DOMAIN.format("host")} AS site, {_DOMAIN.format(_UHOST)} AS domain, {_UHOST} AS target, page_id, url FROM an WHERE url IS NOT NULL AND regexp_matches(lower(url), '{_SERVICE}'))
    SELECT site, domain, count(DISTINCT page_id) AS pages, min(url) AS example FROM sv WHERE domain <> site AND contains(target, split_part(site, '.', 1)) GROUP BY site, domain HAVING count(DISTINCT page_id) >= 2""",
)
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other domains that carry the site's name, look like its service and are linked from two pages or more."""
    x = anchors(spark, sf_dir, "links").where(F.col("url").isNotNull() & F.lower("url").rlike(_SERVICE))
    x = x.select(registrable_domain(F.col("host")).alias("site"), page_host("url").alias("target"), "page_id", "url").withColumn("domain", registrable_domain(F.col("target")))
    x = x.where((F.col("domain") != F.col("site")) & F.contains("target", F.split_part("site", F.lit("."), F.lit(1))))
    return x.groupBy("site", "domain").agg(F.count_distinct("page_id").alias("pages"), F.min("url").alias("example")).where("pages >= 2")


# What consent notices say.
COOKIE = (
    "accept all cookies", "accept cookies", "accept all", "reject all cookies", "reject all", "decline all", "decline cookies", "allow all", "allow cookies", "cookie settings", "cookie preferences",
    "manage cookies", "manage preferences", "customize cookies", "necessary cookies", "we use cookies", "this site uses cookies", "this website uses cookies", "cookie policy", "cookie consent",
)
_CTA_TOKENS = r"(?is)<(?:nav|header)(?:[ \t\r\n][^>]*)?>|</(?:nav|header)[ \t\r\n]*>|<(?:button|a)(?:[ \t\r\n][^>]*)?>.*?</(?:button|a)[ \t\r\n]*>"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, ord, label, chrome, consent`` of buttons and anchors; chrome stands inside nav or header."""
    p = all_pages(spark, sf_dir, "links").select("page_id", html_rows.all_of(markup.without_hidden(F.col("html")), _CTA_TOKENS, 0).alias("tk")).dropDuplicates(["page_id"])
    rows = p.select("page_id", "tk", F.posexplode("tk").alias("ord", "t")).where(F.col("t").rlike("(?is)^<(?:button|a)[ \t\r\n>]"))
    before = F.slice("tk", 1, F.col("ord"))
    depth = F.size(F.filter(before, lambda t: t.rlike("(?is)^<(?:nav|header)[ \t\r\n>]"))) - F.size(F.filter(before, lambda t: t.rlike("(?is)^</(?:nav|header)[ \t\r\n>]")))
    label = markup.plain(F.col("t"))
    low = F.translate(F.lower(label), "‘’", "''")
    consent = F.lit(False)
    for c in COOKIE:
        consent = consent | low.contains(c)
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), label.alias("label"), (depth > 0).alias("chrome"), consent.alias("consent")).where("label <> ''")


_CALLS = f"""{anchors_sql("links")}, ck AS (SELECT page_id, regexp_extract_all({markup.sql_without_hidden("html")}, {lit(_CTA_TOKENS)}) AS tk FROM x), cr AS (SELECT page_id, tk, unnest(tk) AS t, unnest(range(len(tk))) AS ord FROM ck),
    cs AS (SELECT page_id, ord, {markup.sql_plain("t")} AS label, len(list_filter(tk[1:ord], lambda b: regexp_matches(b, '(?is)^<(?:nav|header)[ \\t\\r\\n>]'))) - len(list_filter(tk[1:ord], lambda b: regexp_matches(b, '(?is)^</(?:nav|header)[ \\t\\r\\n>]'))) > 0 AS chrome FROM cr WHERE regexp_matches(t, '(?is)^<(?:button|a)[ \\t\\r\\n>]')),
    calls AS (SELECT page_id, ord, label, chrome, {" OR ".join(f"contains(translate(lower(label), '‘’', ''''''), '{c}')" for c in COOKIE)} AS consent FROM cs WHERE label <> '')"""


@query("b14_calls", f"WITH {_CALLS} SELECT * FROM calls")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir)


@query("h09_dead_ends", f"WITH {_CALLS}, inl AS (SELECT DISTINCT page_id FROM an WHERE url IS NOT NULL AND {_UHOST} = host), cta AS (SELECT DISTINCT page_id FROM calls WHERE NOT chrome AND NOT consent) SELECT page_id FROM x WHERE page_id NOT IN (SELECT page_id FROM inl) AND page_id NOT IN (SELECT page_id FROM cta)")
def h09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with no link to their own site and no call to act outside the chrome."""
    p = all_pages(spark, sf_dir, "links").select("page_id").distinct()
    inside = anchors(spark, sf_dir, "links").where(F.col("url").isNotNull() & (page_host("url") == F.col("host"))).select("page_id")
    act = calls(spark, sf_dir).where("not chrome and not consent").select("page_id")
    return p.join(inside, "page_id", "left_anti").join(act, "page_id", "left_anti")


@query("h13_path_signals", f"""WITH {_CALLS}, fc AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<form[ >]')) AS forms, len(regexp_extract_all(html, {lit(r'''(?i)<input[^>]*type=["']?password''')})) AS passwords, regexp_matches(lower(html), 'guest[ ]+(?:checkout|order)|continue as a? ?guest') AS guest FROM x)
    SELECT page_id, forms, passwords, guest, (SELECT count(*) FROM calls WHERE calls.page_id = fc.page_id AND NOT consent) AS calls FROM fc""")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    p = all_pages(spark, sf_dir, "links").select(
        "page_id", F.regexp_count(h, F.lit("(?i)<form[ >]")).cast("long").alias("forms"), F.regexp_count(h, F.lit(r"""(?i)<input[^>]*type=["']?password""")).cast("long").alias("passwords"),
        F.lower(h).rlike("guest[ ]+(?:checkout|order)|continue as a? ?guest").alias("guest"),
    ).dropDuplicates(["page_id"])
    n = calls(spark, sf_dir).where("not consent").groupBy("page_id").agg(F.count("*").alias("calls"))
    return p.join(n, "page_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


_CHROME_OPEN, _CHROME_SHUT = r"(?is)<(?:nav|footer|header)(?:[ \t\r\n][^>]*)?>", r"(?is)</(?:nav|footer|header)[ \t\r\n]*>"
_A_OPEN = r"""(?is)<a[ \t\r\n][^>]*?href[ \t\r\n]*=[ \t\r\n]*["']([^"'>]*)["'][^>]*>"""


def anchor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, host, page_url, ord, href, at, total, words, chrome``: where in the visible text each anchor stands."""
    c = markup.without_hidden(F.col("html"))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[\u0001-\u0004]", ""), _CHROME_OPEN, "\u0002"), _CHROME_SHUT, "\u0003")
    c = F.regexp_replace(F.regexp_replace(c, _A_OPEN, "\u0001$1\u0004"), markup.BREAK, " ")
    c = F.regexp_replace(markup.without_tags(c), markup.SPACES, " ")
    p = all_pages(spark, sf_dir, "citations").select("page_id", "host", "page_url", F.split(c, "\u0001").alias("parts")).dropDuplicates(["page_id"])
    rows = p.select("page_id", "host", "page_url", F.posexplode("parts").alias("ord", "part"))
    text = F.regexp_replace("part", "^[^\u0004]*\u0004", "")
    rows = rows.withColumns({"text": F.when(F.col("ord") == 0, F.col("part")).otherwise(text), "href": F.trim(F.regexp_extract("part", "^([^\u0004]*)\u0004", 1))})
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    rows = rows.withColumns({"n": F.length(F.regexp_replace("text", "[\u0002\u0003]", "")), "d": count("\u0002") - count("\u0003"), "w": F.regexp_count("text", F.lit("[^ \u0002\u0003]+"))})
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a page bounds it
    whole = Window.partitionBy("page_id")
    rows = rows.withColumns({"at": F.sum("n").over(before), "depth": F.sum("d").over(before), "total": F.sum("n").over(whole), "words": F.sum("w").over(whole)})
    return rows.where("ord > 0").select("page_id", "host", "page_url", F.col("ord").cast("long").alias("ord"), "href", "at", "total", "words", (F.col("depth") > 0).alias("chrome"))


_C1 = f"""regexp_replace(regexp_replace(regexp_replace({markup.sql_without_hidden("html")}, '[' || chr(1) || '-' || chr(4) || ']', '', 'g'), {lit(_CHROME_OPEN)}, chr(2), 'g'), {lit(_CHROME_SHUT)}, chr(3), 'g')"""
_C2 = f"""regexp_replace(regexp_replace({_C1}, {lit(_A_OPEN)}, chr(1) || '\\1' || chr(4), 'g'), {lit(markup.BREAK)}, ' ', 'g')"""
_C3 = f"""regexp_replace(regexp_replace({_C2}, {lit(markup.TAG)}, '', 'g'), {lit(markup.SPACES)}, ' ', 'g')"""
_PLACES = f"""{all_pages_sql("citations")}, pt AS (SELECT page_id, host, page_url, string_split({_C3}, chr(1)) AS parts FROM x), pr AS (SELECT page_id, host, page_url, unnest(parts) AS part, unnest(range(len(parts))) AS ord FROM pt),
    px AS (SELECT *, CASE WHEN ord = 0 THEN part ELSE regexp_replace(part, '^[^' || chr(4) || ']*' || chr(4), '') END AS text, trim(regexp_extract(part, '^([^' || chr(4) || ']*)' || chr(4), 1)) AS href FROM pr),
    pn AS (SELECT *, len(replace(replace(text, chr(2), ''), chr(3), '')) AS n, (len(text) - len(replace(text, chr(2), ''))) - (len(text) - len(replace(text, chr(3), ''))) AS d, len(regexp_extract_all(text, '[^ ' || chr(2) || chr(3) || ']+')) AS w FROM px),
    pw AS (SELECT *, sum(n) OVER bef AS pos, sum(d) OVER bef AS depth, sum(n) OVER (PARTITION BY page_id) AS total, sum(w) OVER (PARTITION BY page_id) AS words FROM pn WINDOW bef AS (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    places AS (SELECT page_id, host, page_url, ord, href, CAST(pos AS BIGINT) AS pos, CAST(total AS BIGINT) AS total, CAST(words AS BIGINT) AS words, depth > 0 AS chrome FROM pw WHERE ord > 0)"""


@query("b11_anchor_places", f"WITH {_PLACES} SELECT page_id, ord, href, pos, total, chrome FROM places")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_places(spark, sf_dir).select("page_id", "ord", "href", F.col("at").alias("pos"), "total", "chrome")


_HHOST = SITE.replace("page_url", "href")


@query("g04_late_citations", f"WITH {_PLACES} SELECT page_id, any_value(words) AS words, count(*) AS citations, round(min(pos::DOUBLE / total), 6) AS first_at FROM places WHERE words >= 500 AND NOT chrome AND regexp_matches(href, '^(?i)https?://') AND {_HHOST} <> host GROUP BY page_id HAVING min(pos::DOUBLE / total) >= 0.8")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pages whose links to other hosts all stand in the last fifth, chrome left out."""
    x = anchor_places(spark, sf_dir).where(F.col("href").rlike("(?i)^https?://") & ~F.col("chrome") & (F.col("words") >= 500) & (page_host("href") != F.col("host")))
    g = x.groupBy("page_id").agg(F.first("words").alias("words"), F.count("*").alias("citations"), F.min(F.col("at").cast("double") / F.col("total")).alias("f"))
    return g.where("f >= 0.8").select("page_id", "words", "citations", F.round("f", 6).alias("first_at"))


@query(
    "i04_canonical_issues",
    f"""WITH {all_pages_sql("canonicals")}, cl AS (SELECT page_id, page_url, host, list_transform(list_filter(regexp_extract_all(html, {lit(r"(?is)<link[ \t\r\n][^>]*>")}), lambda t: lower(trim({sql_attr("t", "rel")})) = 'canonical'), lambda t: {sql_attr("t", "href")}) AS c FROM x),
    cd AS (SELECT *, len(list_distinct(c)) AS n, trim(c[1]) AS url FROM cl) SELECT page_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'conflicting' WHEN url = '' THEN 'empty' ELSE 'off domain' END AS issue FROM cd
    WHERE n <> 1 OR url = '' OR (regexp_matches(url, '^(?i)https?://') AND {_UHOST} <> host)""",
)
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.filter(html_rows.all_of(F.col("html"), r"(?is)<link[ \t\r\n][^>]*>", 0), lambda t: F.lower(F.trim(attr(t, "rel"))) == "canonical")
    c = all_pages(spark, sf_dir, "canonicals").select("page_id", "host", F.transform(links, lambda t: attr(t, "href")).alias("c")).dropDuplicates(["page_id"])
    n, url = F.size(F.array_distinct("c")), F.trim(F.get("c", F.lit(0)))
    off = url.rlike("(?i)^https?://") & (page_host(url) != F.col("host"))
    issue = F.when(n == 0, "missing").when(n > 1, "conflicting").when(url == "", "empty").when(off, "off domain")
    return c.select("page_id", issue.alias("issue")).where("issue is not null")


# ---- media, layout and numbers in scripts


_NO_ALT = f"trim({sql_attr('t', 'alt')}) = '' AND NOT (lower(trim({sql_attr('t', 'role')})) = 'presentation' OR lower(trim({sql_attr('t', 'aria-hidden')})) = 'true')"


@query("k07_missing_alt_text", f"WITH {all_pages_sql('media')}, {sql_found('im', html_rows.IMAGE)} SELECT page_id, count(*) AS images, count(*) FILTER ({_NO_ALT}) AS missing FROM im GROUP BY page_id HAVING count(*) FILTER ({_NO_ALT}) > 0")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    bad = (F.trim(attr(t, "alt")) == "") & ~((F.lower(F.trim(attr(t, "role"))) == "presentation") | (F.lower(F.trim(attr(t, "aria-hidden"))) == "true"))
    g = found(all_pages(spark, sf_dir, "media"), html_rows.IMAGE).groupBy("page_id").agg(F.count("*").alias("images"), F.count_if(bad).alias("missing"))
    return g.where("missing > 0")


_MEDIA = r"(?is)<(?:video|audio)(?:[ \t\r\n][^>]*)?>.*?</(?:video|audio)[ \t\r\n]*>"


@query("k07_missing_tracks", f"WITH {all_pages_sql('media')}, {sql_found('md', _MEDIA)} SELECT page_id, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS kind, count(*) AS media, count(*) FILTER (NOT regexp_matches(t, '(?i)<track[ >]')) AS without FROM md GROUP BY ALL")
def k07_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    g = found(all_pages(spark, sf_dir, "media"), _MEDIA).groupBy("page_id", F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1)).alias("kind"))
    return g.agg(F.count("*").alias("media"), F.count_if(~t.rlike("(?i)<track[ >]")).alias("without"))


_STYLED = r"""(?is)<[a-z][a-z0-9]*[ \t\r\n][^>]*style[ \t\r\n]*=[^>]*>"""
#: The same for Java in two steps, the start tags and those with a style: of several ``<`` before one ``>`` the first has the
#: style if any has, so the others need not be tried, each up to the ``>``.
_START_TAG = r"(?is)<[a-z][a-z0-9]*[ \t\r\n][^>]*+(?:>|\z)"
_STYLED_TAG = _STYLED.replace("(?is)", "(?is)^")
_WIDTH = r"(?i)(?:^|;)[ \t]*width[ \t]*:[ \t]*([0-9]+(?:\.[0-9]+)?)px"
_FITS = r"(?i)max-width[ \t]*:[ \t]*100%"


@query("h04_fixed_widths", f"WITH {all_pages_sql('media')}, {sql_found('st', _STYLED)}, w AS (SELECT page_id, TRY_CAST(nullif(regexp_extract({sql_attr('t', 'style')}, {lit(_WIDTH)}, 1), '') AS DOUBLE) AS px, regexp_matches({sql_attr('t', 'style')}, {lit(_FITS)}) AS fits FROM st) SELECT page_id, count(*) AS boxes, max(px) AS widest FROM w WHERE px > 480 AND NOT fits GROUP BY page_id")
def h04(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = attr(F.col("t"), "style")
    tags = F.filter(html_rows.all_of(F.col("html"), _START_TAG, 0), lambda t: t.rlike(_STYLED_TAG))
    st = all_pages(spark, sf_dir, "media").select("page_id", F.posexplode(tags).alias("ord", "t")).dropDuplicates(["page_id", "ord"])
    w = st.select("page_id", F.regexp_extract(style, _WIDTH, 1).try_cast("double").alias("px"), style.rlike(_FITS).alias("fits"))
    return w.where("px > 480 and not fits").groupBy("page_id").agg(F.count("*").alias("boxes"), F.max("px").alias("widest"))


_UNSIZED = f"NOT ({sql_has('t', 'width')} AND {sql_has('t', 'height')}) AND NOT contains(lower({sql_attr('t', 'style')}), 'aspect-ratio')"


@query("h06_unsized_images", f"WITH {all_pages_sql('media')}, {sql_found('im', html_rows.IMAGE)} SELECT page_id, count(*) AS unsized FROM im WHERE {_UNSIZED} GROUP BY page_id HAVING count(*) >= 3")
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    bad = ~(has(t, "width") & has(t, "height")) & ~F.lower(attr(t, "style")).contains("aspect-ratio")
    return found(all_pages(spark, sf_dir, "media"), html_rows.IMAGE).where(bad).groupBy("page_id").agg(F.count("*").alias("unsized")).where("unsized >= 3")


_SCRIPT = r"(?is)<script(?:[ \t\r\n][^>]*)?>(.*?)</script[ \t\r\n]*>"
# Names before numbers that track a visit.
_TRACKING = r"(?i)client[_-]?id|_ga[^a-z0-9]|datalayer|(?:order|transaction|session|event|correlation)[_-]?id|gclid|fbclid|utm_"
_NUMBER_AND_BEFORE = rf"(?s)(.{{0,30}}?)({signals.PHONE})"


@query(
    "k08_phone_only_in_script",
    f"""WITH {all_pages_sql("media")}, {sql_found("sc", _SCRIPT, group=1)}, ph AS (SELECT page_id, unnest(regexp_extract_all(t, {lit(_NUMBER_AND_BEFORE)}, 1)) AS before, unnest(regexp_extract_all(t, {lit(_NUMBER_AND_BEFORE)}, 2)) AS raw FROM sc),
    num AS (SELECT DISTINCT page_id, '+' || regexp_replace(raw, '[^0-9]', '', 'g') AS phone FROM ph WHERE NOT regexp_matches(before, {lit(_TRACKING)}) AND len(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN 7 AND 15),
    seen AS (SELECT page_id, list_transform(regexp_extract_all({markup.sql_visible_text("html")}, {lit(signals.PHONE)}), lambda p: '+' || regexp_replace(p, '[^0-9]', '', 'g')) AS vis FROM x)
    SELECT page_id, phone FROM num JOIN seen USING (page_id) WHERE NOT list_contains(vis, phone)""",
)
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in scripts that the visible text does not show, unless what stands before them tracks visits."""
    p = all_pages(spark, sf_dir, "media")
    s = found(p, _SCRIPT, group=1)
    two = F.arrays_zip(html_rows.all_of(F.col("t"), _NUMBER_AND_BEFORE, 1).alias("before"), html_rows.all_of(F.col("t"), _NUMBER_AND_BEFORE, 2).alias("raw"))
    n = s.select("page_id", F.explode(two).alias("x")).where(~F.col("x.before").rlike(_TRACKING)).select("page_id", F.concat(F.lit("+"), F.regexp_replace("x.raw", "[^0-9]", "")).alias("phone"))
    n = n.where(F.length("phone").between(8, 16)).distinct()
    seen = p.where(F.col("html").rlike(signals.PHONE)).select("page_id", signals.phones(markup.visible_text(F.col("html"))).alias("vis")).dropDuplicates(["page_id"])
    return n.join(seen, "page_id").where(~F.array_contains("vis", F.col("phone"))).select("page_id", "phone")


def concealed(pages_: DataFrame) -> DataFrame:
    """``page_id, path, technique, kind, text`` of hidden texts that address a reading machine.

    A table function over the element tree: outermost hidden elements (by
    attribute, inline style or style rule), meta contents, comments and strings
    of structured data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set()
                for path, technique, text in dom.hidden_texts(h or ""):
                    kind = dom.addressed(text)
                    if kind and (path, technique, text) not in seen:
                        seen.add((path, technique, text))
                        rows.append((i, path, technique, kind, text))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["page_id", "path", "technique", "kind", "text"])

    return pages_.select("page_id", "html").mapInArrow(run, "page_id long, path string, technique string, kind string, text string").distinct()


@query("k10_concealed_instructions")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concealed(all_pages(spark, sf_dir, "hidden"))


# ---- hydration state

_STATE = r"""(?is)<script[ \t\r\n][^>]*(?:type[ \t\r\n]*=[ \t\r\n]*["']application/json["']|id[ \t\r\n]*=[ \t\r\n]*["']__(?:NEXT|NUXT)_DATA__["'])[^>]*>(.*?)</script[ \t\r\n]*>"""


def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, source, ord, body`` of state blocks: typed scripts, and literals assigned to the names of frameworks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, scripts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in scripts or []:
                    rows += [(i, name, body) for name, body in dom.assigned_literals(s)]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["page_id", "source", "body"])

    p = all_pages(spark, sf_dir, "hydration")
    typed = found(p, _STATE, group=1).select("page_id", F.lit("script").alias("source"), F.col("t").alias("body"))
    scripts = p.where(F.col("html").rlike(r"window\.__(?:NUXT__|remixContext)")).select("page_id", html_rows.all_of(F.col("html"), _SCRIPT, 1).alias("s"))
    return typed.unionByName(scripts.dropDuplicates(["page_id"]).mapInArrow(run, "page_id long, source string, body string"))


_ASSIGNED = r"(?s)(window\.__(?:NUXT__|remixContext))[ \t\r\n]*=[ \t\r\n]*([{\[].*[}\]])[ \t\r\n;]*$"
_STATES = f"""{all_pages_sql("hydration")}, {sql_found("ty", _STATE, group=1)}, {sql_found("sc", _SCRIPT, group=1)}, hy AS (SELECT page_id, 'script' AS source, t AS body FROM ty
    UNION ALL SELECT page_id, regexp_extract(t, {lit(_ASSIGNED)}, 1), regexp_extract(t, {lit(_ASSIGNED)}, 2) FROM sc WHERE regexp_matches(t, {lit(_ASSIGNED)}))"""


@query("b17_hydration_blocks", f"WITH {_STATES} SELECT page_id, source, body FROM hy")
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydration(spark, sf_dir)


@query(
    "k01_hydration_not_in_text",
    f"""WITH {_STATES}, ok AS (SELECT page_id, CAST(body AS JSON) AS j FROM hy WHERE json_valid(body)), lv AS (SELECT page_id, t.value AS v FROM ok, json_tree(ok.j) AS t WHERE t.type = 'VARCHAR'),
    nt AS (SELECT DISTINCT page_id, {markup.sql_plain("json_extract_string(v, '$')")} AS text FROM lv), tx AS (SELECT page_id, regexp_replace({markup.sql_visible_text("html")}, '[ \\n]+', ' ', 'g') AS seen FROM x)
    SELECT page_id, text FROM nt JOIN tx USING (page_id) WHERE len(text) >= 20 AND len(string_split(text, ' ')) >= 3 AND NOT regexp_matches(lower(text), '^(?:https?://|/)') AND NOT contains(seen, text)""",
)
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that only the state of a script holds."""
    leaves = json_leaves(hydration(spark, sf_dir)).select("page_id", markup.plain(F.col("leaf")).alias("text"))
    long = leaves.where((F.length("text") >= 20) & (F.size(F.split("text", " ")) >= 3) & ~F.lower("text").rlike("^(?:https?://|/)")).distinct()
    seen = all_pages(spark, sf_dir, "hydration").join(long.select("page_id").distinct(), "page_id", "left_semi")
    seen = seen.select("page_id", F.regexp_replace(markup.visible_text(F.col("html")), r"[ \n]+", " ").alias("seen")).dropDuplicates(["page_id"])
    return long.join(seen, "page_id").where(~F.contains("seen", "text")).select("page_id", "text")


def json_leaves(rows: DataFrame) -> DataFrame:
    """``page_id, leaf``: every string value in the JSON ``body`` of each row, at any depth; broken JSON gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, s) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in dom.string_leaves(b)]
            ids, leaves = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves, pa.string())], names=["page_id", "leaf"])

    return rows.select("page_id", "body").mapInArrow(run, "page_id long, leaf string")


_LD_ALL = f"{all_pages_sql('graphs', 'hydration')}, {sql_found('ldb', html_rows.JSON_LD, group=1)}"


@query("d14_json_leaves", f"WITH {_LD_ALL}, ok AS (SELECT page_id, CAST(t AS JSON) AS j FROM ldb WHERE json_valid(t)) SELECT page_id, json_extract_string(t.value, '$') AS leaf, count(*) AS times FROM ok, json_tree(ok.j) AS t WHERE t.type = 'VARCHAR' GROUP BY ALL")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = found(all_pages(spark, sf_dir, "graphs", "hydration"), html_rows.JSON_LD, group=1).withColumnRenamed("t", "body")
    return json_leaves(b).groupBy("page_id", "leaf").agg(F.count("*").alias("times"))


# ---- dates

_CLAIM = r"(?i)(?:^|[^A-Za-z0-9])(?:last[ \n]+updated|last[ \n]+modified|updated|as[ \n]+of)[ \n]*[:-]?[ \n]*([A-Za-z]+ [0-9]{1,2},? [0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"
_MODIFIED = r'"dateModified"[ \t\r\n]*:[ \t\r\n]*"([^"]+)"'
_DATE = r"""CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(left(v, 10) AS DATE) WHEN regexp_matches(v, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(try_strptime(v, '%m/%d/%Y') AS DATE)
    WHEN regexp_matches(v, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$') THEN CAST(try_strptime(v, '%m/%d/%y') AS DATE) WHEN regexp_matches(v, '^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$') THEN CAST(try_strptime(v, '%B %d %Y') AS DATE) WHEN regexp_matches(v, '^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$') THEN CAST(try_strptime(v, '%b %d %Y') AS DATE) END"""


@query(
    "f07_freshness_contradiction",
    f"""WITH {all_pages_sql("freshness")}, y AS (SELECT page_id, fetched_at, try_strptime(substr(list_filter(map_entries(headers), lambda e: lower(e.key) = 'last-modified')[1].value, 6, 20), '%d %b %Y %H:%M:%S') AS modified,
      trim(replace(coalesce(nullif(regexp_extract({markup.sql_visible_text("html")}, {lit(_CLAIM)}, 1), ''), nullif(regexp_extract(html, {lit(_MODIFIED)}, 1), '')), ',', '')) AS v FROM x), z AS (SELECT page_id, v AS claimed, date_diff('day', CAST(modified AS DATE), {_DATE}) AS newer_days, fetched_at, modified FROM y WHERE modified IS NOT NULL)
    SELECT page_id, claimed, newer_days FROM z WHERE newer_days >= 30 AND (fetched_at IS NULL OR abs(date_diff('second', modified, fetched_at)) >= 3600)""",
)
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that claim a date 30 days and more after what the server says; silent where the server's date is the fetch's."""
    entries = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "last-modified")
    modified = F.try_to_timestamp(F.substring(F.get(entries, F.lit(0))["value"], 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    p = all_pages(spark, sf_dir, "freshness").withColumn("modified", modified).where("modified is not null")
    said = F.coalesce(F.nullif(F.regexp_extract(markup.visible_text(F.col("html")), _CLAIM, 1), F.lit("")), F.nullif(F.regexp_extract("html", _MODIFIED, 1), F.lit("")))
    p = p.select("page_id", "fetched_at", "modified", F.trim(F.replace(said, F.lit(","), F.lit(""))).alias("claimed"))
    v = F.col("claimed")
    iso = v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    p = p.select("page_id", "fetched_at", "modified", "claimed", F.when(iso, F.left(v, F.lit(10))).otherwise(v).alias("d")).dropDuplicates(["page_id"])
    z = p.withColumn("newer_days", F.datediff(signals.parse_claimed_date(F.col("d")), F.to_date("modified")).cast("long"))
    apart = F.col("fetched_at").isNull() | (F.abs(F.unix_timestamp("fetched_at") - F.unix_timestamp("modified")) >= 3600)
    return z.where((F.col("newer_days") >= 30) & apart).select("page_id", "claimed", "newer_days")


# ---- pages to add to a sample

# Pages that a sample should hold.
_FORCED = ("/", "/contact", "/checkout", "/search", "/pricing")


@query(
    "a14_forced_pages",
    rf"""WITH {all_pages_sql("graphs", "forms")}, {A}, live AS (SELECT DISTINCT host, CASE WHEN pp = '' THEN '/' ELSE pp END AS path FROM (SELECT host, regexp_replace(regexp_extract(trim(page_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS pp FROM x)),
    known AS (SELECT DISTINCT {_UHOST} AS host, CASE WHEN up = '' THEN '/' ELSE up END AS path FROM (SELECT url, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS up FROM (SELECT trim(unnest(regexp_extract_all(text, {lit(r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>")}, 1))) AS url FROM a WHERE kind = 'sitemap' AND status = 'present')))
    SELECT DISTINCT host, path FROM live WHERE path IN ({", ".join(map(lit, _FORCED))}) AND (host, path) NOT IN (SELECT host, path FROM known)""",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard pages that answer and that no sitemap lists."""
    path = lambda c: F.coalesce(F.nullif(F.regexp_replace(url_path(c), "/+$", ""), F.lit("")), F.lit("/"))
    live = all_pages(spark, sf_dir, "graphs", "forms").select("host", path("page_url").alias("path"))
    known = perimeter.sitemap_urls(artifacts(spark, sf_dir, "sitemap")).select(page_host("url").alias("host"), path("url").alias("path"))
    return live.where(F.col("path").isin(*_FORCED)).distinct().join(known.distinct(), ["host", "path"], "left_anti")
