"""Queries over html and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions.urls import fork_key, is_about_path, page_host, registrable_domain, template_key, url_path
from folioforge.operators import html_rows
from folioforge.plans.shared import P, Query, blocks, pages
from folioforge.sources import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LEN = "octet_length(encode({0}, 'utf-8'))"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with html as they were delivered, some twice: what is made of them
    is made once by its keys, which are far smaller than html to shuffle."""
    df = table(spark, sf_dir, "pages_in").select("page_id", "page_url", "html").where("html is not null")
    return df.withColumn("host", page_host("page_url"))


H = f"{P}, h AS (SELECT * FROM p WHERE html IS NOT NULL)"


@query("b01_visible_text", f"WITH {H} SELECT page_id, {markup.sql_visible_text('html')} AS text FROM h")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages(spark, sf_dir).select("page_id", markup.visible_text(F.col("html")).alias("text")).dropDuplicates(["page_id"])


@query("b02_visible_text_raw", f"WITH {H} SELECT page_id, {markup.sql_visible_text('html', raw=True)} AS text FROM h")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages(spark, sf_dir).select("page_id", markup.visible_text(F.col("html"), raw=True).alias("text")).dropDuplicates(["page_id"])


@query("b04_blocks", "SELECT DISTINCT page_id, block_ord, text FROM blocks_in")
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.blocks(html_pages(spark, sf_dir))


@query(
    "b04_block_offsets",
    """WITH b AS (SELECT DISTINCT ON (page_id, block_ord) * FROM blocks_in)
    SELECT page_id, block_ord, start_char, end_char FROM b""",
)
def b04_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    df = blocks(spark, sf_dir, "text").withColumn("n", F.length("text"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)).cast("int")
    return df.select("page_id", "block_ord", start.alias("start_char"), (start + F.col("n")).cast("int").alias("end_char"))


_HEAD = f"""{H}, x AS (SELECT page_id, {markup.sql_without_hidden('html')} AS c FROM h),
y AS (SELECT page_id, regexp_extract_all(c, {markup.sql_string(html_rows.HEADING)}, 1) AS l, regexp_extract_all(c, {markup.sql_string(html_rows.HEADING)}, 2) AS t FROM x),
z AS (SELECT page_id, l, t, unnest(range(1, len(l) + 1)) AS i FROM y),
heads AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, CAST(l[i] AS INTEGER) AS level, {markup.sql_plain('t[i]')} AS text FROM z)"""


@query("b05_headings", f"WITH {_HEAD} SELECT * FROM heads")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.headings(html_pages(spark, sf_dir))


@query("b06_first_h1", f"WITH {_HEAD} SELECT page_id, min_by(text, ord) AS h1 FROM heads WHERE level = 1 GROUP BY page_id")
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.first_h1(html_pages(spark, sf_dir))


@query(
    "b07_paragraphs",
    f"""WITH {H}, x AS (SELECT page_id, regexp_extract_all({markup.sql_without_hidden('html')}, {markup.sql_string(html_rows.PARAGRAPH)}, 1) AS l FROM h),
    z AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM x),
    q AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, {markup.sql_plain('l[i]')} AS text FROM z) SELECT * FROM q WHERE text <> ''""",
)
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.paragraphs(html_pages(spark, sf_dir))


_LINKS = f"""{H}, x AS (SELECT page_id, page_url, {markup.sql_without_hidden('html')} AS c FROM h),
y AS (SELECT page_id, page_url, regexp_extract_all(c, {markup.sql_string(html_rows.ANCHOR)}, 1) AS l, regexp_extract_all(c, {markup.sql_string(html_rows.ANCHOR)}, 2) AS t FROM x),
z AS (SELECT page_id, page_url, l, t, unnest(range(1, len(l) + 1)) AS i FROM y),
q AS (SELECT page_id, page_url, CAST(i - 1 AS INTEGER) AS ord, l[i] AS href, trim(l[i]) AS r, regexp_replace(trim(l[i]), '#.*$', '') AS clean, {markup.sql_plain('t[i]')} AS anchor,
  regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
  regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://.*/)', 1) AS f0 FROM z),
links AS (SELECT page_id, page_url, ord, href, anchor, CASE WHEN regexp_matches(r, '^#') OR r = '' THEN NULL WHEN regexp_matches(r, '^(?i)https?://') THEN clean
  WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(r, '//') THEN scheme || clean WHEN starts_with(r, '/') THEN origin || clean
  ELSE CASE WHEN len(f0) <= len(origin) THEN origin || '/' ELSE f0 END || clean END AS url FROM q)"""


@query("b10_links", f"WITH {_LINKS} SELECT page_id, page_url, ord, href, url, anchor FROM links WHERE url IS NOT NULL")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.links(html_pages(spark, sf_dir))


_LD = f"""{H}, x AS (SELECT page_id, regexp_extract_all(html, {markup.sql_string(html_rows.JSON_LD)}, 1) AS l FROM h),
ld AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, l[i] AS body FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM x))"""


@query("b16_json_ld", f"WITH {_LD} SELECT * FROM ld")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.json_ld(html_pages(spark, sf_dir))


@query("b18_title", f"WITH {H} SELECT page_id, {markup.sql_plain('regexp_extract(html, ' + markup.sql_string(html_rows.TITLE) + ', 1)')} AS title FROM h")
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages(spark, sf_dir).select("page_id", html_rows.title(F.col("html")).alias("title")).dropDuplicates(["page_id"])


@query(
    "b23_definition_blocks",
    rf"""WITH {H} SELECT page_id, len(regexp_extract_all(html, '<dt[ >]')) AS terms, len(regexp_extract_all(html, '<dd[ >]')) AS definitions FROM h
    WHERE regexp_matches(html, '<dt[ >]') AND regexp_matches(html, '<dd[ >]')""",
)
def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_pages(spark, sf_dir).where(F.col("html").rlike("<dt[ >]") & F.col("html").rlike("<dd[ >]"))
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return df.select("page_id", n("<dt[ >]").alias("terms"), n("<dd[ >]").alias("definitions")).dropDuplicates(["page_id"])


@query(
    "b24_head_directives",
    rf"""WITH {H}, x AS (SELECT page_id, split_part(html, '</head>', 1) AS head, html FROM h)
    SELECT page_id, lower(regexp_extract(head, '(?i)<meta[^>]*charset="?([A-Za-z0-9-]+)', 1)) AS charset,
    lower(regexp_extract(html, '(?i)<html[^>]*lang="?''?([A-Za-z-]+)', 1)) AS lang,
    regexp_matches(head, '(?i)<meta[^>]*name="?robots') AS has_robots FROM x""",
)
def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_pages(spark, sf_dir).withColumn("head", F.split_part("html", F.lit("</head>"), F.lit(1)))
    return df.select(
        "page_id",
        F.lower(F.regexp_extract("head", r'(?i)<meta[^>]*charset="?([A-Za-z0-9-]+)', 1)).alias("charset"),
        F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*lang="?'?([A-Za-z-]+)""", 1)).alias("lang"),
        F.col("head").rlike('(?i)<meta[^>]*name="?robots').alias("has_robots"),
    ).dropDuplicates(["page_id"])


@query(
    "b28_lines",
    f"""WITH {H}, x AS (SELECT page_id, string_split({markup.sql_visible_text('html')}, chr(10)) AS l FROM h),
    z AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM x) SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM z""",
)
def b28(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(markup.visible_text(F.col("html")), "\n")
    return html_pages(spark, sf_dir).select("page_id", F.posexplode(lines).alias("line_no", "line")).dropDuplicates(["page_id", "line_no"])


# ---- headers and addresses


@query(
    "a10_page_content_type",
    rf"""WITH {P}, x AS (SELECT page_id, status, list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type') AS l FROM p),
    c AS (SELECT page_id, status, lower(coalesce(l[1].value, '')) AS ct FROM x)
    SELECT page_id, status, ct AS content_type, (NOT contains(ct, 'xml') AND (contains(ct, 'html') OR contains(ct, 'text'))) AS is_page FROM c""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "content-type")
    ct = F.lower(F.coalesce(F.get(entries, F.lit(0))["value"], F.lit("")))
    df = pages(spark, sf_dir, "status", "headers").withColumn("ct", ct)
    is_page = ~F.col("ct").contains("xml") & (F.col("ct").contains("html") | F.col("ct").contains("text"))
    return df.select("page_id", "status", F.col("ct").alias("content_type"), is_page.alias("is_page"))


@query(
    "a16_headers",
    f"WITH {P}, x AS (SELECT page_id, unnest(map_entries(headers)) AS e FROM p) SELECT page_id, lower(e.key) AS name, e.value AS value FROM x",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir, "headers").select("page_id", F.explode(F.map_entries("headers")).alias("e"))
    return rows.select("page_id", F.lower("e.key").alias("name"), F.col("e.value").alias("value"))


@query(
    "a03_ordered_scan",
    f"""WITH {P} SELECT host, page_id, page_ord, CAST(row_number() OVER (PARTITION BY host ORDER BY page_ord, page_id) AS BIGINT) AS place
    FROM p WHERE status = 'present'""",
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = pages(spark, sf_dir, "page_ord", "status").where("status = 'present'")
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_ord", "page_id")).cast("bigint")
    return df.select("host", "page_id", "page_ord", place.alias("place"))


_PATH = r"coalesce(nullif(regexp_extract(trim(page_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ''), '/')"
_KEY = f"""'/' || array_to_string(list_transform(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$')
  OR regexp_matches(s, '^[0-9a-fA-F]{{8}}-(?:[0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$') OR len(s) >= 24 OR (contains(s, '-') AND regexp_matches(s, '[0-9]')) THEN '*' ELSE lower(s) END), '/')"""


@query("d01_template_key", f"WITH {P} SELECT host, {_KEY} AS template, count(*) AS pages FROM p GROUP BY 1, 2")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("template", template_key(url_path("page_url")))
    return df.groupBy("host", "template").agg(F.count("*").alias("pages"))


@query(
    "d03_registrable_domain",
    rf"""WITH {P} SELECT CASE WHEN regexp_matches(host, '^[0-9.]+$|^\[') THEN host ELSE coalesce(nullif(regexp_extract(host, '([^.]+\.[^.]+)\.?$', 1), ''), host) END AS domain,
    count(*) AS pages, count(DISTINCT host) AS hosts FROM p GROUP BY 1""",
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("domain", registrable_domain(F.col("host")))
    return df.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


_FORK = f"host || regexp_replace({_PATH}, '/+$', '')"


@query(
    "i05_address_forks",
    f"""WITH {P}, k AS (SELECT {_FORK} AS key, page_url FROM p)
    SELECT key, count(DISTINCT page_url) AS spellings, min(page_url) AS first_url, max(page_url) AS last_url FROM k GROUP BY key HAVING count(DISTINCT page_url) >= 2""",
)
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("key", fork_key(F.col("page_url")))
    g = df.groupBy("key").agg(F.countDistinct("page_url").alias("spellings"), F.min("page_url").alias("first_url"), F.max("page_url").alias("last_url"))
    return g.where("spellings >= 2")


_SEG = r"regexp_replace(regexp_replace(lower(s), '^.*:', ''), '\.(?:html?|php|aspx?|jsp)$', '')"
_ABOUT = f"len(list_filter(string_split({{}}, '/'), lambda s: {_SEG} IN ('about', 'about-us', 'our-story', 'company', 'our-team', 'who-we-are', 'meet-the-team', 'team'))) > 0"
_UPATH = _PATH.replace("page_url", "url")


@query(
    "g01_no_about_link",
    f"""WITH {_LINKS}, ok AS (SELECT DISTINCT page_id FROM links WHERE url IS NOT NULL AND {_ABOUT.format(_UPATH)})
    SELECT host, page_id FROM h WHERE page_id NOT IN (SELECT page_id FROM ok)""",
)
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = html_pages(spark, sf_dir)
    about = html_rows.links(own).where(is_about_path(url_path("url"))).select("page_id").distinct()
    return own.select("host", "page_id").join(about, "page_id", "left_anti").select("host", "page_id").dropDuplicates(["page_id"])


_UHOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '^(?:www\.|m\.)', '')"


@query(
    "d05_link_kinds",
    f"""WITH {_LINKS} SELECT h.host AS host, count(*) AS links, count(*) FILTER ({_UHOST} = h.host) AS internal, count(*) FILTER ({_UHOST} <> h.host) AS external
    FROM links JOIN h USING (page_id) WHERE url IS NOT NULL GROUP BY h.host""",
)
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_rows.links(html_pages(spark, sf_dir)).select(page_host("page_url").alias("host"), page_host("url").alias("to"))
    inside = F.col("host") == F.col("to")
    return rows.groupBy("host").agg(F.count("*").alias("links"), F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"))
