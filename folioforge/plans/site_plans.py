"""Queries over whole sites: page structure, samples, graphs, clusters and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions.urls import fork_key, is_about_path, template_key, url_path
from folioforge.operators import html_rows, report, sampling
from folioforge.operators.graph import connected_components, degree, pagerank
from folioforge.plans.html_plans import _FORK, _HEAD, _KEY, _LINKS, _PATH, H, _ABOUT, _UPATH, html_pages
from folioforge.plans.shared import B, P, Query, blocks, pages
from folioforge.sources import table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ---- page structure


@query(
    "h03_viewport",
    rf"""WITH {H}, x AS (SELECT host, CASE WHEN NOT regexp_matches(html, '(?i)<meta[^>]*name="?viewport') THEN 'missing' WHEN NOT regexp_matches(html, '(?i)width *= *device-width') THEN 'not responsive' ELSE 'fine' END AS state FROM h)
    SELECT host, state, count(*) AS pages FROM x GROUP BY host, state""",
)
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    state = F.when(~html.rlike('(?i)<meta[^>]*name="?viewport'), "missing").when(~html.rlike("(?i)width *= *device-width"), "not responsive").otherwise("fine")
    df = html_pages(spark, sf_dir).select("page_id", "host", state.alias("state")).dropDuplicates(["page_id"])
    return df.groupBy("host", "state").agg(F.count("*").alias("pages"))


@query(
    "h05_head_resources",
    r"""WITH {0}, x AS (SELECT page_id, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head FROM h)
    SELECT page_id, CAST(len(list_filter(regexp_extract_all(head, '(?i)<script[^>]*>'), lambda t: contains(lower(t), 'src=') AND NOT regexp_matches(lower(t), 'async|defer'))) AS INTEGER) AS scripts,
    CAST(len(regexp_extract_all(head, '(?i)<link[^>]*rel="?stylesheet')) AS INTEGER) AS sheets, CAST(len(regexp_extract_all(head, '(?i)<style')) AS INTEGER) AS inline_styles FROM x""".replace("{0}", H),
)
def h05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_pages(spark, sf_dir).withColumn("head", F.regexp_extract("html", "(?is)<head[^>]*>(.*?)</head>", 1))
    sync = F.filter(F.regexp_extract_all("head", F.lit("(?i)<script[^>]*>"), F.lit(0)), lambda t: F.lower(t).contains("src=") & ~F.lower(t).rlike("async|defer"))
    n = lambda p: F.regexp_count("head", F.lit(p))
    return df.select("page_id", F.size(sync).alias("scripts"), n('(?i)<link[^>]*rel="?stylesheet').alias("sheets"), n("(?i)<style").alias("inline_styles")).dropDuplicates(["page_id"])


@query("h07_payload", f"WITH {H} SELECT host, max(strlen(html)) AS heaviest, CAST(sum(strlen(html)) AS BIGINT) AS bytes, count(*) FILTER (strlen(html) >= 300000) AS heavy FROM h GROUP BY host")
def h07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    df = html_pages(spark, sf_dir).select("page_id", "host", F.octet_length("html").cast("bigint").alias("n")).dropDuplicates(["page_id"])
    return df.groupBy("host").agg(F.max(n).alias("heaviest"), F.sum(n).alias("bytes"), F.count_if(n >= 300_000).alias("heavy"))


@query(
    "k05_semantic_boundary",
    f"""WITH {H}, {B}, w AS (SELECT page_id, sum(word_count) AS words FROM b GROUP BY page_id)
    SELECT page_id, CAST(words AS BIGINT) AS words FROM h JOIN w USING (page_id) WHERE words >= 150 AND NOT regexp_matches(html, '(?i)<(?:main|article)[ >]')""",
)
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = blocks(spark, sf_dir, "word_count").groupBy("page_id").agg(F.sum("word_count").alias("words")).where("words >= 150")
    bare = html_pages(spark, sf_dir).where(~F.col("html").rlike("(?i)<(?:main|article)[ >]")).select("page_id").distinct()
    return bare.join(w, "page_id")


_MAIN = r"(?is)<(?:main|article)(?:[ ][^>]*)?>(.*?)</(?:main|article)>"


@query(
    "k06_content_ratio",
    rf"""WITH {H}, x AS (SELECT page_id, {markup.sql_plain('regexp_extract(' + markup.sql_without_hidden('html') + ", '" + _MAIN + "', 1)")} AS m, {markup.sql_visible_text('html')} AS t FROM h WHERE regexp_matches(html, '{_MAIN}'))
    SELECT page_id, round(len(m)::DOUBLE / len(t), 6) AS ratio FROM x WHERE len(t) > 0""",
)
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_pages(spark, sf_dir).where(F.col("html").rlike(_MAIN))
    m = F.length(markup.plain(F.regexp_extract(markup.without_hidden(F.col("html")), _MAIN, 1)))
    t = F.length(markup.visible_text(F.col("html")))
    df = df.select("page_id", m.alias("m"), t.alias("t")).where("t > 0").dropDuplicates(["page_id"])
    return df.select("page_id", F.round(F.col("m").cast("double") / F.col("t"), 6).alias("ratio"))


@query("b21_main_text", rf"WITH {H}, x AS (SELECT page_id, {markup.sql_plain('regexp_extract(' + markup.sql_without_hidden('html') + ", '" + _MAIN + "', 1)")} AS text FROM h) SELECT * FROM x WHERE text <> ''")
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markup.plain(F.regexp_extract(markup.without_hidden(F.col("html")), _MAIN, 1))
    return html_pages(spark, sf_dir).select("page_id", m.alias("text")).where("text <> ''").dropDuplicates(["page_id"])


@query("k02_scripts", rf"""WITH {H} SELECT page_id, len(regexp_extract_all(html, '(?i)<script')) AS scripts, len(regexp_extract_all(html, '(?i)<noscript')) AS notices, contains(html, 'self.__next_f.push(') AS hydrated FROM h""")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return html_pages(spark, sf_dir).select("page_id", n("(?i)<script").alias("scripts"), n("(?i)<noscript").alias("notices"), F.contains("html", F.lit("self.__next_f.push(")).alias("hydrated")).dropDuplicates(["page_id"])


@query("j05_skipped_levels", f"WITH {_HEAD}, q AS (SELECT page_id, ord, level, lag(level) OVER (PARTITION BY page_id ORDER BY ord) AS before FROM heads) SELECT page_id, ord, level, before FROM q WHERE level > before + 1")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("ord"))
    return html_rows.headings(html_pages(spark, sf_dir)).withColumn("before", before).where("level > before + 1").select("page_id", "ord", "level", "before")


@query(
    "j03_no_structure",
    f"""WITH {_HEAD}, {B}, w AS (SELECT page_id, sum(word_count) AS words FROM b GROUP BY page_id)
    SELECT page_id, CAST(words AS BIGINT) AS words FROM h JOIN w USING (page_id) WHERE words >= 300 AND page_id NOT IN (SELECT page_id FROM heads WHERE level = 2) AND NOT regexp_matches(html, '<d[td][ >]')""",
)
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = html_pages(spark, sf_dir)
    w = blocks(spark, sf_dir, "word_count").groupBy("page_id").agg(F.sum("word_count").alias("words")).where("words >= 300")
    second = html_rows.headings(own).where("level = 2").select("page_id").distinct()
    return own.where(~F.col("html").rlike("<d[td][ >]")).select("page_id").distinct().join(second, "page_id", "left_anti").join(w, "page_id")


@query("j10_intent_signals", f"WITH {_HEAD} SELECT page_id, min_by(text, ord) AS first_heading, count(*) AS headings, count(*) FILTER (ends_with(text, '?')) AS questions FROM heads GROUP BY page_id")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = html_rows.headings(html_pages(spark, sf_dir)).groupBy("page_id")
    return g.agg(F.min_by("text", "ord").alias("first_heading"), F.count("*").alias("headings"), F.count_if(F.col("text").endswith("?")).alias("questions"))


@query("j04_empty_headings", f"WITH {_HEAD} SELECT count(*) AS headings, count(*) FILTER (text = '') AS empty FROM heads")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.headings(html_pages(spark, sf_dir)).agg(F.count("*").alias("headings"), F.count_if(F.col("text") == "").alias("empty"))


_DATA = r'(?i)application/ld\+json'


_TARGET = "regexp_replace(regexp_replace(lower(url), '^https?://(?:www[.]|m[.])?', ''), '[?#].*$', '')"


@query(
    "h10_orphans",
    f"""WITH {_LINKS}, t AS (SELECT DISTINCT {_TARGET} AS target FROM links WHERE url IS NOT NULL), k AS (SELECT page_id, host, {_TARGET.replace('url', 'page_url')} AS own FROM h)
    SELECT host, count(*) AS pages, count(*) FILTER (own NOT IN (SELECT target FROM t)) AS orphans FROM k GROUP BY host HAVING count(*) >= 5""",
)
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "^https?://(?:www[.]|m[.])?", ""), "[?#].*$", "")
    own = html_pages(spark, sf_dir)
    t = html_rows.links(own).select(norm("url").alias("own")).distinct().withColumn("linked", F.lit(True))
    k = own.select("page_id", "host", norm("page_url").alias("own")).dropDuplicates(["page_id"]).join(t, "own", "left")
    return k.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("linked").isNull()).alias("orphans")).where("pages >= 5")


# ---- samples

_STRATA = f"st AS (SELECT host, {_KEY} AS template, count(*) AS size FROM p GROUP BY 1, 2)"
BUDGET = 30


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("template", template_key(url_path("page_url")))
    return df.groupBy("host", "template").agg(F.count("*").alias("size"))


_ALLOC = f"""{_STRATA}, aa AS (SELECT *, sum(size) OVER (PARTITION BY host) AS total, count(*) OVER (PARTITION BY host) AS keys FROM st),
ab AS (SELECT *, size::DOUBLE / total * ({BUDGET} - keys) AS share FROM aa), ac AS (SELECT *, 1 + least(floor(share), size - 1) AS given FROM ab),
ad AS (SELECT *, {BUDGET} - sum(given) OVER (PARTITION BY host) AS remaining, share - floor(share) AS fraction, row_number() OVER (PARTITION BY host ORDER BY size DESC, template) AS rank FROM ac),
ae AS (SELECT host, template, remaining, row_number() OVER (PARTITION BY host ORDER BY round, fraction DESC, template) AS place FROM ad CROSS JOIN (VALUES (1), (2)) r(round) WHERE keys <= {BUDGET} AND size - given >= round),
af AS (SELECT host, template, count(*) AS extra FROM ae WHERE place <= remaining GROUP BY 1, 2),
alloc AS (SELECT host, template, size, CAST(CASE WHEN keys > {BUDGET} THEN (rank <= {BUDGET})::INTEGER ELSE given + coalesce(extra, 0) END AS BIGINT) AS slots FROM ad LEFT JOIN af USING (host, template))"""


@query("l09_allocation", f"WITH {P}, {_ALLOC} SELECT * FROM alloc")
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.allocate(strata(spark, sf_dir), "host", "template", "size", BUDGET)


@query(
    "l10_even_sample",
    f"""WITH {P}, {_ALLOC}, q AS (SELECT page_id, host, {_KEY} AS template, page_ord FROM p), r AS (SELECT page_id, host, template, slots, size, row_number() OVER (PARTITION BY host, template ORDER BY page_ord, page_id) - 1 AS i FROM q JOIN alloc USING (host, template)),
    picks AS (SELECT host, template, CAST(floor(k * size::DOUBLE / slots) AS BIGINT) AS i FROM (SELECT host, template, slots, size, unnest(range(slots)) AS k FROM alloc WHERE slots > 0) t)
    SELECT DISTINCT r.page_id, host, template FROM r JOIN picks USING (host, template, i)""",
)
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    alloc = sampling.allocate(strata(spark, sf_dir), "host", "template", "size", BUDGET).where("slots > 0").select("host", "template", "slots")
    rows = pages(spark, sf_dir, "page_ord").withColumn("template", template_key(url_path("page_url"))).join(alloc, ["host", "template"])
    return sampling.pick_evenly(rows, ["host", "template"], ["page_ord", "page_id"], "slots").select("page_id", "host", "template")


# ---- clusters and graphs


@query(
    "l01_shingles",
    f"""WITH {B}, t AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_ord) AS t FROM b GROUP BY page_id), w AS (SELECT page_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM t)
    SELECT page_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS INTEGER) AS shingles FROM w""",
)
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.page_text import page_text

    w = page_text(blocks(spark, sf_dir, "text")).select("page_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))
    n = F.when(F.size("w") == 0, 0).when(F.size("w") < 5, 1).otherwise(F.size(F.array_distinct(grams)))
    return w.select("page_id", n.alias("shingles"))


@query(
    "l05_page_components",
    f"""WITH RECURSIVE {P}, k AS (SELECT page_id, {_FORK} AS f, sha256(html) AS c FROM p WHERE html IS NOT NULL),
    e AS (SELECT page_id AS x, min(page_id) OVER (PARTITION BY f) AS y FROM k UNION SELECT page_id, min(page_id) OVER (PARTITION BY c) FROM k),
    u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
    SELECT x AS page_id, min(y) AS component FROM r GROUP BY x""",
)
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = html_pages(spark, sf_dir).select("page_id", fork_key(F.col("page_url")).alias("f"), F.sha2("html", 256).alias("c")).dropDuplicates(["page_id"])
    least = lambda c: k.select(F.col("page_id").alias("src"), F.min("page_id").over(Window.partitionBy(c)).alias("dst"))
    return connected_components(least("f").unionByName(least("c"))).select(F.col("node").alias("page_id"), "component")


_TRADE = """nodes AS (SELECT n_nationkey AS node FROM nation), ed AS (SELECT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey < c_nationkey)"""


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and an edge for each order line from the supplier's nation to the customer's, upwards."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    e = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), e.where("src < dst").select("src", "dst")


@query("l06_degree", f"WITH {_TRADE}, x AS (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed), c AS (SELECT node, count(*) AS degree FROM x GROUP BY node) SELECT node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN c USING (node)")
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree(*trade(spark, sf_dir))


@query(
    "l07_pagerank",
    f"""WITH RECURSIVE {_TRADE}, o AS (SELECT src, count(*) AS outs FROM ed GROUP BY src), m AS (SELECT src, dst, count(*)::DOUBLE / any_value(outs) AS part FROM ed JOIN o USING (src) GROUP BY src, dst),
    c AS (SELECT count(*) AS n FROM nodes),
    r AS (SELECT 0 AS it, node, 1.0::DOUBLE / n AS rank FROM nodes, c UNION ALL
      SELECT it + 1, node, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(given, 0) FROM (SELECT any_value(x.it) AS it, nodes.node AS node, any_value(c.n) AS n,
        sum(CASE WHEN x.node NOT IN (SELECT src FROM o) THEN x.rank ELSE 0 END) AS lost, sum(x.rank * coalesce(m.part, 0)) AS given
        FROM nodes CROSS JOIN c CROSS JOIN r x LEFT JOIN m ON m.src = x.node AND m.dst = nodes.node WHERE x.it < 20 GROUP BY nodes.node) q)
    SELECT node, round(rank, 6) AS rank FROM r WHERE it = 20""",
)
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(*trade(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


# ---- report

_FINDINGS = rf"""{_LINKS}, {B}, okabout AS (SELECT DISTINCT page_id FROM links WHERE url IS NOT NULL AND {_ABOUT.format(_UPATH)}),
leak AS (SELECT DISTINCT page_id FROM b WHERE regexp_matches(text, '\{{\{{|\$\{{|<%|\[\[')),
fd AS (SELECT 'EN-05-missing-viewport' AS id, 'engagement' AS skill, 'medium' AS severity, 'defect' AS track, 'high' AS confidence, page_id, host, page_url FROM h WHERE NOT regexp_matches(html, '(?i)name="?viewport')
UNION ALL SELECT 'REN-06-no-semantic-boundary', 'static', 'low', 'defect', 'medium', page_id, host, page_url FROM h WHERE NOT regexp_matches(html, '(?i)<(?:main|article)[ >]')
UNION ALL SELECT 'ENT-01-no-structured-data', 'entity', 'medium', 'defect', 'high', page_id, host, page_url FROM h WHERE NOT regexp_matches(html, '(?i)application/ld\+json')
UNION ALL SELECT 'CIT-01-no-about-link', 'citability', 'medium', 'proactive', 'medium', page_id, host, page_url FROM h WHERE page_id NOT IN (SELECT page_id FROM okabout)
UNION ALL SELECT 'CQ-03-template-leakage', 'content', 'high', 'defect', 'low', page_id, host, page_url FROM h WHERE page_id IN (SELECT page_id FROM leak)),
mg AS (SELECT id, any_value(severity) AS severity, any_value(track) AS track, any_value(skill) AS skill, any_value(confidence) AS confidence, count(DISTINCT page_url) AS pages, min(page_url) AS first_page, false AS conflict FROM fd GROUP BY id)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of five checks in the shared schema: one scan of the pages for three of them."""
    own = html_pages(spark, sf_dir)
    h = F.col("html")
    make = lambda i, sk, sv, tr, cf: F.struct(*(F.lit(v).alias(k) for k, v in zip(("id", "skill", "severity", "track", "confidence"), (i, sk, sv, tr, cf))))
    by_html = F.array_compact(
        F.array(
            F.when(~h.rlike('(?i)name="?viewport'), make("EN-05-missing-viewport", "engagement", "medium", "defect", "high")),
            F.when(~h.rlike("(?i)<(?:main|article)[ >]"), make("REN-06-no-semantic-boundary", "static", "low", "defect", "medium")),
            F.when(~h.rlike(r"(?i)application/ld\+json"), make("ENT-01-no-structured-data", "entity", "medium", "defect", "high")),
        )
    )
    keys = ["page_id", "host", "page_url"]
    first = own.select(*keys, by_html.alias("all")).dropDuplicates(["page_id"]).select(*keys, F.explode("all").alias("f"))
    own = own.select(*keys).dropDuplicates(["page_id"])
    about = html_rows.links(html_pages(spark, sf_dir)).where(is_about_path(url_path("url"))).select("page_id").distinct()
    second = own.select(*keys).join(about, "page_id", "left_anti").withColumn("f", make("CIT-01-no-about-link", "citability", "medium", "proactive", "medium"))
    leak = blocks(spark, sf_dir, "text").where(F.col("text").rlike(r"\{\{|\$\{|<%|\[\[")).select("page_id").distinct()
    third = own.select(*keys).join(leak, "page_id", "left_semi").withColumn("f", make("CQ-03-template-leakage", "content", "high", "defect", "low"))
    return first.unionByName(second).unionByName(third).select("f.*", *keys)


@query("m00_findings", f"WITH {_FINDINGS} SELECT * FROM fd")
def m00(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


@query(
    "m01_violations",
    r"""SELECT 'EN-05-missing-viewport' AS id, page_id, 'given twice' AS problem FROM (SELECT page_id, count(*) OVER (PARTITION BY page_id) AS k FROM pages_in WHERE html IS NOT NULL AND NOT regexp_matches(html, '(?i)name="?viewport')) WHERE k > 1""",
)
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the pages as delivered, where some come twice."""
    raw = table(spark, sf_dir, "pages_in").where(F.col("html").isNotNull() & ~F.col("html").rlike('(?i)name="?viewport'))
    one = {"id": "EN-05-missing-viewport", "severity": "medium", "track": "defect", "confidence": "high"}
    return report.violations(raw.select("page_id", *(F.lit(v).alias(k) for k, v in one.items())))


@query("m02_merged", f"WITH {_FINDINGS} SELECT id, severity, track, skill, confidence, pages, first_page, conflict FROM mg")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.merge(findings(spark, sf_dir))


@query("m02_examples", f"WITH {_FINDINGS}, o AS (SELECT DISTINCT id, page_url FROM fd) SELECT id, CAST(r AS INTEGER) AS place, page_url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_url) AS r FROM o) WHERE r <= 10")
def m02_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.examples(findings(spark, sf_dir))


@query(
    "m04_numbered",
    f"""WITH {_FINDINGS} SELECT id, severity, track, skill, confidence, pages, first_page, conflict, printf('F-%03d', row_number() OVER (ORDER BY track, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, id)) AS number FROM mg""",
)
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(report.merge(findings(spark, sf_dir)))


@query("m05_summary", f"WITH {_FINDINGS} SELECT coalesce(severity, track, 'all') AS what, count(*) AS findings, CAST(sum(pages) AS BIGINT) AS pages FROM mg GROUP BY GROUPING SETS ((severity), (track), ())")
def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(report.merge(findings(spark, sf_dir)))


@query("m07_stamped", f"WITH {_FINDINGS} SELECT id, page_id, 'On ' || page_url || ': ' || id AS evidence FROM fd")
def m07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("id", "page_id", F.concat(F.lit("On "), "page_url", F.lit(": "), "id").alias("evidence"))


@query("m10_stage_budget", """WITH x AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1000 AS reached FROM events) SELECT user_id, count(*) AS units, count(*) FILTER (reached) AS reached FROM x GROUP BY user_id""")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    done = report.within_budget(units, "user_id", ["ts", "event_id"], "value", 1000)
    return done.groupBy("user_id").agg(F.count("*").alias("units"), F.count_if("reached").alias("reached"))


@query(
    "m12_top_candidates",
    f"""WITH {_FINDINGS}, r AS (SELECT host, id, page_id, severity, row_number() OVER (PARTITION BY host ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, id, page_id) AS place FROM fd)
    SELECT host, id, page_id, severity, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""",
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_candidates(findings(spark, sf_dir), "host", "severity", ["id", "page_id"]).select("host", "id", "page_id", "severity", "place")
