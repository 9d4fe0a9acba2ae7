"""Queries for a crawl: gates, sitemap walks, fallback links, registrable domains; and whole audits."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions.urls import page_host, resolve, url_path
from folioforge.operators import domains, html_rows, perimeter, report, sitemaps
from folioforge.plans import audit_plans, content_plans, graph_plans
from folioforge.plans.audit_plans import lit
from folioforge.plans.examples import all_pages, all_pages_sql
from folioforge.plans.perimeter_plans import _LINES
from folioforge.plans.shared import SITE, A, P, Query, artifacts, pages
from folioforge.sources import keep, sharing

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ---- gates

_UPATH = r"CASE WHEN {0} = '' THEN '/' ELSE {0} END"
_RAW = r"regexp_extract(trim(page_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(
    "a06_gated_pages",
    f"""WITH {_LINES}, {P}, sr AS (SELECT regexp_replace(lower(trim(site)), '^(?:www\\.|m\\.)', '') AS host, kind, path, {perimeter.sql_rule_pattern("path")} AS pattern FROM rules JOIN (SELECT DISTINCT site, grp FROM groups WHERE agent = '*') USING (site, grp) WHERE path <> ''),
    pg AS (SELECT page_id, host, {_UPATH.format(_RAW)} AS page_path FROM p), best AS (SELECT page_id, arg_max(kind, len(sr.path) * 2 + (kind = 'allow')::INTEGER) AS kind FROM pg JOIN sr ON pg.host = sr.host AND regexp_matches(page_path, pattern) GROUP BY page_id)
    SELECT page_id, coalesce(kind, 'allow') = 'allow' AS allowed FROM pg LEFT JOIN best USING (page_id)""",
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a crawler without a name of its own may fetch each page; sites without readable rules are open."""
    groups, rules = perimeter.robots_groups(artifacts(spark, sf_dir, "robots"))
    own = rules.join(groups.where("agent = '*'").select("site", "grp").distinct(), ["site", "grp"]).where("path <> ''")
    own = own.select(page_host("site").alias("host"), "kind", "path", perimeter.rule_pattern(F.col("path")).alias("pattern"))
    pg = pages(spark, sf_dir).select("page_id", "host", url_path("page_url").alias("page_path"))
    hit = pg.join(own, "host").where(F.rlike("page_path", "pattern"))
    best = hit.groupBy("page_id").agg(F.max_by("kind", F.struct(F.length("path"), (F.col("kind") == "allow").cast("int"))).alias("kind"))
    return pg.select("page_id").join(best, "page_id", "left").select("page_id", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))


# ---- sitemaps and fallback links

#: Sitemaps of a walk: an index, a nested index that names it again, two files of pages.
_FILES = [
    ("https://w.test/sitemap.xml", "<sitemapindex><sitemap><loc>https://w.test/a.xml</loc></sitemap><sitemap><loc> https://w.test/more.xml </loc></sitemap><sitemap><loc>https://w.test/gone.xml.gz</loc></sitemap></sitemapindex>"),
    ("https://w.test/more.xml", "<sitemapindex><sitemap><loc>https://w.test/sitemap.xml</loc></sitemap><sitemap><loc>https://w.test/b.xml</loc></sitemap></sitemapindex>"),
    ("https://w.test/a.xml", "<urlset><url><loc>https://w.test/1</loc></url><url><loc>https://w.test/2</loc></url></urlset>"),
    ("https://w.test/b.xml", "<urlset><url><loc>https://w.test/2</loc></url><url><loc>https://w.test/3</loc></url><url><loc>https://w.test/a.xml</loc></url></urlset>"),
]
_LOC = r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>"
_ROOT_OF = "'https://' || site || '/sitemap.xml'"


@query(
    "a12_sitemap_walk",
    f"""WITH RECURSIVE {A}, f AS (SELECT {_ROOT_OF} AS url, text FROM (SELECT DISTINCT site, text FROM a WHERE kind = 'sitemap' AND status = 'present') UNION ALL SELECT * FROM (VALUES {", ".join(f"({lit(u)}, {lit(t)})" for u, t in _FILES)}) AS v(url, text)),
    rt AS (SELECT DISTINCT site, {_ROOT_OF} AS url FROM a WHERE kind = 'sitemap' AND status = 'present' UNION ALL SELECT 'w.test', 'https://w.test/sitemap.xml'),
    w AS (SELECT site, url AS sitemap, 0 AS level FROM rt UNION SELECT w.site, trim(l.u), w.level + 1 FROM w JOIN f ON f.url = w.sitemap, LATERAL (SELECT unnest(regexp_extract_all(f.text, {lit(_LOC)}, 1)) AS u) AS l WHERE w.level < {sitemaps.MOST_LEVELS - 1} AND (contains(lower(f.text), '<sitemapindex') OR regexp_matches(lower(trim(l.u)), '\\.xml(?:\\.gz)?$'))),
    fw AS (SELECT site, sitemap, min(level) AS level FROM w GROUP BY site, sitemap), lc AS (SELECT site, sitemap, level, contains(lower(text), '<sitemapindex') AS ix, trim(unnest(l)) AS url, unnest(range(len(l))) AS ord FROM (SELECT fw.*, f.text, regexp_extract_all(f.text, {lit(_LOC)}, 1) AS l FROM fw JOIN f ON f.url = fw.sitemap)),
    pg AS (SELECT site, url, min(struct_pack(level := level, sitemap := sitemap, ord := ord)) AS m FROM lc WHERE NOT ix AND NOT regexp_matches(lower(url), '\\.xml(?:\\.gz)?$') AND ord < {sitemaps.MOST_OF_FILE} GROUP BY site, url)
    SELECT site, url, m.sitemap AS sitemap, m.level AS level FROM pg QUALIFY row_number() OVER (PARTITION BY site ORDER BY m.level, m.sitemap, m.ord, url) <= {sitemaps.MOST_OF_SITE}""",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses reached from each site's sitemap, through indexes."""
    maps = artifacts(spark, sf_dir, "sitemap").where("status = 'present'")
    root = F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml"))
    files = maps.select(root.alias("url"), "text").unionByName(spark.createDataFrame(_FILES, "url string, text string"))
    roots = maps.select("site", root.alias("url")).distinct().unionByName(spark.createDataFrame([("w.test", _FILES[0][0])], "site string, url string"))
    return sitemaps.walk(roots, files)


_CHROME = r"(?is)<(?:nav|footer)(?:[ \t\r\n][^>]*)?>.*?</(?:nav|footer)[ \t\r\n]*>"
_HREF = r"""(?is)<a[ \t\r\n][^>]*?href[ \t\r\n]*=[ \t\r\n]*["']([^"'>]*)["']"""
_UHOST = SITE.replace("page_url", "url")


@query(
    "a13_fallback_links",
    f"""WITH {all_pages_sql("links")}, c AS (SELECT page_id, page_url, host, array_to_string(regexp_extract_all({markup.sql_without_hidden("html")}, {lit(_CHROME)}), ' ') AS c FROM x), l AS (SELECT page_id, page_url, host, trim(unnest(regexp_extract_all(c, {lit(_HREF)}, 1))) AS r, unnest(range(len(regexp_extract_all(c, {lit(_HREF)}, 1)))) AS ord FROM c),
    ab AS (SELECT *, regexp_replace(r, '#.*$', '') AS clean, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://.*/)', 1) AS f0 FROM l),
    u AS (SELECT page_id, host, ord, CASE WHEN r LIKE '#%' OR r = '' THEN NULL WHEN regexp_matches(r, '^(?i)https?://') THEN clean WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(r, '//') THEN scheme || clean WHEN starts_with(r, '/') THEN origin || clean ELSE CASE WHEN len(f0) <= len(origin) THEN origin || '/' ELSE f0 END || clean END AS url FROM ab)
    SELECT page_id, url, min(ord) AS ord FROM u WHERE url IS NOT NULL AND {_UHOST} = host GROUP BY page_id, url""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the own site in menus and footers, each once, for sites without a sitemap."""
    c = F.array_join(html_rows.all_of(markup.without_hidden(F.col("html")), _CHROME, 0), " ")
    p = all_pages(spark, sf_dir, "links").select("page_id", "page_url", "host", html_rows.all_of(c, _HREF, 1).alias("l")).dropDuplicates(["page_id"])
    rows = p.select("page_id", "page_url", "host", F.posexplode("l").alias("ord", "href")).withColumn("url", resolve(F.col("href"), F.col("page_url")))
    return rows.where(F.col("url").isNotNull() & (page_host("url") == F.col("host"))).groupBy("page_id", "url").agg(F.min("ord").cast("long").alias("ord"))


# Suffixes of the hosts in these tables and some with two labels, for the query; a whole list is a parameter of the operator.
_SUFFIXES = ("example", "test", "invalid", "co.uk", "com", "shop.example", "*.ck", "!www.ck")
_HOSTS = ("a.co.uk", "b.a.co.uk", "co.uk", "x.y.ck", "www.ck", "n.www.ck", "10.0.0.1", "single", "p.unknown")


@query(
    "d03_registrable_domains",
    f"""WITH {P}, h AS (SELECT DISTINCT host FROM (SELECT host FROM p UNION ALL SELECT unnest([{", ".join(map(lit, _HOSTS))}])) WHERE host <> ''), s AS (SELECT unnest([{", ".join(map(lit, _SUFFIXES))}]) AS rule), e AS (SELECT host, string_split(host, '.') AS l, len(string_split(host, '.')) AS n, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h),
    k AS (SELECT host, n, array_to_string(l[i:], '.') AS rule, i AS sa FROM e UNION ALL SELECT host, n, '*.' || regexp_replace(array_to_string(l[i:], '.'), '^[^.]*\\.', ''), i FROM e UNION ALL SELECT host, n, '!' || array_to_string(l[i:], '.'), i + 1 FROM e),
    b AS (SELECT host, min(struct_pack(p := NOT starts_with(rule, '!'), sa := sa)).sa AS sb FROM k JOIN s USING (rule) GROUP BY host),
    a AS (SELECT host, string_split(host, '.') AS l, b.sb IS NOT NULL AS known, coalesce(b.sb, len(string_split(host, '.'))) AS sa, regexp_matches(host, '^[0-9.]+$|^\\[|:') AS addr FROM h LEFT JOIN b USING (host))
    SELECT host, CASE WHEN NOT addr THEN array_to_string(l[greatest(sa, 1):], '.') END AS suffix, CASE WHEN NOT addr AND sa > 1 THEN array_to_string(l[sa - 1:], '.') END AS domain, CASE WHEN known THEN 'high' ELSE 'low' END AS confidence FROM a""",
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = pages(spark, sf_dir).select("host").unionByName(spark.createDataFrame([(h,) for h in _HOSTS], "host string"))
    return domains.registrable_domains(hosts, spark.createDataFrame([(s,) for s in _SUFFIXES], "suffix string"))


# ---- whole audits

# Fixed values: (finding, skill, severity, track, confidence) and the query whose pages show it.
CHECKS = (
    ("EN-09-unlabelled-form-fields", "engagement", "high", "defect", "high", "h01_unlabelled_fields"),
    ("EN-09-no-machine-readable-action", "engagement", "low", "proactive", "medium", "h02_no_machine_action"),
    ("EN-04-dead-end", "engagement", "medium", "defect", "high", "h09_dead_ends"),
    ("EN-05-fixed-width-overflow", "engagement", "medium", "defect", "medium", "h04_fixed_widths"),
    ("EN-07-unsized-images", "engagement", "low", "defect", "high", "h06_unsized_images"),
    ("ENT-02-no-knowledge-graph-link", "entity", "medium", "defect", "high", "i02_no_authority"),
    ("ENT-03-rating-markup-text-mismatch", "entity", "high", "defect", "medium", "i03_rating_mismatch"),
    ("ENT-11-dangling-id-reference", "entity", "medium", "defect", "high", "i06_dangling_references"),
    ("ENT-12-entity-graph-fragmented", "entity", "low", "defect", "medium", "i08_fragmented_graphs"),
    ("RET-01-token-not-in-text", "retrieval", "medium", "defect", "high", "j01_token_not_in_text"),
    ("REN-02-hydration-content-not-in-text", "static", "medium", "defect", "medium", "k01_hydration_not_in_text"),
    ("REN-04-price-not-in-text", "static", "high", "defect", "high", "k03_price_not_in_text"),
    ("REN-05-no-freshness-signal", "static", "low", "defect", "medium", "k04_no_freshness_signal"),
    ("REN-08-missing-alt-text", "static", "low", "defect", "high", "k07_missing_alt_text"),
    ("REN-10-phone-only-in-script", "static", "medium", "defect", "medium", "k08_phone_only_in_script"),
    ("REN-11-pdf-content-unverified", "static", "low", "proactive", "low", "k09_pdf_links"),
    ("PER-09-header-meta-robots-disagree", "perimeter", "medium", "defect", "high", "e18_header_meta_disagree"),
    ("CQ-05-relative-date-anchors", "content", "medium", "defect", "medium", "f02_relative_dates"),
    ("CQ-07-scope-ambiguous", "content", "medium", "defect", "medium", "f03_scope_ambiguous"),
    ("CQ-08-computed-stat", "content", "high", "defect", "high", "f04_computed_stat"),
    ("CQ-10-freshness-contradiction", "content", "medium", "defect", "medium", "f07_freshness_contradiction"),
    ("CIT-06-unverifiable-superlatives", "citability", "low", "defect", "medium", "g03_superlatives"),
    ("CIT-07-late-citation", "citability", "low", "defect", "medium", "g04_late_citations"),
)
_ALL = {**graph_plans.QUERIES, **audit_plans.QUERIES, **content_plans.QUERIES}
_ALL_SQL = {**graph_plans.ORACLES, **audit_plans.ORACLES, **content_plans.ORACLES}


#: Checks that run at once; while one plans or waits for its last tasks, the others have the cores.
_AT_ONCE = 3


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, skill, severity, track, confidence, page_id`` of every check on every page.

    Each check is a job of its own and its pages are kept: one plan of all of them is planned
    again after every stage and has no end on large tables.  Tables that several checks read are made once.
    """

    def shown(of: str) -> DataFrame:
        return keep(_ALL[of](spark, sf_dir).select("page_id").distinct(), of)

    with sharing(), ThreadPoolExecutor(_AT_ONCE) as pool:
        kept = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(partial(copy_context().run, shown, check[-1]))) for check in CHECKS]]
    out = None
    for (name, skill, severity, track, confidence, _), rows in zip(CHECKS, kept):
        said = {"id": name, "skill": skill, "severity": severity, "track": track, "confidence": confidence}
        rows = rows.select(*(F.lit(v).alias(k) for k, v in said.items()), "page_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_FOUND = " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS id, '{sk}' AS skill, '{sv}' AS severity, '{tr}' AS track, '{cf}' AS confidence, page_id FROM ({_ALL_SQL[of]}) AS q{k}" for k, (n, sk, sv, tr, cf, of) in enumerate(CHECKS)
)


@query("m14_site_audits", f"WITH pf AS ({_FOUND}), {P} SELECT host, id, skill, severity, track, confidence, count(*) AS pages, min(page_id) AS first_page FROM pf JOIN p USING (page_id) GROUP BY ALL")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of every site: all checks over all its pages, one row a finding."""
    f = page_findings(spark, sf_dir).join(pages(spark, sf_dir).select("page_id", "host"), "page_id")
    return f.groupBy("host", "id", "skill", "severity", "track", "confidence").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("m15_page_audits", f"WITH pf AS ({_FOUND}) SELECT page_id, count(*) AS findings, count(*) FILTER (track = 'defect') AS defects, count(*) FILTER (severity = 'high') AS high, string_agg(id, ' ' ORDER BY id) AS ids FROM pf GROUP BY page_id")
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of each page by itself."""
    g = page_findings(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("findings"), F.count_if(F.col("track") == "defect").alias("defects"), F.count_if(F.col("severity") == "high").alias("high"), F.array_sort(F.collect_list("id")).alias("x")
    )
    return g.select("page_id", "findings", "defects", "high", F.array_join("x", " ").alias("ids"))


__all__ = ["CHECKS", "ORACLES", "QUERIES", "page_findings", "report"]
