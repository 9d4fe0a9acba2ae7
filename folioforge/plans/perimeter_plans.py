"""Queries over site files and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.operators import perimeter as E
from folioforge.plans.shared import A, Query, artifacts
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


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``agent, tier`` of the known reading agents, a fixed dimension."""
    return spark.createDataFrame([(a, t) for t, names in E.AGENTS.items() for a in names], "agent string, tier string")


def agent_names(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(a for names in E.AGENTS.values() for a in names)


_BOTS = ", ".join(f"('{a}', '{t}')" for t, names in E.AGENTS.items() for a in names)
_LINES = rf"""{A}, r AS (SELECT site, text FROM a WHERE kind = 'robots' AND status = 'present'),
ln AS (SELECT site, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM r),
lx AS (SELECT site, CAST(i - 1 AS INTEGER) AS line_no, trim(regexp_replace(regexp_replace(l[i], '^\x{{feff}}', ''), '#.*$', '')) AS line FROM (SELECT site, l, unnest(range(1, len(l) + 1)) AS i FROM ln)),
lf AS (SELECT site, line_no, lower(trim(regexp_extract(line, '^([^:]*):', 1))) AS field, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM lx WHERE contains(line, ':')),
lg AS (SELECT *, lag(field) OVER (PARTITION BY site ORDER BY line_no) AS pf FROM lf),
lh AS (SELECT *, sum(CASE WHEN field = 'user-agent' AND (pf IS NULL OR pf <> 'user-agent') THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY line_no) AS grp FROM lg),
groups AS (SELECT DISTINCT site, grp, lower(value) AS agent FROM lh WHERE grp > 0 AND field = 'user-agent'),
rules AS (SELECT site, grp, line_no, field AS kind, value AS path FROM lh WHERE grp > 0 AND field IN ('allow', 'disallow')),
bots AS (SELECT * FROM (VALUES {_BOTS}) AS v(agent, tier)),
matrix AS (SELECT site, agent, lower(agent) AS a FROM (SELECT DISTINCT site FROM r) CROSS JOIN bots),
named AS (SELECT m.site, m.agent, g.grp FROM matrix m JOIN groups g ON m.site = g.site AND m.a = g.agent),
star AS (SELECT m.site, m.agent, g.grp FROM matrix m JOIN groups g ON m.site = g.site AND g.agent = '*' WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.site = m.site AND n.agent = m.agent)),
own AS (SELECT o.site, o.agent, kind, path FROM (SELECT * FROM named UNION ALL SELECT * FROM star) o JOIN rules USING (site, grp) WHERE path <> '')"""


def _allowed_sql(paths: str) -> str:
    return f"""{_LINES}, asked AS (SELECT m.site, m.agent, q.path FROM matrix m JOIN ({paths}) q USING (site)),
    best AS (SELECT k.site, k.agent, k.path, arg_max(o.kind, len(o.path) * 2 + (o.kind = 'allow')::INTEGER) AS kind FROM asked k
      LEFT JOIN own o ON o.site = k.site AND o.agent = k.agent AND regexp_matches(k.path, {E.sql_rule_pattern("o.path")}) GROUP BY k.site, k.agent, k.path),
    allowed AS (SELECT site, agent, path, coalesce(kind, 'allow') = 'allow' AS allowed FROM best)"""


_ROOT = "SELECT DISTINCT site, '/' AS path FROM r"


def root_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = artifacts(spark, sf_dir, "robots")
    roots = robots.where("status = 'present'").select("site", F.lit("/").alias("path")).distinct()
    return E.allowed(robots, agent_names(spark, sf_dir), roots)


@query("e01_robots_groups", f"WITH {_LINES} SELECT site, CAST(grp AS BIGINT) AS grp, line_no, kind, path FROM rules")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.robots_groups(artifacts(spark, sf_dir, "robots"))[1]


@query("e02_access_matrix", f"WITH {_allowed_sql(_ROOT)} SELECT * FROM allowed")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_access(spark, sf_dir)


@query(
    "e03_tier_blocked",
    f"""WITH {_allowed_sql(_ROOT)}, j AS (SELECT * FROM allowed JOIN bots USING (agent)), whole AS (SELECT site FROM j GROUP BY site HAVING bool_and(NOT allowed))
    SELECT site, tier, CASE tier WHEN 'ai_search' THEN 'critical' WHEN 'on_demand' THEN 'high' WHEN 'training' THEN 'medium' ELSE 'low' END AS severity,
    string_agg(agent, ', ' ORDER BY agent) FILTER (NOT allowed) AS blocked, count(*) FILTER (allowed) AS open_agents FROM j WHERE site NOT IN (SELECT site FROM whole)
    GROUP BY site, tier HAVING count(*) FILTER (NOT allowed) > 0""",
)
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = root_access(spark, sf_dir).join(agents(spark, sf_dir), "agent")
    whole = j.groupBy("site").agg(F.bool_and(~F.col("allowed")).alias("w")).where("w").select("site")
    g = j.join(whole, "site", "left_anti").groupBy("site", "tier").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("allowed"), F.col("agent")))), ", ").alias("blocked"), F.count_if("allowed").alias("open_agents")
    )
    return g.where("blocked <> ''").select("site", "tier", E.severity(F.col("tier")).alias("severity"), "blocked", "open_agents")


@query(
    "e04_all_blocked",
    f"WITH {_allowed_sql(_ROOT)} SELECT site, 'critical' AS severity, count(*) AS agents FROM allowed GROUP BY site HAVING bool_and(NOT allowed)",
)
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = root_access(spark, sf_dir).groupBy("site").agg(F.bool_and(~F.col("allowed")).alias("w"), F.count("*").alias("agents"))
    return g.where("w").select("site", F.lit("critical").alias("severity"), "agents")


@query(
    "e05_agent_dimension",
    f"""WITH pb AS (SELECT lower(agent) AS k, min(tier) AS tier, count(*) AS probes FROM probes_in WHERE NOT is_control AND tier IS NOT NULL GROUP BY 1), kn AS (SELECT agent, tier, lower(agent) AS k FROM (VALUES {_BOTS}) AS v(agent, tier))
    SELECT coalesce(kn.agent, pb.k) AS agent, coalesce(kn.tier, pb.tier) AS tier, kn.k IS NOT NULL AS known, coalesce(probes, 0) AS probes FROM kn FULL JOIN pb ON kn.k = pb.k""",
)
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known agents and those that were probed besides."""
    pb = table(spark, sf_dir, "probes_in").where("not is_control and tier is not null").groupBy(F.lower("agent").alias("k")).agg(F.min("tier").alias("ptier"), F.count("*").alias("probes"))
    kn = agents(spark, sf_dir).withColumn("kk", F.lower("agent"))
    j = kn.join(pb, F.col("kk") == F.col("k"), "full")
    return j.select(F.coalesce("agent", "k").alias("agent"), F.coalesce("tier", "ptier").alias("tier"), F.col("kk").isNotNull().alias("known"), F.coalesce("probes", F.lit(0)).alias("probes"))


@query(
    "e06_probe_plan",
    f"""WITH {_allowed_sql(_ROOT)}, j AS (SELECT site, tier, agent FROM allowed JOIN bots USING (agent) WHERE allowed)
    SELECT site, tier, min(agent) AS representative FROM j GROUP BY site, tier""",
)
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = root_access(spark, sf_dir).where("allowed").join(agents(spark, sf_dir), "agent")
    return j.groupBy("site", "tier").agg(F.min("agent").alias("representative"))


_CLASS = (
    "CASE WHEN "
    + " OR ".join(f"contains(lower(coalesce(body, '')), '{m}')" for m in E.CHALLENGES)
    + " THEN 'challenge' WHEN http_status IN (403, 429) THEN 'blocked' WHEN http_status BETWEEN 200 AND 299 THEN 'ok' ELSE 'ambiguous' END"
)
_PR = f"pr AS (SELECT DISTINCT site, tier, agent, is_control, http_status, body, {_CLASS} AS class FROM probes_in)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "probes_in").dropDuplicates()
    return p.withColumn("class", E.response_class(F.col("http_status"), F.col("body")))


@query("c29_response_class", f"WITH {_PR} SELECT class, count(*) AS probes, count(DISTINCT site) AS sites FROM pr GROUP BY class")
def c29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("class").agg(F.count("*").alias("probes"), F.countDistinct("site").alias("sites"))


@query(
    "e07_edge_blocked",
    f"""WITH {_PR}, ok AS (SELECT DISTINCT site FROM pr WHERE is_control AND class = 'ok')
    SELECT site, tier, agent, CASE tier WHEN 'ai_search' THEN 'critical' WHEN 'on_demand' THEN 'high' WHEN 'training' THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN bool_or(class = 'blocked') THEN 'high' ELSE 'medium' END AS confidence FROM pr WHERE NOT is_control AND class IN ('blocked', 'challenge') AND site IN (SELECT site FROM ok) GROUP BY site, tier, agent""",
)
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = classified(spark, sf_dir)
    ok = p.where("is_control and class = 'ok'").select("site").distinct()
    bad = p.where("not is_control and class in ('blocked', 'challenge')").join(ok, "site", "left_semi")
    g = bad.groupBy("site", "tier", "agent").agg(F.bool_or(F.col("class") == "blocked").alias("b"))
    return g.select("site", "tier", "agent", E.severity(F.col("tier")).alias("severity"), F.when(F.col("b"), "high").otherwise("medium").alias("confidence"))


@query(
    "e08_circuit_breaker",
    """WITH x AS (SELECT user_id, event_id, ts, event_type = 'error' OR value > 50 AS failed FROM events),
    y AS (SELECT *, sum((NOT failed)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x),
    z AS (SELECT *, sum(failed::INTEGER) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM y)
    SELECT user_id, count(*) AS events, count(*) FILTER (run >= 2) AS while_open, CAST(max(run) AS BIGINT) AS longest FROM z GROUP BY user_id""",
)
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    failed = (F.col("event_type") == "error") | (F.col("value") > 50)
    z = E.circuit_open(ev, "user_id", ["ts", "event_id"], failed)
    return z.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("open").alias("while_open"), F.max("run").alias("longest"))


_HTML = r"(regexp_matches(hd, '^(?:<!doctype html|<html)') OR contains(hd, '<head') OR contains(hd, '<body'))"
_HD = r"lower(left(regexp_replace(text, '^[ \t\r\n\x{feff}]+', ''), 400)) AS hd"


@query(
    "e09_llms",
    rf"""WITH {A}, x AS (SELECT site, status, text, {_HD} FROM a WHERE kind = 'llms' AND status <> 'unavailable'),
    y AS (SELECT site, status, status = 'present' AND {_HTML} AS soft, NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]*# ') AS no_title, NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]*> ') AS no_summary,
      NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]*## ') AS no_sections, NOT regexp_matches(coalesce(text, ''), '(?m)^[ \t]*[-*+] .*\[.*\]\(') AS no_links, NOT regexp_matches(coalesce(text, ''), '\):') AS no_notes FROM x)
    SELECT site, CASE WHEN status = 'absent' OR soft THEN 'missing' ELSE 'malformed' END AS finding,
    CASE WHEN status = 'absent' OR soft THEN 0 ELSE no_title::INTEGER + no_summary::INTEGER + no_sections::INTEGER + (CASE WHEN no_links THEN 1 WHEN no_notes THEN 1 ELSE 0 END) END AS problems
    FROM y WHERE status = 'absent' OR soft OR no_title OR no_summary OR no_sections OR no_links OR no_notes""",
)
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = artifacts(spark, sf_dir, "llms").where("status <> 'unavailable'")
    t = F.coalesce("text", F.lit(""))
    gone = (F.col("status") == "absent") | E.looks_like_html(t)
    no = {
        "title": ~t.rlike(r"(?m)^[ \t]*# "), "summary": ~t.rlike(r"(?m)^[ \t]*> "), "sections": ~t.rlike(r"(?m)^[ \t]*## "),
        "links": ~t.rlike(r"(?m)^[ \t]*[-*+] .*\[.*\]\(") | ~t.rlike(r"\):"),
    }
    problems = sum((c.cast("int") for c in no.values()), F.lit(0))
    return df.select("site", F.when(gone, "missing").otherwise("malformed").alias("finding"), F.when(gone, 0).otherwise(problems).alias("problems"), gone.alias("g")).where("g or problems > 0").drop("g")


@query(
    "e10_llms_full_thin",
    rf"""WITH {A} SELECT site, CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS INTEGER) AS words, len(regexp_extract_all(text, '[^ \t\r\n]+')) < 50 AS thin FROM a WHERE kind = 'llms_full' AND status = 'present'""",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))
    return artifacts(spark, sf_dir, "llms_full").where("status = 'present'").select("site", n.alias("words"), (n < 50).alias("thin"))


_LOC = r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>"


@query(
    "e11_sitemap",
    rf"""WITH {A}, x AS (SELECT site, status, regexp_matches(left(coalesce(text, ''), 2000), '(?i)<[ ]*(?:[a-z0-9]+:)?(urlset|sitemapindex)') AS root, len(regexp_extract_all(coalesce(text, ''), '{_LOC}')) AS n FROM a WHERE kind = 'sitemap' AND status <> 'unavailable')
    SELECT site, CASE WHEN status = 'absent' THEN 'missing' WHEN NOT root THEN 'malformed' WHEN n = 0 THEN 'empty' ELSE 'fine' END AS state, CAST(n AS INTEGER) AS urls FROM x""",
)
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    root = F.left(t, F.lit(2000)).rlike("(?i)<[ ]*(?:[a-z0-9]+:)?(urlset|sitemapindex)")
    n = F.regexp_count(t, F.lit(_LOC))
    state = F.when(F.col("status") == "absent", "missing").when(~root, "malformed").when(n == 0, "empty").otherwise("fine")
    return artifacts(spark, sf_dir, "sitemap").where("status <> 'unavailable'").select("site", state.alias("state"), n.alias("urls"))


@query("a11_sitemap_urls", rf"WITH {A}, x AS (SELECT site, regexp_extract_all(text, '{_LOC}', 1) AS l FROM a WHERE kind = 'sitemap' AND status = 'present') SELECT site, CAST(i - 1 AS INTEGER) AS ord, trim(l[i]) AS url FROM (SELECT site, l, unnest(range(1, len(l) + 1)) AS i FROM x)")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sitemap_urls(artifacts(spark, sf_dir, "sitemap"))


@query("e12_no_markdown", f"WITH {A}, x AS (SELECT site, status, coalesce(content_type, '') AS ct, {_HD} FROM a WHERE kind = 'md' AND status <> 'unavailable') SELECT site, status, ct AS content_type FROM x WHERE status = 'absent' OR {_HTML} OR contains(ct, 'text/html')")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = artifacts(spark, sf_dir, "md").where("status <> 'unavailable'").withColumn("ct", F.coalesce("content_type", F.lit("")))
    bad = (F.col("status") == "absent") | E.looks_like_html(F.coalesce("text", F.lit(""))) | F.col("ct").contains("text/html")
    return df.where(bad).select("site", "status", F.col("ct").alias("content_type"))


@query(
    "e13_sitemap_not_in_robots",
    rf"""WITH {A}, s AS (SELECT DISTINCT site FROM a WHERE kind = 'sitemap' AND status = 'present'), r AS (SELECT site, bool_or(status = 'unavailable') AS unknown, bool_or(regexp_matches(coalesce(text, ''), '(?im)^[ \t]*sitemap[ \t]*:')) AS named FROM a WHERE kind = 'robots' GROUP BY site)
    SELECT site, CASE WHEN unknown THEN 'unknown' ELSE 'not named' END AS state FROM s JOIN r USING (site) WHERE unknown OR NOT named""",
)
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = artifacts(spark, sf_dir, "sitemap").where("status = 'present'").select("site").distinct()
    named = F.coalesce("text", F.lit("")).rlike(r"(?im)^[ \t]*sitemap[ \t]*:")
    r = artifacts(spark, sf_dir, "robots").groupBy("site").agg(F.bool_or(F.col("status") == "unavailable").alias("u"), F.bool_or(named).alias("n"))
    return s.join(r, "site").where("u or not n").select("site", F.when(F.col("u"), "unknown").otherwise("not named").alias("state"))


_NORM = r"regexp_replace(regexp_extract(lower(trim({0})), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(trim({0}), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '\.md$', ''), '/+$', ''), ''), '/')"
_MDLINK = r"\]\((https?://[^) ]+)\)"


def url_key(c):
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), "^[a-z]+://([^/?#]*)", 1), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(c), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"\.md$", ""), "/+$", "")
    return F.concat(host, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))


_NO_PAGE = r"(?i)\.(?:txt|json|xml)$"


@query(
    "e14_llms_not_in_sitemap",
    rf"""WITH {A}, l AS (SELECT DISTINCT site, unnest(regexp_extract_all(text, '{_MDLINK}', 1)) AS url FROM a WHERE kind = 'llms' AND status = 'present'), sm AS (SELECT site, text FROM a WHERE kind = 'sitemap' AND status = 'present'),
    ix AS (SELECT DISTINCT site FROM sm WHERE regexp_matches(text, '(?i)<sitemapindex')), m AS (SELECT site, unnest(l) AS url, unnest(range(len(l))) AS ord FROM (SELECT site, regexp_extract_all(text, '{_LOC}', 1) AS l FROM sm WHERE site NOT IN (SELECT site FROM ix))),
    k AS (SELECT DISTINCT site, {_NORM.format('url')} AS key FROM m), fh AS (SELECT site, min(split_part({_NORM.format('url')}, '/', 1)) AS host FROM m WHERE ord = 0 GROUP BY site)
    SELECT DISTINCT l.site, {_NORM.format('l.url')} AS key, 'missing' AS state FROM l JOIN fh USING (site) WHERE split_part({_NORM.format('l.url')}, '/', 1) = host AND NOT regexp_matches({_NORM.format('l.url')}, '{_NO_PAGE}')
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.site = l.site AND k.key = {_NORM.format('l.url')})
    UNION ALL SELECT DISTINCT site, '', 'unknown' FROM l WHERE site IN (SELECT site FROM ix)""",
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that llms.txt names on the host of the sitemap's first address and that the sitemap lacks; unknown where that is an index."""
    ll = artifacts(spark, sf_dir, "llms").where("status = 'present'").select("site", F.explode(F.regexp_extract_all("text", F.lit(_MDLINK), F.lit(1))).alias("url"))
    ll = ll.select("site", url_key(F.col("url")).alias("key")).distinct()
    maps = artifacts(spark, sf_dir, "sitemap").where("status = 'present'")
    index = maps.where(F.col("text").rlike("(?i)<sitemapindex")).select("site").distinct()
    m = E.sitemap_urls(maps.join(index, "site", "left_anti")).select("site", "ord", url_key(F.col("url")).alias("key"))
    first = m.where("ord = 0").groupBy("site").agg(F.min(F.split_part("key", F.lit("/"), F.lit(1))).alias("host"))
    lacking = ll.join(first, "site").where((F.split_part("key", F.lit("/"), F.lit(1)) == F.col("host")) & ~F.col("key").rlike(_NO_PAGE)).select("site", "key")
    lacking = lacking.join(m.select("site", "key").distinct(), ["site", "key"], "left_anti").withColumn("state", F.lit("missing"))
    return lacking.unionByName(ll.join(index, "site", "left_semi").select("site").distinct().select("site", F.lit("").alias("key"), F.lit("unknown").alias("state")))


_PATHS = rf"SELECT DISTINCT site, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT site, unnest(regexp_extract_all(text, '{_LOC}', 1)) AS u FROM a WHERE kind = 'sitemap' AND status = 'present')"


_BOTH = f"SELECT site, path FROM ({_PATHS}) UNION SELECT DISTINCT site, '/' FROM r"


@query(
    "e15_sitemap_disallowed",
    f"""WITH {_allowed_sql(_BOTH)}, op AS (SELECT site, agent FROM allowed WHERE path = '/' AND allowed), j AS (SELECT site, tier, agent, path FROM allowed JOIN op USING (site, agent) JOIN bots USING (agent) WHERE NOT allowed.allowed)
    SELECT site, tier, CASE tier WHEN 'ai_search' THEN 'high' WHEN 'on_demand' THEN 'medium' ELSE 'low' END AS severity, count(DISTINCT agent) AS agents, count(DISTINCT path) AS paths FROM j GROUP BY site, tier""",
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared addresses closed to agents that may read the root; one notch less grave than a closed root."""
    paths = E.sitemap_urls(artifacts(spark, sf_dir, "sitemap"))
    paths = paths.select("site", F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    robots = artifacts(spark, sf_dir, "robots")
    roots = robots.where("status = 'present'").select("site", F.lit("/").alias("path"))
    ok = E.allowed(robots, agent_names(spark, sf_dir), paths.unionByName(roots).distinct())
    open_ = ok.where("path = '/' and allowed").select("site", "agent")
    j = ok.where("not allowed").join(open_, ["site", "agent"], "left_semi").join(agents(spark, sf_dir), "agent")
    g = j.groupBy("site", "tier").agg(F.count_distinct("agent").alias("agents"), F.count_distinct("path").alias("paths"))
    return g.select("site", "tier", E.degraded(E.severity(F.col("tier"))).alias("severity"), "agents", "paths")


@query(
    "e17_reservation_against_robots",
    f"""WITH {_allowed_sql(_ROOT)}, t AS (SELECT DISTINCT site FROM a WHERE kind = 'tdmrep' AND status = 'present' AND json_valid(text) AND json_extract_string(text, '$."tdm-reservation"') = '1')
    SELECT site, count(*) FILTER (allowed AND tier = 'training') AS open_agents FROM allowed JOIN bots USING (agent) WHERE site IN (SELECT site FROM t) GROUP BY site""",
)
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = artifacts(spark, sf_dir, "tdmrep").where("status = 'present'")
    t = t.where(F.try_variant_get(F.try_parse_json("text"), '$["tdm-reservation"]', "string") == "1").select("site").distinct()
    ok = root_access(spark, sf_dir).join(agents(spark, sf_dir), "agent").join(t, "site", "left_semi")
    return ok.groupBy("site").agg(F.count_if(F.col("allowed") & (F.col("tier") == "training")).alias("open_agents"))


@query(
    "e19_no_reservation",
    f"WITH {_LINES}, t AS (SELECT DISTINCT site FROM a WHERE kind = 'tdmrep' AND status = 'absent') SELECT DISTINCT g.site FROM groups g JOIN bots b ON g.agent = lower(b.agent) WHERE g.site IN (SELECT site FROM t)",
)
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = artifacts(spark, sf_dir, "tdmrep").where("status = 'absent'").select("site").distinct()
    g, _ = E.robots_groups(artifacts(spark, sf_dir, "robots"))
    known = agents(spark, sf_dir).select(F.lower("agent").alias("agent"))
    return g.join(known, "agent", "left_semi").select("site").distinct().join(t, "site", "left_semi")


@query(
    "e21_api_catalog",
    rf"""WITH {A}, x AS (SELECT site, coalesce(content_type, '') AS ct, text, {_HD} FROM a WHERE kind = 'api_catalog' AND status = 'present'), y AS (SELECT *, json_valid(text) AS ok FROM x WHERE NOT {_HTML})
    SELECT site, NOT contains(ct, 'linkset+json') AS wrong_type, NOT ok OR json_extract_string(text, '$.linkset[0].anchor') IS NULL AS no_anchor, NOT ok OR json_extract(text, '$.linkset[0]."service-desc"') IS NULL AS no_description FROM y""",
)
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = artifacts(spark, sf_dir, "api_catalog").where("status = 'present'").where(~E.looks_like_html(F.col("text")))
    v = F.try_parse_json("text")
    return df.select(
        "site", (~F.coalesce("content_type", F.lit("")).contains("linkset+json")).alias("wrong_type"),
        F.try_variant_get(v, "$.linkset[0].anchor", "string").isNull().alias("no_anchor"),
        F.try_variant_get(v, '$.linkset[0]["service-desc"]', "string").isNull().alias("no_description"),
    )


_BODY = markup.sql_visible_text("body")


@query(
    "e22_content_parity",
    f"""WITH {_PR}, c AS (SELECT site, max(len({_BODY})) AS control, bool_or(contains(lower(body), 'application/ld+json')) AS data FROM pr WHERE is_control AND http_status = 200 GROUP BY site)
    SELECT site, tier, agent, round(len({_BODY}) * 1.0::DOUBLE / control, 6) AS ratio, len({_BODY}) * 1.0::DOUBLE / control < 0.5 AS thin, data AND NOT contains(lower(body), 'application/ld+json') AS data_lost FROM pr JOIN c USING (site) WHERE NOT is_control AND http_status = 200 AND control > 0""",
)
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text that agents get against the control's, and structured data they lose."""
    p = classified(spark, sf_dir).where("http_status = 200").withColumns({"n": F.length(markup.visible_text(F.col("body"))), "d": F.lower("body").contains("application/ld+json")})
    c = p.where("is_control").groupBy("site").agg(F.max("n").alias("control"), F.bool_or("d").alias("data")).where("control > 0")
    r = F.col("n").cast("double") / F.col("control")
    return p.where("not is_control").join(c, "site").select("site", "tier", "agent", F.round(r, 6).alias("ratio"), (r < 0.5).alias("thin"), (F.col("data") & ~F.col("d")).alias("data_lost"))


@query(
    "g08_uncorroborated_numbers",
    rf"""WITH o AS (SELECT DISTINCT site, url, text FROM offsite_in WHERE status = 'present'), b AS (SELECT DISTINCT page_id, block_ord, lower(site) AS site, text FROM blocks_in WHERE site IS NOT NULL),
    n AS (SELECT DISTINCT site, unnest(regexp_extract_all(text, '[0-9]{{4,}}')) AS number FROM b), s AS (SELECT site, string_agg(text, ' ') AS t FROM o GROUP BY site)
    SELECT n.site, count(*) AS numbers, count(*) FILTER (NOT regexp_matches(t, '(^|[^0-9])' || number || '([^0-9]|$)')) AS on_no_page FROM n JOIN s USING (site) GROUP BY n.site""",
)
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "offsite_in").where("status = 'present'").select("site", "url", "text").distinct()
    b = table(spark, sf_dir, "blocks_in").where("site is not null").select(F.lower("site").alias("site"), "text")
    n = b.select("site", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))).alias("number")).distinct()
    # numbers of the off-site pages: a set to look up instead of a scan of every text
    seen = o.select("site", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number")).distinct().withColumn("seen", F.lit(True))
    r = n.join(o.select("site").distinct(), "site", "left_semi").join(seen, ["site", "number"], "left")
    return r.groupBy("site").agg(F.count("*").alias("numbers"), F.count_if(F.col("seen").isNull()).alias("on_no_page"))


