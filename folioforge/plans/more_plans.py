"""Further queries over pages, their links and their structured data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions import text as T
from folioforge.functions.urls import page_host, template_key, url_path
from folioforge.operators import html_rows, report
from folioforge.operators.graph import connected_components, pagerank
from folioforge.operators.near_duplicates import near_duplicate_groups
from folioforge.plans.html_plans import _FORK, _HEAD, _KEY, _LINKS, _PATH, _UHOST, H, html_pages
from folioforge.plans.perimeter_plans import _LINES, _allowed_sql, _ROOT, root_access
from folioforge.plans.shared import A, B, P, Query, artifacts, blocks, pages
from folioforge.plans.site_plans import _FINDINGS, findings
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


# ---- extraction


@query(
    "b12_all_hrefs",
    r"""WITH {0}, x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)[ ][^>]*href=["'']([^"''>]*)', 1)) AS href FROM h) SELECT href, count(*) AS uses, count(DISTINCT page_id) AS pages FROM x GROUP BY href""".replace("{0}", H),
)
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = html_rows.all_of(F.col("html"), r"""(?i)<(?:a|link)[ ][^>]*href=["']([^"'>]*)""", 1)
    x = html_pages(spark, sf_dir).select("page_id", hrefs.alias("all")).dropDuplicates(["page_id"]).select("page_id", F.explode("all").alias("href"))
    return x.groupBy("href").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))


@query("b15_inline_scripts", r"WITH {0}, x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1)) AS body FROM h) SELECT body, count(DISTINCT page_id) AS pages FROM x GROUP BY body".replace("{0}", H))
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = html_pages(spark, sf_dir).select("page_id", F.explode(html_rows.all_of(F.col("html"), "(?is)<script>(.*?)</script>", 1)).alias("body"))
    return x.groupBy("body").agg(F.countDistinct("page_id").alias("pages"))


@query("b19_heading_texts", f"WITH {_HEAD} SELECT lower(text) AS heading, count(*) AS times, count(DISTINCT page_id) AS pages FROM heads WHERE text <> '' GROUP BY 1")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = html_rows.headings(html_pages(spark, sf_dir)).where("text <> ''").groupBy(F.lower("text").alias("heading"))
    return h.agg(F.count("*").alias("times"), F.countDistinct("page_id").alias("pages"))


@query("b26_link_marked_text", f"WITH {H}, x AS (SELECT page_id, {markup.sql_visible_text('regexp_replace(html, ' + markup.sql_string('(?i)<a ') + ', ' + markup.sql_string('~<a ') + ', ' + markup.sql_string('g') + ')')} AS t FROM h) SELECT page_id, len(regexp_extract_all(t, '~')) AS marks, len(t) AS chars FROM x")
def b26(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = markup.visible_text(F.regexp_replace("html", "(?i)<a ", "~<a "))
    return html_pages(spark, sf_dir).select("page_id", F.regexp_count(t, F.lit("~")).cast("bigint").alias("marks"), F.length(t).cast("bigint").alias("chars")).dropDuplicates(["page_id"])


@query("c16_plain_fragments", f"WITH {_LINKS} SELECT page_id, ord, anchor FROM links WHERE anchor <> '' AND url IS NOT NULL AND regexp_matches(anchor, '[^a-zA-Z ]')")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_rows.links(html_pages(spark, sf_dir)).where((F.col("anchor") != "") & F.col("anchor").rlike("[^a-zA-Z ]")).select("page_id", "ord", "anchor")


@query("c18_tracking_context", r"""WITH x AS (SELECT event_id, 'var ' || event_type || '="' || event_id || '"; tel="+49 30 ' || lpad(CAST(event_id AS VARCHAR), 7, '1') || '"' AS s FROM events),
    y AS (SELECT event_id, s, strpos(s, '+49') AS pos FROM x) SELECT event_id FROM y WHERE regexp_matches(substr(s, greatest(1, pos - 30), pos - greatest(1, pos - 30)), 'view|click')""")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("var "), "event_type", F.lit('="'), "event_id", F.lit('"; tel="+49 30 '), F.lpad(F.col("event_id").cast("string"), 7, "1"), F.lit('"'))
    y = table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("pos", F.instr("s", "+49"))
    start = F.greatest(F.lit(1), F.col("pos") - 30)
    return y.where(F.substring("s", start, F.col("pos") - start).rlike("view|click")).select("event_id")


@query("c24_degraded_severity", """SELECT o_orderkey, CASE s WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END AS severity FROM (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS s FROM orders)""")
def c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.perimeter import degraded

    p = F.left("o_orderpriority", F.lit(1))
    s = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low")
    return table(spark, sf_dir, "orders").select("o_orderkey", degraded(s).alias("severity"))


# ---- addresses and structured data


@query("d04_site_labels", rf"WITH {P} SELECT host, regexp_replace(split_part(host, '.', 1), '[^a-z0-9]+', ' ', 'g') AS label, count(DISTINCT page_url) AS addresses FROM p GROUP BY host")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.regexp_replace(F.split_part("host", F.lit("."), F.lit(1)), "[^a-z0-9]+", " ")
    return pages(spark, sf_dir).groupBy("host").agg(F.first(label).alias("label"), F.countDistinct("page_url").alias("addresses"))


@query("d10_markdown_addresses", rf"WITH {P} SELECT page_id, CASE WHEN regexp_matches({_PATH}, '/$') THEN {_PATH} || 'index.md' ELSE regexp_replace({_PATH}, '\.html?$', '') || '.md' END AS variant FROM p")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = url_path("page_url")
    v = F.when(path.rlike("/$"), F.concat(path, F.lit("index.md"))).otherwise(F.concat(F.regexp_replace(path, r"\.html?$", ""), F.lit(".md")))
    return pages(spark, sf_dir).select("page_id", v.alias("variant"))


_ADDRESS = r"[0-9]{1,5} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane), [A-Z][a-z]+, [A-Z]{2} [0-9]{5}"
_ADDR = "'Visit ' || (s_suppkey % 90 + 1) || ' ' || CASE s_nationkey % 3 WHEN 0 THEN 'Mill Street' WHEN 1 THEN 'Oak Road' ELSE 'Hill' END || ', Town, AB ' || (10000 + s_nationkey) || ' today'"


@query("d21_addresses", f"WITH x AS (SELECT s_suppkey, s_nationkey, regexp_extract({_ADDR}, '{_ADDRESS}', 0) AS address FROM supplier) SELECT s_suppkey, address FROM x WHERE address <> ''")
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("s_suppkey", "address")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    street = F.when(n % 3 == 0, "Mill Street").when(n % 3 == 1, "Oak Road").otherwise("Hill")
    t = F.concat(F.lit("Visit "), F.col("s_suppkey") % 90 + 1, F.lit(" "), street, F.lit(", Town, AB "), n + 10000, F.lit(" today"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.regexp_extract(t, _ADDRESS, 0).alias("address")).where("address <> ''")


@query(
    "i10_address_inconsistency",
    f"""WITH RECURSIVE x AS (SELECT s_nationkey AS site, regexp_extract({_ADDR}, '{_ADDRESS}', 0) AS address FROM supplier), a AS (SELECT DISTINCT site, address, site || '|' || address AS id FROM x WHERE address <> ''),
    e AS (SELECT p.id AS x, q.id AS y FROM a p JOIN a q ON p.site = q.site AND p.id < q.id WHERE {T.sql_similarity('p.address', 'q.address')} >= 98), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT id AS x, id AS y FROM a UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), c AS (SELECT x, min(y) AS k FROM r GROUP BY x)
    SELECT site, count(*) AS addresses, count(DISTINCT k) AS clusters FROM c JOIN a ON a.id = c.x GROUP BY site HAVING count(*) >= 2 AND count(DISTINCT k) >= 2""",
)
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of a site's address: distinct ones meet, not their suppliers."""
    site = F.col("s_nationkey").alias("site")
    a = addresses(spark, sf_dir).select(site, "address").distinct().withColumn("id", F.concat("site", F.lit("|"), "address"))
    p = a.select("site", F.col("id").alias("src"), F.col("address").alias("pa"))
    q = a.select("site", F.col("id").alias("dst"), F.col("address").alias("qa"))
    e = p.join(q, "site").where((F.col("src") < F.col("dst")) & (T.similarity(F.col("pa"), F.col("qa")) >= 98)).select("src", "dst")
    c = connected_components(e).select(F.col("node").alias("id"), "component")
    j = a.join(c, "id", "left").withColumn("k", F.coalesce("component", "id"))
    g = j.groupBy("site").agg(F.count("*").alias("addresses"), F.countDistinct("k").alias("clusters"))
    return g.where("addresses >= 2 and clusters >= 2")


_KW = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]+')), lambda x: len(x) > 4)"


@query(
    "i13_heading_without_echo",
    f"""WITH {_HEAD}, {B}, t AS (SELECT page_id, string_agg(text, ' ') AS t, sum(word_count) AS words FROM b WHERE word_count >= 15 GROUP BY page_id),
    f AS (SELECT page_id, min_by(text, ord) AS h1 FROM heads WHERE level = 1 GROUP BY page_id) SELECT page_id, h1 FROM f JOIN t USING (page_id) WHERE words >= 50 AND len({_KW.format('h1')}) > 0 AND NOT list_has_any({_KW.format('h1')}, {_KW.format('t')})""",
)
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))), lambda x: F.length(x) > 4)
    t = blocks(spark, sf_dir, "text", "word_count").where("word_count >= 15").groupBy("page_id").agg(F.flatten(F.collect_list(kw(F.col("text")))).alias("w"), F.sum("word_count").alias("n"))
    h = html_rows.first_h1(html_pages(spark, sf_dir)).withColumn("k", kw(F.col("h1"))).where(F.size("k") > 0)
    return h.join(t.where("n >= 50"), "page_id").where(~F.arrays_overlap("k", "w")).select("page_id", "h1")


# ---- detectors over several pages


@query(
    "f08_stratum_near_duplicates",
    f"""WITH RECURSIVE {P}, {B}, t AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_ord) AS t FROM b WHERE word_count >= 25 GROUP BY page_id),
    w AS (SELECT page_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM t), sh AS (SELECT page_id, len(w) AS n, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w WHERE len(w) > 0),
    ex AS (SELECT page_id, len(s) AS n, unnest(s) AS g FROM sh), pr AS (SELECT a.page_id AS x, b2.page_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b2.n) AS nb FROM ex a JOIN ex b2 ON a.g = b2.g AND a.page_id < b2.page_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM pr WHERE c >= 0.7 * (na + nb - c)), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT page_id AS x, page_id AS y FROM sh UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
    SELECT x AS page_id, min(y) AS group_id FROM r GROUP BY x""",
)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.page_text import page_text

    t = page_text(blocks(spark, sf_dir, "text", "word_count").where("word_count >= 25"))
    some = t.where(F.lower("text").rlike("[a-z0-9]"))
    return near_duplicate_groups(some, "page_id", "text", 5, 0.7).select("page_id", "group_id")


@query(
    "g05_authority_starved",
    """WITH RECURSIVE nodes AS (SELECT DISTINCT p_brand AS node FROM part), ed AS (SELECT a.p_brand AS src, b.p_brand AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size > b.p_size),
    o AS (SELECT src, count(*) AS outs FROM ed GROUP BY src), m AS (SELECT src, dst, count(*)::DOUBLE / any_value(outs) AS part FROM ed JOIN o USING (src) GROUP BY src, dst), c AS (SELECT count(*) AS n FROM nodes),
    r AS (SELECT 0 AS it, node, 1.0::DOUBLE / n AS rank FROM nodes, c UNION ALL
      SELECT it + 1, node, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(given, 0) FROM (SELECT any_value(x.it) AS it, nodes.node AS node, any_value(c.n) AS n,
        sum(CASE WHEN x.node NOT IN (SELECT src FROM o) THEN x.rank ELSE 0 END) AS lost, sum(x.rank * coalesce(m.part, 0)) AS given
        FROM nodes CROSS JOIN c CROSS JOIN r x LEFT JOIN m ON m.src = x.node AND m.dst = nodes.node WHERE x.it < 20 GROUP BY nodes.node) q), f AS (SELECT node, rank FROM r WHERE it = 20)
    SELECT node FROM f WHERE rank < 0.9 * (SELECT avg(rank) FROM f)""",
)
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("dst"), F.col("p_size").alias("z"))
    e = p.join(b, "p_partkey").where("p_size > z").select(F.col("p_brand").alias("src"), "dst")
    r = pagerank(p.select(F.col("p_brand").alias("node")).distinct(), e)
    mean = r.agg(F.avg("rank")).first()[0]
    return r.where(F.col("rank") < 0.9 * mean).select("node")


_WALL = "we use cookies|wir setzen cookies|usamos cookies|this site stores|accept all cookies"
_DISMISS = "change your choice|reject|decline|auswahl|cambiar la elecci|alterar a op"


@query(
    "h08_walls",
    f"""WITH {B} SELECT page_id, block_ord, regexp_matches(lower(text), '{_DISMISS}') AS dismissable FROM b WHERE regexp_matches(lower(text), '{_WALL}')""",
)
def h08(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return blocks(spark, sf_dir, "text").where(low.rlike(_WALL)).select("page_id", "block_ord", low.rlike(_DISMISS).alias("dismissable"))


@query(
    "h08_spaced_hits",
    f"""WITH {B}, x AS (SELECT page_id, list(start_char ORDER BY start_char) AS s FROM b WHERE word_count >= 10 GROUP BY page_id)
    SELECT page_id, CAST(list_reduce(s, lambda a, v: CASE WHEN v - a >= 1000 THEN v ELSE a END) AS INTEGER) AS last_kept FROM x""",
)
def h08_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy thinning: a hit counts if it lies 1,000 characters after the last that counted."""
    s = F.sort_array(F.collect_list("start_char"))
    x = blocks(spark, sf_dir, "start_char", "word_count").where("word_count >= 10").groupBy("page_id").agg(s.alias("s"))
    kept = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), F.element_at("s", 1), lambda a, v: F.when(v - a >= 1000, v).otherwise(a))
    return x.select("page_id", kept.alias("last_kept"))


@query(
    "h12_link_scent",
    f"""WITH {_LINKS} SELECT page_id, ord, anchor, round({T.sql_similarity('anchor', "regexp_replace(regexp_replace(href, '^.*/', ''), '[^a-zA-Z]+', ' ', 'g')")}, 4) AS score FROM links
    WHERE url IS NOT NULL AND regexp_matches(anchor, '^[A-Za-z ]+$') AND regexp_matches(href, '^/[a-z]+$')""",
)
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_rows.links(html_pages(spark, sf_dir)).where(F.col("anchor").rlike("^[A-Za-z ]+$") & F.col("href").rlike("^/[a-z]+$"))
    last = F.regexp_replace(F.regexp_replace("href", "^.*/", ""), "[^a-zA-Z]+", " ")
    return rows.select("page_id", "ord", "anchor", F.round(T.similarity(F.col("anchor"), last), 4).alias("score"))


@query(
    "j07_interred_facts",
    f"""WITH {B}, t AS (SELECT page_id, max(end_char) AS total, sum(word_count) AS words FROM b GROUP BY page_id), x AS (SELECT page_id, start_char::DOUBLE / total AS pos, len(regexp_extract_all(text, '[0-9]+')) AS facts FROM b JOIN t USING (page_id) WHERE words >= 300 AND total > 0)
    SELECT page_id, CAST(sum(facts) AS BIGINT) AS facts, CAST(coalesce(sum(facts) FILTER (pos > 0.25 AND pos < 0.75), 0) AS BIGINT) AS mid FROM x GROUP BY page_id HAVING coalesce(sum(facts) FILTER (pos > 0.25 AND pos < 0.75), 0) >= 3 AND coalesce(sum(facts) FILTER (pos > 0.25 AND pos < 0.75), 0) >= 0.4 * sum(facts)""",
)
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id")
    x = blocks(spark, sf_dir, "text", "start_char", "end_char", "word_count").withColumns({"total": F.max("end_char").over(w), "words": F.sum("word_count").over(w)})
    x = x.where("words >= 300 and total > 0").withColumn("pos", F.col("start_char").cast("double") / F.col("total")).withColumn("n", F.regexp_count("text", F.lit("[0-9]+")))
    g = x.groupBy("page_id").agg(F.sum("n").alias("facts"), F.sum(F.when((F.col("pos") > 0.25) & (F.col("pos") < 0.75), F.col("n")).otherwise(0)).alias("mid"))
    return g.where("mid >= 3 and mid >= 0.4 * facts")


# ---- site files again, and the report


@query(
    "e20_unknown_checks",
    f"""WITH {A} SELECT site, kind AS unknown, 'could not be fetched' AS reason FROM a WHERE status = 'unavailable'""",
)
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).where("status = 'unavailable'").select("site", F.col("kind").alias("unknown"), F.lit("could not be fetched").alias("reason"))


@query(
    "e23_site_audit",
    f"""WITH {_allowed_sql(_ROOT)}, f AS (SELECT site, 'agents blocked' AS finding, count(*) AS n FROM allowed WHERE NOT allowed GROUP BY site UNION ALL SELECT site, 'missing ' || kind, count(*) FROM a WHERE status = 'absent' GROUP BY site, kind UNION ALL SELECT site, 'unknown ' || kind, count(*) FROM a WHERE status = 'unavailable' GROUP BY site, kind) SELECT * FROM f""",
)
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = root_access(spark, sf_dir).where("not allowed").groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit("agents blocked").alias("finding"), "n")
    state = {"absent": "missing ", "unavailable": "unknown "}
    rest = artifacts(spark, sf_dir).where(F.col("status").isin(*state))
    label = F.concat(F.when(F.col("status") == "absent", "missing ").otherwise("unknown "), "kind")
    return blocked.unionByName(rest.groupBy("site", label.alias("finding")).agg(F.count("*").alias("n")))


@query("e01_sitemaps_in_robots", rf"""WITH {_LINES} SELECT site, trim(regexp_extract(line, '^(?i)[ \t]*sitemap[ \t]*:(.*)$', 1)) AS url FROM lx WHERE regexp_matches(line, '^(?i)[ \t]*sitemap[ \t]*:')""")
def e01_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = artifacts(spark, sf_dir, "robots").where("status = 'present'")
    lines = r.select("site", F.explode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line"))
    url = F.trim(F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"(?i)^[ \t]*sitemap[ \t]*:(.*)$", 1))
    return lines.where(F.col("line").rlike(r"(?i)^[ \t]*sitemap[ \t]*:")).select("site", url.alias("url"))


@query("l08_strata", f"WITH {P} SELECT host, {_KEY} AS template, count(*) AS size, count(DISTINCT {_FORK}) AS addresses FROM p GROUP BY 1, 2")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.functions.urls import fork_key

    df = pages(spark, sf_dir).withColumns({"template": template_key(url_path("page_url")), "f": fork_key(F.col("page_url"))})
    return df.groupBy("host", "template").agg(F.count("*").alias("size"), F.countDistinct("f").alias("addresses"))


@query("m06_floor", f"WITH {_FINDINGS} SELECT id, severity, first_page AS page_url FROM mg WHERE track = 'defect'")
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.merge(findings(spark, sf_dir)).where("track = 'defect'").select("id", "severity", F.col("first_page").alias("page_url"))


@query(
    "m09_composed",
    f"""WITH {_FINDINGS}, {A}, u AS (SELECT 'unknown-' || kind AS id, count(DISTINCT site) AS pages FROM a WHERE status = 'unavailable' GROUP BY kind) SELECT id, 'finding' AS row_kind, pages FROM mg UNION ALL SELECT id, 'unknown', pages FROM u""",
)
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = report.merge(findings(spark, sf_dir)).select("id", F.lit("finding").alias("row_kind"), "pages")
    u = artifacts(spark, sf_dir).where("status = 'unavailable'").groupBy(F.concat(F.lit("unknown-"), "kind").alias("id")).agg(F.countDistinct("site").alias("pages"))
    return f.unionByName(u.select("id", F.lit("unknown").alias("row_kind"), "pages"))


@query(
    "m13_judged",
    f"""WITH {_FINDINGS}, j AS (SELECT DISTINCT id, page_id, page_id % 3 = 0 AS confirmed FROM fd WHERE page_id % 2 = 0) SELECT fd.id, count(*) AS pending, (SELECT count(*) FROM j WHERE j.id = fd.id AND confirmed) AS confirmed FROM fd WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.id = fd.id AND j.page_id = fd.page_id) GROUP BY fd.id""",
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements replace pending items; here even pages are judged and every third of them confirmed."""
    f = findings(spark, sf_dir).select("id", "page_id")
    j = f.where("page_id % 2 = 0").distinct()
    pending = f.join(j, ["id", "page_id"], "left_anti").groupBy("id").agg(F.count("*").alias("pending"))
    confirmed = j.where("page_id % 3 = 0").groupBy("id").agg(F.count("*").alias("confirmed"))
    return pending.join(confirmed, "id", "left").select("id", "pending", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))
