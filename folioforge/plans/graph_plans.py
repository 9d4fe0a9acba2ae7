"""Queries over structured data: nodes, references and what they fail to say.

Blocks are parsed as variants; lists and ``@graph`` lists are opened three
levels deep.  A broken block gives no node.  Every fetch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions.urls import page_host
from folioforge.operators import html_rows
from folioforge.operators.graph import connected_components
from folioforge.plans.examples import all_pages, all_pages_sql
from folioforge.plans.shared import Query
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


# Types that say who owns a site, and the fields each type must have.
IDENTITY = ("Organization", "WebSite", "LocalBusiness")
REQUIRED = (("Organization", "name"), ("Organization", "url"), ("LocalBusiness", "name"), ("LocalBusiness", "url"), ("WebSite", "name"), ("WebSite", "url"), ("Product", "name"))
# Properties whose plain address names another thing.
ENTITY_VALUED = ("brand", "publisher", "author", "provider", "seller", "manufacturer", "parentOrganization", "isPartOf", "mainEntity", "itemReviewed")
# Addresses of vocabularies.
VOCABULARIES = (
    "https://schema.org", "http://schema.org", "https://www.w3.org", "http://www.w3.org", "https://purl.org", "http://purl.org", "https://www.wikidata.org", "http://www.wikidata.org",
)
# Sites that vouch for an identity.
AUTHORITIES = ("wikidata.org", "wikipedia.org", "linkedin.com", "crunchbase.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "github.com")
PRODUCT_IDS = ("sku", "mpn", "gtin", "gtin8", "gtin12", "gtin13", "gtin14")


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _opened(c: str) -> Column:
    """The members of a list or of an ``@graph`` list, else the value itself."""
    v = F.col(c)
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.array(v))


def _is(c: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(c), F.lit(kind))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, page_url, host, ord, body, v``; ``v`` is null for a broken block."""
    rows = all_pages(spark, sf_dir, "graphs").select("page_id", "page_url", "host", F.posexplode(html_rows.all_of(F.col("html"), html_rows.JSON_LD, 1)).alias("ord", "body"))
    return rows.dropDuplicates(["page_id", "ord"]).withColumn("v", F.try_parse_json("body"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, page_url, host, idx, id, types, node`` of all objects, in page order."""

    def made() -> DataFrame:
        df = blocks(spark, sf_dir).where("v is not null").select("page_id", "page_url", "host", "ord", "v")
        for k in range(3):
            df = df.select("page_id", "page_url", "host", "ord", *(f"o{i}" for i in range(k)), F.posexplode(_opened("v")).alias(f"o{k}", "v"))
        order = Window.partitionBy("page_id").orderBy("ord", "o0", "o1", "o2")  # a page bounds it
        df = df.where(_is(F.col("v"), "OBJECT")).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
        listed = F.try_variant_get("v", '$["@type"]', "array<variant>")
        names = F.transform(F.filter(listed, lambda t: _is(t, "STRING")), lambda t: F.try_variant_get(t, "$", "string"))
        types = F.coalesce(names, F.array_compact(F.array(_text("v", "@type"))))
        return df.select("page_id", "page_url", "host", "idx", _text("v", "@id").alias("id"), types.alias("types"), F.col("v").alias("node"))

    return once("nodes", made)


def _text(c: str, key: str) -> Column:
    """A field that is a string, else null."""
    return F.when(_is(F.try_variant_get(c, f'$["{key}"]', "variant"), "STRING"), F.try_variant_get(c, f'$["{key}"]', "string"))


_PATTERN = html_rows.JSON_LD.replace("'", "''")
_OPEN = """CASE WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') WHEN json_type({0}, '$."@graph"') = 'ARRAY' THEN json_extract({0}, '$."@graph"[*]') ELSE [{0}] END"""
_STR = """CASE WHEN json_type({0}, '$."{1}"') = 'VARCHAR' THEN json_extract_string({0}, '$."{1}"') END"""
_BLOCKS = f"""{all_pages_sql("graphs")}, bl AS (SELECT page_id, page_url, host, unnest(l) AS body, unnest(range(len(l))) AS ord FROM (SELECT page_id, page_url, host, regexp_extract_all(html, '{_PATTERN}', 1) AS l FROM x)),
    j0 AS (SELECT page_id, page_url, host, ord, CAST(body AS JSON) AS v FROM bl WHERE json_valid(body))"""
_NODES = f"""{_BLOCKS}, j1 AS (SELECT * EXCLUDE (v, a), unnest(a) AS v, unnest(range(len(a))) AS o0 FROM (SELECT *, {_OPEN.format("v")} AS a FROM j0)),
    j2 AS (SELECT * EXCLUDE (v, a), unnest(a) AS v, unnest(range(len(a))) AS o1 FROM (SELECT *, {_OPEN.format("v")} AS a FROM j1)),
    j3 AS (SELECT * EXCLUDE (v, a), unnest(a) AS v, unnest(range(len(a))) AS o2 FROM (SELECT *, {_OPEN.format("v")} AS a FROM j2)),
    nd AS (SELECT page_id, page_url, host, row_number() OVER (PARTITION BY page_id ORDER BY ord, o0, o1, o2) - 1 AS idx, {_STR.format("v", "@id")} AS id,
      CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN list_transform(list_filter(json_extract(v, '$."@type"[*]'), lambda t: json_type(t) = 'VARCHAR'), lambda t: json_extract_string(t, '$')) WHEN json_type(v, '$."@type"') = 'VARCHAR' THEN [json_extract_string(v, '$."@type"')] ELSE []::VARCHAR[] END AS types, v AS node FROM j3 WHERE json_type(v) = 'OBJECT')"""


@query("d13_nodes", f"""WITH {_NODES} SELECT page_id, idx, id, array_to_string(types, ' ') AS types, {_STR.format("node", "name")} AS name FROM nd""")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("page_id", "idx", "id", F.array_join("types", " ").alias("types"), _text("node", "name").alias("name"))


@query("d15_type_sets", f"""WITH {_NODES}, t AS (SELECT page_id, idx, unnest(types) AS type FROM nd) SELECT type, count(DISTINCT page_id) AS pages, count(*) AS nodes FROM t GROUP BY type""")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = nodes(spark, sf_dir).select("page_id", F.explode("types").alias("type"))
    return t.groupBy("type").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("nodes"))


@query("d16_id_index", f"""WITH {_NODES} SELECT page_id, id, max(idx) AS idx, max_by({_STR.format("node", "name")}, CASE WHEN json_type(node, '$.name') = 'VARCHAR' THEN idx END) AS name, count(*) AS given FROM nd WHERE id IS NOT NULL GROUP BY page_id, id""")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last node with an id wins."""
    named = _text("node", "name")
    n = nodes(spark, sf_dir).where("id is not null").withColumn("name", named)
    return n.groupBy("page_id", "id").agg(F.max("idx").alias("idx"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("idx"))).alias("name"), F.count("*").alias("given"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, page_url, host, idx, source, type, property, place, target, bare``: values that name another node.

    An object of an ``@id`` alone, or, for some properties, a plain address or
    fragment; lists are walked, ``place`` is -1 outside them.
    """
    n = nodes(spark, sf_dir)
    props = n.select("page_id", "page_url", "host", "idx", F.col("id").alias("source"), F.coalesce(F.get("types", F.lit(0)), F.lit("Unknown")).alias("type"), F.explode(F.try_variant_get("node", "$", "map<string,variant>")).alias("property", "value"))
    items = F.try_variant_get("value", "$", "array<variant>")
    inside = F.when(items.isNotNull(), F.transform(items, lambda v, i: F.struct(i.cast("long").alias("place"), v.alias("v")))).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.col("value").alias("v"))))
    one = props.withColumn("x", F.explode(inside)).select("*", "x.place", "x.v").drop("x", "value")
    alone = _is(F.col("v"), "OBJECT") & (F.array_join(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")), "|") == "@id")
    named = F.when(alone, _text("v", "@id"))
    plain = F.when(_is(F.col("v"), "STRING") & F.col("property").isin(*ENTITY_VALUED), F.try_variant_get("v", "$", "string"))
    plain = F.when(plain.startswith("#") | plain.contains("://") | plain.startswith("http"), plain)
    out = one.withColumns({"target": F.coalesce(named, plain), "bare": named.isNull()}).where("target is not null")
    return out.select("page_id", "page_url", "host", "idx", "source", "type", "property", "place", "target", "bare")


_REFS = f"""{_NODES}, kv AS (SELECT page_id, page_url, host, idx, id AS source, coalesce(types[1], 'Unknown') AS type, unnest(json_keys(node)) AS property, node FROM nd),
    va AS (SELECT * EXCLUDE (node), json_extract(node, '$."' || property || '"') AS value FROM kv),
    it AS (SELECT * EXCLUDE (value), unnest(CASE WHEN json_type(value) = 'ARRAY' THEN json_extract(value, '$[*]') ELSE [value] END) AS v, unnest(CASE WHEN json_type(value) = 'ARRAY' THEN range(json_array_length(value)::BIGINT) ELSE [-1::BIGINT] END) AS place FROM va),
    tg AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_keys(v) = ['@id'] THEN {_STR.format("v", "@id")} END AS named, CASE WHEN json_type(v) = 'VARCHAR' AND property IN ({_in(ENTITY_VALUED)}) THEN json_extract_string(v, '$') END AS plain FROM it),
    rf AS (SELECT page_id, page_url, host, idx, source, type, property, place, coalesce(named, CASE WHEN plain LIKE '#%' OR contains(plain, '://') OR plain LIKE 'http%' THEN plain END) AS target, named IS NULL AS bare FROM tg)"""
_REF_ROWS = f"{_REFS}, rr AS (SELECT * FROM rf WHERE target IS NOT NULL)"


@query("d17_references", f"WITH {_REF_ROWS} SELECT page_id, idx, source, type, property, place, target, bare FROM rr")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).drop("page_url", "host")


_ORIGIN = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with ``class``: resolved, dangling_fragment, vocabulary, dangling_same_origin or external."""
    ids = nodes(spark, sf_dir).where("id is not null").groupBy("page_id").agg(F.collect_set("id").alias("ids"))
    r = references(spark, sf_dir).join(ids, "page_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    t = F.col("target")
    vocabulary = F.lit(False)
    for v in VOCABULARIES:
        vocabulary = vocabulary | t.startswith(v)
    same = (F.regexp_extract(t, _ORIGIN, 1) == F.regexp_extract("page_url", _ORIGIN, 1)) & (F.regexp_extract(t, _ORIGIN, 1) != "")
    found = F.array_contains("ids", t) | (t.startswith("#") & F.exists("ids", lambda i: F.endswith(i, t)))
    kind = F.when(found, "resolved").when(t.startswith("#"), "dangling_fragment").when(vocabulary, "vocabulary").when(same, "dangling_same_origin").otherwise("external")
    return r.withColumn("class", kind).drop("ids")


_CLASSED = f"""{_REF_ROWS}, ids AS (SELECT page_id, list(DISTINCT id) AS ids FROM nd WHERE id IS NOT NULL GROUP BY page_id),
    cl AS (SELECT rr.*, CASE WHEN list_contains(coalesce(ids, []), target) OR (target LIKE '#%' AND len(list_filter(coalesce(ids, []), lambda i: ends_with(i, target))) > 0) THEN 'resolved' WHEN target LIKE '#%' THEN 'dangling_fragment'
      WHEN {" OR ".join(f"starts_with(target, '{v}')" for v in VOCABULARIES)} THEN 'vocabulary'
      WHEN regexp_extract(target, '{_ORIGIN}', 1) = regexp_extract(page_url, '{_ORIGIN}', 1) AND regexp_extract(target, '{_ORIGIN}', 1) <> '' THEN 'dangling_same_origin' ELSE 'external' END AS class FROM rr LEFT JOIN ids USING (page_id))"""


@query("d18_target_classes", f"WITH {_CLASSED} SELECT page_id, idx, property, place, target, class FROM cl")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("page_id", "idx", "property", "place", "target", "class")


@query(
    "i06_dangling_references",
    f"""WITH {_CLASSED}, bad AS (SELECT DISTINCT page_id FROM bl WHERE NOT json_valid(body)), d AS (SELECT DISTINCT page_id, class, target FROM cl WHERE class IN ('dangling_fragment', 'dangling_same_origin') AND page_id NOT IN (SELECT page_id FROM bad))
    SELECT page_id, class, count(*) AS targets, array_to_string(list(target ORDER BY target)[1:5], ' ') AS shown FROM d GROUP BY page_id, class""",
)
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pages whose blocks all parse."""
    bad = blocks(spark, sf_dir).where("v is null").select("page_id").distinct()
    d = classified(spark, sf_dir).where(F.col("class").isin("dangling_fragment", "dangling_same_origin")).select("page_id", "class", "target").distinct()
    g = d.join(bad, "page_id", "left_anti").groupBy("page_id", "class").agg(F.count("*").alias("targets"), F.array_sort(F.collect_list("target")).alias("t"))
    return g.select("page_id", "class", "targets", F.array_join(F.slice("t", 1, 5), " ").alias("shown"))


_CONTENT = ("Article", "NewsArticle", "BlogPosting", "WebPage", "Product", "Recipe", "Event", "Thing")


@query(
    "i07_orphan_identity",
    f"""WITH {_REF_ROWS}, idn AS (SELECT page_id, id, idx FROM nd WHERE id IS NOT NULL AND list_has_any(types, [{_in(IDENTITY)}])),
    hit AS (SELECT idn.page_id, idn.id FROM idn JOIN rr ON rr.page_id = idn.page_id AND rr.idx <> idn.idx AND (rr.target = idn.id OR (rr.target LIKE '#%' AND ends_with(idn.id, rr.target)))),
    loose AS (SELECT DISTINCT page_id FROM nd WHERE list_has_any(types, [{_in(_CONTENT)}]) AND NOT list_has_any(json_keys(node), ['brand', 'publisher', 'author']))
    SELECT DISTINCT page_id, id FROM idn SEMI JOIN loose USING (page_id) ANTI JOIN hit USING (page_id, id)""",
)
def i07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity nodes nobody refers to, on pages with content that names no owner."""
    n = nodes(spark, sf_dir)
    has = lambda kinds: F.arrays_overlap("types", F.array(*map(F.lit, kinds)))
    own = n.where(F.col("id").isNotNull() & has(IDENTITY)).select("page_id", "id", F.col("idx").alias("at"))
    r = references(spark, sf_dir).select("page_id", "idx", "target")
    meets = (F.col("target") == F.col("id")) | (F.col("target").startswith("#") & F.endswith("id", "target"))
    hit = own.join(r, "page_id").where((F.col("idx") != F.col("at")) & meets).select("page_id", "id")
    keys = F.map_keys(F.try_variant_get("node", "$", "map<string,variant>"))
    loose = n.where(has(_CONTENT) & ~F.arrays_overlap(keys, F.array(*map(F.lit, ("brand", "publisher", "author"))))).select("page_id")
    return own.join(loose, "page_id", "left_semi").join(hit, ["page_id", "id"], "left_anti").select("page_id", "id").distinct()


@query(
    "i08_fragmented_graphs",
    f"""WITH RECURSIVE {_REF_ROWS}, e AS (SELECT rr.page_id, rr.idx AS a, n.idx AS b FROM rr JOIN nd n ON n.page_id = rr.page_id AND (n.id = rr.target OR (rr.target LIKE '#%' AND ends_with(n.id, rr.target))) WHERE n.idx <> rr.idx),
    bd AS (SELECT page_id, a, b FROM e UNION SELECT page_id, b, a FROM e), w AS (SELECT page_id, idx AS a, idx AS b FROM nd UNION SELECT w.page_id, w.a, bd.b FROM w JOIN bd ON bd.page_id = w.page_id AND bd.a = w.b),
    c AS (SELECT page_id, a, min(b) AS comp FROM w GROUP BY page_id, a), s AS (SELECT page_id, comp, count(*) AS n FROM c GROUP BY page_id, comp)
    SELECT page_id, CAST(sum(n) AS BIGINT) AS nodes, count(*) FILTER (n >= 2) AS parts FROM s GROUP BY page_id HAVING sum(n) >= 5 AND count(*) FILTER (n >= 2) >= 2""",
)
def i08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five nodes and more with two or more separate parts; single nodes count as nodes."""
    n = nodes(spark, sf_dir).select("page_id", "idx", "id")
    r = references(spark, sf_dir).select("page_id", F.col("idx").alias("a"), "target")
    meets = (F.col("target") == F.col("id")) | (F.col("target").startswith("#") & F.endswith("id", "target"))
    key = lambda c: F.concat_ws("/", "page_id", c)
    e = r.join(n.where("id is not null"), "page_id").where(meets & (F.col("idx") != F.col("a"))).select(key("a").alias("a"), key("idx").alias("b"))
    parts = connected_components(e, "a", "b")
    per = n.select("page_id", key("idx").alias("node")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    s = per.groupBy("page_id", "part").agg(F.count("*").alias("n"))
    return s.groupBy("page_id").agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") >= 2).alias("parts")).where("nodes >= 5 and parts >= 2")


_ROOT_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?(?:[?#].*)?$"


@query(
    "i01_structured_data",
    f"""WITH {_NODES}, has AS (SELECT DISTINCT page_id FROM bl), bad AS (SELECT DISTINCT page_id FROM bl WHERE NOT json_valid(body)), ident AS (SELECT DISTINCT page_id FROM nd WHERE list_has_any(types, [{_in(IDENTITY)}])),
    req AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in REQUIRED)}) AS v(type, field)), t AS (SELECT page_id, idx, node, unnest(types) AS type FROM nd)
    SELECT page_id, 'no structured data' AS issue, '' AS detail FROM x WHERE page_id NOT IN (SELECT page_id FROM has)
    UNION ALL SELECT page_id, 'malformed', '' FROM bad
    UNION ALL SELECT page_id, 'no identity', '' FROM x WHERE regexp_matches(page_url, '{_ROOT_PATH}') AND page_id IN (SELECT page_id FROM has) AND page_id NOT IN (SELECT page_id FROM ident)
    UNION ALL SELECT DISTINCT page_id, 'missing field', type || '.' || field FROM t JOIN req USING (type) WHERE coalesce(json_extract_string(node, '$."' || field || '"'), '') = ''""",
)
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = all_pages(spark, sf_dir, "graphs").select("page_id", "page_url").distinct()
    b, n = blocks(spark, sf_dir), nodes(spark, sf_dir)
    has = b.select("page_id").distinct()
    row = lambda df, issue, detail=F.lit(""): df.select("page_id", F.lit(issue).alias("issue"), detail.alias("detail")).distinct()
    ident = n.where(F.arrays_overlap("types", F.array(*map(F.lit, IDENTITY)))).select("page_id").distinct()
    home = x.where(F.col("page_url").rlike(_ROOT_PATH)).join(has, "page_id", "left_semi").join(ident, "page_id", "left_anti")
    t = n.select("page_id", "node", F.explode("types").alias("type"))
    missing = F.lit(None).cast("string")
    gaps = []
    for kind, field in REQUIRED:
        gaps.append(F.when((F.col("type") == kind) & (F.coalesce(F.try_variant_get("node", f"$.{field}", "string"), F.lit("")) == ""), F.lit(f"{kind}.{field}")).otherwise(missing))
    lacking = t.select("page_id", F.explode(F.array_compact(F.array(*gaps))).alias("field"))
    return (
        row(x.join(has, "page_id", "left_anti"), "no structured data")
        .unionByName(row(b.where("v is null"), "malformed"))
        .unionByName(row(home, "no identity"))
        .unionByName(row(lacking, "missing field", F.col("field")))
    )


_SAME = "CASE WHEN json_type(node, '$.sameAs') = 'ARRAY' THEN list_transform(json_extract(node, '$.sameAs[*]'), lambda s: json_extract_string(s, '$')) ELSE [json_extract_string(node, '$.sameAs')] END"
_AUTHORITY = "^https?://(?:[^/?#]*[.])?(?:" + "|".join(a.replace(".", "[.]") for a in AUTHORITIES) + ")(?:[/:?#]|$)"


@query("i02_no_authority", f"""WITH {_NODES} SELECT page_id, idx, {_STR.format("node", "name")} AS name FROM nd WHERE list_has_any(types, ['Organization', 'LocalBusiness']) AND len(list_filter({_SAME}, lambda s: regexp_matches(coalesce(s, ''), '{_AUTHORITY}'))) = 0""")
def i02(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.try_variant_get("node", "$.sameAs", "array<string>")
    same = F.coalesce(listed, F.array(_text("node", "sameAs")))
    n = nodes(spark, sf_dir).where(F.arrays_overlap("types", F.array(F.lit("Organization"), F.lit("LocalBusiness"))))
    return n.where(~F.exists(same, lambda s: F.coalesce(s, F.lit("")).rlike(_AUTHORITY))).select("page_id", "idx", _text("node", "name").alias("name"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, idx, price`` of the offers of each node, one or a list."""
    n = nodes(spark, sf_dir)
    many = F.try_variant_get("node", "$.offers", "array<variant>")
    one = F.array(F.try_variant_get("node", "$.offers", "variant"))
    rows = n.select("page_id", "idx", F.explode(F.coalesce(many, one)).alias("o"))
    return rows.select("page_id", "idx", F.try_variant_get("o", "$.price", "string").try_cast("double").alias("price")).where("price is not null")


_OFFERS = f"""{_NODES}, ofr AS (SELECT page_id, idx, unnest(CASE WHEN json_type(node, '$.offers') = 'ARRAY' THEN json_extract(node, '$.offers[*]') ELSE [json_extract(node, '$.offers')] END) AS o FROM nd),
    pr AS (SELECT page_id, idx, TRY_CAST(json_extract_string(o, '$.price') AS DOUBLE) AS price FROM ofr WHERE TRY_CAST(json_extract_string(o, '$.price') AS DOUBLE) IS NOT NULL)"""


@query("d19_offer_prices", f"WITH {_OFFERS} SELECT page_id, idx, price FROM pr")
def d19_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir)


@query(
    "d19_breadcrumbs",
    f"""WITH {_NODES}, bc AS (SELECT page_id, idx, unnest(json_extract(node, '$.itemListElement[*]')) AS e FROM nd WHERE list_contains(types, 'BreadcrumbList'))
    SELECT page_id, idx, string_agg(json_extract_string(e, '$.name'), ' > ' ORDER BY CAST(json_extract_string(e, '$.position') AS BIGINT)) AS path FROM bc GROUP BY page_id, idx""",
)
def d19_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nodes(spark, sf_dir).where(F.array_contains("types", "BreadcrumbList")).select("page_id", "idx", F.explode(F.try_variant_get("node", "$.itemListElement", "array<variant>")).alias("e"))
    one = F.struct(F.try_variant_get("e", "$.position", "bigint").alias("p"), F.try_variant_get("e", "$.name", "string").alias("n"))
    g = e.groupBy("page_id", "idx").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return g.select("page_id", "idx", F.array_join(F.transform("x", lambda s: s["n"]), " > ").alias("path"))


def technical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, field, value`` of the identifiers of products, each once."""
    n = nodes(spark, sf_dir).where(F.array_contains("types", "Product"))
    each = F.array(*(F.struct(F.lit(k).alias("field"), F.try_variant_get("node", f"$.{k}", "string").alias("value")) for k in PRODUCT_IDS))
    return n.select("page_id", F.explode(each).alias("x")).select("page_id", "x.field", "x.value").where("value <> ''").distinct()


_IDS = f"""{_NODES}, ti AS (SELECT DISTINCT page_id, field, value FROM (SELECT page_id, unnest([{_in(PRODUCT_IDS)}]) AS field, unnest([{", ".join(f"json_extract_string(node, '$.{k}')" for k in PRODUCT_IDS)}]) AS value FROM nd WHERE list_contains(types, 'Product')) WHERE value <> '')"""


@query("d20_technical_ids", f"WITH {_IDS} SELECT * FROM ti")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical_ids(spark, sf_dir)


def texts(spark: SparkSession, sf_dir: str, family: str = "graphs") -> DataFrame:
    return all_pages(spark, sf_dir, family).select("page_id", markup.visible_text(F.col("html")).alias("text"))


def _bounded(text: Column, token: Column) -> Column:
    """Whether a text holds a token between signs that are no letters or digits, whatever signs the token is made of."""
    around = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9]", " "), F.lit(" "))
    return around.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(token), r"[^a-z0-9]", " "), F.lit(" ")))


_TEXTS = f"tx AS (SELECT page_id, {markup.sql_visible_text('html')} AS text FROM x)"
_BOUNDED = "contains(' ' || regexp_replace(lower({0}), '[^a-z0-9]', ' ', 'g') || ' ', ' ' || regexp_replace(lower({1}), '[^a-z0-9]', ' ', 'g') || ' ')"


@query("j01_token_not_in_text", f"WITH {_IDS}, {_TEXTS} SELECT page_id, field, value FROM ti JOIN tx USING (page_id) WHERE NOT {_BOUNDED.format('text', 'value')}")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir).join(technical_ids(spark, sf_dir).select("page_id").distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    return technical_ids(spark, sf_dir).join(t, "page_id").where(~_bounded(F.col("text"), F.col("value"))).select("page_id", "field", "value")


_NUMBERS = r"[0-9]+(?:\.[0-9]+)?"


@query("k03_price_not_in_text", f"""WITH {_OFFERS}, {_TEXTS} SELECT page_id, idx, price FROM pr JOIN tx USING (page_id) WHERE len(list_filter(regexp_extract_all(replace(text, ',', ''), '{_NUMBERS}'), lambda n: abs(CAST(n AS DOUBLE) - price) < 0.005)) = 0""")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    t = texts(spark, sf_dir).join(o.select("page_id").distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    numbers = F.transform(F.regexp_extract_all(F.replace("text", F.lit(","), F.lit("")), F.lit(_NUMBERS), F.lit(0)), lambda n: n.cast("double"))
    return o.join(t.select("page_id", numbers.alias("n")), "page_id").where(~F.exists("n", lambda n: F.abs(n - F.col("price")) < 0.005)).select("page_id", "idx", "price")


_OUT_OF = r"([0-9](?:\.[0-9]+)?) out of 5"


@query(
    "i03_rating_mismatch",
    f"""WITH {_NODES}, {_TEXTS}, rt AS (SELECT page_id, idx, TRY_CAST(json_extract_string(node, '$.aggregateRating.ratingValue') AS DOUBLE) AS rating FROM nd), y AS (SELECT page_id, idx, rating, list_transform(regexp_extract_all(lower(text), '{_OUT_OF}', 1), lambda v: CAST(v AS DOUBLE)) AS said FROM rt JOIN tx USING (page_id) WHERE rating IS NOT NULL)
    SELECT page_id, idx, rating, list_min(said) AS lowest, list_max(said) AS highest FROM y WHERE len(said) > 0 AND len(list_filter(said, lambda v: abs(v - rating) <= 0.3)) = 0""",
)
def i03(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nodes(spark, sf_dir).select("page_id", "idx", F.try_variant_get("node", "$.aggregateRating.ratingValue", "string").try_cast("double").alias("rating")).where("rating is not null")
    t = texts(spark, sf_dir).join(r.select("page_id").distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    said = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(_OUT_OF), F.lit(1)), lambda v: v.cast("double"))
    y = r.join(t.select("page_id", said.alias("said")), "page_id").where((F.size("said") > 0) & ~F.exists("said", lambda v: F.abs(v - F.col("rating")) <= 0.3))
    return y.select("page_id", "idx", "rating", F.array_min("said").alias("lowest"), F.array_max("said").alias("highest"))


_FRESH = "last checked|last updated|as of |updated on|prices valid"


@query(
    "k04_no_freshness_signal",
    f"""WITH {_NODES}, {_TEXTS}, av AS (SELECT page_id, bool_or(contains(CAST(node AS VARCHAR), '"availability"')) AS a, bool_or(contains(CAST(node AS VARCHAR), '"dateModified"')) AS d FROM nd GROUP BY page_id)
    SELECT page_id FROM av JOIN tx USING (page_id) WHERE a AND NOT d AND NOT regexp_matches(lower(text), '{_FRESH}')""",
)
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json("node")
    av = nodes(spark, sf_dir).groupBy("page_id").agg(F.bool_or(raw.contains('"availability"')).alias("a"), F.bool_or(raw.contains('"dateModified"')).alias("d")).where("a and not d")
    t = texts(spark, sf_dir).join(av, "page_id", "left_semi").dropDuplicates(["page_id"])
    return av.join(t.where(~F.lower("text").rlike(_FRESH)), "page_id").select("page_id")


__all__ = ["ORACLES", "QUERIES", "classified", "nodes", "offers", "page_host", "references"]
