"""Queries that link, rank and compare: priorities, samples, similarity, lookalikes, cards, stuffing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import dom, markup
from folioforge.functions import text as T
from folioforge.functions.urls import url_path
from folioforge.operators import html_rows
from folioforge.operators.graph import connected_components
from folioforge.operators.near_duplicates import near_duplicate_groups, shingles
from folioforge.operators.page_text import page_text
from folioforge.plans.examples import all_blocks, all_blocks_sql, all_pages, all_pages_sql
from folioforge.plans.html_plans import _PATH
from folioforge.plans.perimeter_plans import _NORM, url_key
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


# ---- priorities and samples

# Paths of process pages, and words in paths of pages with facts and of news.
PROCESS_PATHS = ("/", "/contact", "/checkout", "/search", "/pricing")
FACT_WORDS = ("pricing", "plans", "product", "spec", "docs", "guide", "how-to", "howto", "policy", "terms", "review", "compare")
NEWS_SEGMENTS = ("blog", "news", "press", "announcement")


def page_priority(path):
    """3 for process pages, 2 for pages with facts, 1 for news and dated pages, else 0."""
    low = F.lower(path)
    parts = F.split(low, "/")
    fact = F.lit(False)
    for w in FACT_WORDS:
        fact = fact | low.contains(w)
    news = F.exists(parts, lambda s: s.isin(*NEWS_SEGMENTS) | s.rlike("^(?:19|20)[0-9][0-9]$"))
    process = F.coalesce(F.nullif(F.regexp_replace(low, "/+$", ""), F.lit("")), F.lit("/")).isin(*PROCESS_PATHS)
    return F.when(process, 3).when(fact, 2).when(news, 1).otherwise(0)


_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_PRIORITY = f"""CASE WHEN coalesce(nullif(regexp_replace(lower({_PATH}), '/+$', ''), ''), '/') IN ({_LIST(PROCESS_PATHS)}) THEN 3 WHEN {" OR ".join(f"contains(lower({_PATH}), '{w}')" for w in FACT_WORDS)} THEN 2
    WHEN len(list_filter(string_split(lower({_PATH}), '/'), lambda s: s IN ({_LIST(NEWS_SEGMENTS)}) OR regexp_matches(s, '^(?:19|20)[0-9][0-9]$'))) > 0 THEN 1 ELSE 0 END"""


@query("d02_page_priority", f"WITH {P} SELECT page_id, {_PRIORITY} AS priority FROM p")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", page_priority(url_path("page_url")).alias("priority"))


SAMPLE = 10


def first_ranked(df: DataFrame, by: str, order: list, most: int, salts: int = 64) -> DataFrame:
    """The first ``most`` rows of each group with their ``place``: first within salted parts, then over what these leave, so a hot group is never one task."""
    part = F.pmod(F.xxhash64("page_id"), F.lit(salts))
    near = df.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("_r") <= most)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= most).drop("_part", "_r")


@query("l11_ranked_sample", f"WITH {P}, q AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY {_PRIORITY} DESC, page_ord, page_id) AS place FROM p) SELECT host, page_id, CAST(place AS INTEGER) AS place FROM q WHERE place <= {SAMPLE}")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir, "page_ord").withColumn("rank", page_priority(url_path("page_url")))
    return first_ranked(df, "host", [F.desc("rank"), F.col("page_ord").asc_nulls_last(), F.col("page_id")], SAMPLE).select("host", "page_id", "place")


@query("d07_normalized_keys", f"WITH {P} SELECT {_NORM.format('page_url')} AS key, count(*) AS pages FROM p GROUP BY 1")
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(url_key(F.col("page_url")).alias("key")).agg(F.count("*").alias("pages"))


@query("d12_brand_tokens", f"WITH {P} SELECT split_part(host, '.', 1) AS brand, count(*) AS pages, count(*) FILTER ({_PATH} IN ('', '/')) AS homepages FROM p GROUP BY 1")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.split_part("host", F.lit("."), F.lit(1))
    return pages(spark, sf_dir).groupBy(brand.alias("brand")).agg(F.count("*").alias("pages"), F.count_if(url_path("page_url").isin("", "/")).alias("homepages"))


# ---- similarity

_W = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_SH = "CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) < 2 THEN [array_to_string({0}, ' ')] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: array_to_string({0}[i:i + 1], ' '))) END"


@query(
    "l02_jaccard",
    f"""WITH {B}, w AS (SELECT page_id, block_ord, {_W.format("text")} AS a, {_W.format("nearest_heading")} AS h FROM b WHERE nearest_heading IS NOT NULL), q AS (SELECT page_id, block_ord, {_SH.format("a")} AS s, {_SH.format("h")} AS z FROM w)
    SELECT page_id, block_ord, round(CASE WHEN len(s) = 0 AND len(z) = 0 THEN 1.0 WHEN len(s) = 0 OR len(z) = 0 THEN 0.0 ELSE len(list_intersect(s, z))::DOUBLE / (len(s) + len(z) - len(list_intersect(s, z))) END, 6) AS similarity FROM q""",
)
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block against its heading, by pairs of words; two empty sets are alike, an empty and a full one are not."""
    w = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    df = blocks(spark, sf_dir, "text", "nearest_heading").where("nearest_heading is not null").select("page_id", "block_ord", w("text").alias("a"), w("nearest_heading").alias("h"))
    df = df.select("page_id", "block_ord", shingles("a", 2).alias("s"), shingles("h", 2).alias("z"))
    both = F.size(F.array_intersect("s", "z"))
    j = F.when((F.size("s") == 0) & (F.size("z") == 0), 1.0).when((F.size("s") == 0) | (F.size("z") == 0), 0.0).otherwise(both.cast("double") / (F.size("s") + F.size("z") - both))
    return df.select("page_id", "block_ord", F.round(j, 6).alias("similarity"))


_DW = r"w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w)"


@query(
    "l03_near_duplicate_groups",
    f"""WITH RECURSIVE {_DW}, ex AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh), pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM ex a JOIN ex b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM pr WHERE c >= 0.8 * (na + nb - c)), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT doc_id AS x, doc_id AS y FROM sh UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
    g AS (SELECT x AS doc_id, min(y) AS group_id FROM r GROUP BY x), k AS (SELECT x AS doc_id, count(*) AS links FROM u GROUP BY x)
    SELECT doc_id, group_id, coalesce(links, 0) AS links FROM g LEFT JOIN k USING (doc_id)""",
)
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "l04_name_linkage",
    f"""WITH RECURSIVE x AS (SELECT DISTINCT p_brand || '|' || p_name AS id, p_name AS name, p_brand AS brand FROM part), k AS (SELECT DISTINCT id, name, brand, unnest(string_split(lower(name), ' ')) AS token FROM x),
    e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.brand = b.brand AND a.token = b.token AND a.id < b.id WHERE {T.sql_similarity('a.name', 'b.name')} >= 80), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    r AS (SELECT id AS x, id AS y FROM x UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x) SELECT x AS node, min(y) AS component FROM r GROUP BY x""",
)
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage of a brand's distinct names by their score; names that share a word meet, single names are groups of their own."""
    x = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("|"), "p_name").alias("id"), "p_name", "p_brand").distinct()
    k = x.select("id", "p_name", "p_brand", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("token"))
    a, b = k.select(F.col("id").alias("src"), F.col("p_name").alias("na"), "p_brand", "token"), k.select(F.col("id").alias("dst"), F.col("p_name").alias("nb"), "p_brand", "token")
    e = a.join(b, ["p_brand", "token"]).where((F.col("src") < F.col("dst")) & (T.similarity(F.col("na"), F.col("nb")) >= 80)).select("src", "dst").distinct()
    parts = connected_components(e)
    return x.select(F.col("id").alias("node")).join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Letters that may differ between lookalike names, and the share that must agree.
LOOKALIKE_DISTANCE, LOOKALIKE_SHARE = 3, 0.75
_LOOKALIKES = ("lanternworks.test", "lanternwork.test", "lantemworks.test", "thelanternworks.test", "lampworks.test", "lanternworks.shop.test")


@query(
    "i12_lookalike_hosts",
    f"""WITH {P}, d AS (SELECT DISTINCT split_part(host, '.', 1) AS name, host FROM (SELECT host FROM p UNION ALL SELECT unnest([{_LIST(_LOOKALIKES)}])) WHERE host <> '')
    SELECT a.host AS host_a, b.host AS host_b, levenshtein(a.name, b.name) AS distance FROM d a JOIN d b ON a.host < b.host AND abs(len(a.name) - len(b.name)) <= {LOOKALIKE_DISTANCE}
    WHERE levenshtein(a.name, b.name) <= {LOOKALIKE_DISTANCE} AND 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(len(a.name), len(b.name)) >= {LOOKALIKE_SHARE}""",
)
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names a few letters apart, letters gone or put in too.

    A name cut in one piece more than letters may differ keeps one piece whole,
    moved by as many places at most: names meet by such pieces, not all with all.
    """
    hosts = pages(spark, sf_dir).select("host").unionByName(spark.createDataFrame([(h,) for h in _LOOKALIKES], "host string"))
    d = hosts.where("host <> ''").select(F.split_part("host", F.lit("."), F.lit(1)).alias("name"), "host").distinct()
    k = LOOKALIKE_DISTANCE + 1
    n = F.length("name")
    cut = lambda i, size: F.floor(size * i / F.lit(float(k))).cast("int")
    own = d.withColumn("p", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), n.alias("n"), F.substring("name", cut(i, n) + 1, cut(i + 1, n) - cut(i, n)).alias("t")) for i in range(k)))))
    seen = []
    for i in range(k):
        for by in range(-LOOKALIKE_DISTANCE, LOOKALIKE_DISTANCE + 1):
            size = n + by
            for shift in range(-LOOKALIKE_DISTANCE, LOOKALIKE_DISTANCE + 1):
                at = cut(i, size) + shift
                seen.append(F.when((size > 0) & (at >= 0), F.struct(F.lit(i).alias("i"), size.alias("n"), F.substring("name", at + 1, cut(i + 1, size) - cut(i, size)).alias("t"))))
    met = d.withColumn("p", F.explode(F.array_distinct(F.array_compact(F.array(*seen)))))
    a, b = own.select("p", F.col("name").alias("na"), F.col("host").alias("ha")), met.select("p", F.col("name").alias("nb"), F.col("host").alias("hb"))
    pairs = a.join(b, "p").where(F.col("ha") != F.col("hb")).select(F.least("ha", "hb").alias("host_a"), F.greatest("ha", "hb").alias("host_b"), "na", "nb")
    pairs = pairs.withColumn("distance", F.levenshtein("na", "nb").cast("bigint"))
    ok = (F.col("distance") <= LOOKALIKE_DISTANCE) & (1 - F.col("distance").cast("double") / F.greatest(F.length("na"), F.length("nb")) >= LOOKALIKE_SHARE)
    return pairs.where(ok).select("host_a", "host_b", "distance").distinct()


@query("c19_sequence_ratio")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match ratio (0 to 100) of each block's first 200 signs and its heading, words sorted; matching blocks of signs, as the standard library counts them."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([100.0 * SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    words = lambda c: F.array_join(F.sort_array(F.split(F.lower(F.trim(c)), "[ \t\r\n]+")), " ")
    heads = blocks(spark, sf_dir, "nearest_heading", "text").where("nearest_heading is not null and text is not null and length(text) <= 200")
    return heads.select("page_id", "block_ord", F.round(ratio(words("text"), words("nearest_heading")), 6).alias("score"))


# ---- cards, prose and stuffing

_TAGGED = r"(?is)<(div|li|a|button)[ \t\r\n][^>]*class=[\"']([^\"'>]+)[\"'][^>]*>([^<]*)"


@query(
    "b09_repeated_cards",
    f"""WITH {all_pages_sql("cards")}, t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, {markup.sql_string(_TAGGED)}, 1))) AS tag, unnest(regexp_extract_all(html, {markup.sql_string(_TAGGED)}, 2)) AS class, unnest(regexp_extract_all(html, {markup.sql_string(_TAGGED)}, 3)) AS w FROM x)
    SELECT page_id, tag, class, count(*) AS instances, CAST(max(len(regexp_extract_all(w, '[^ \t\r\n]+'))) AS INTEGER) AS longest FROM t GROUP BY page_id, tag, class HAVING count(*) >= 6 AND max(len(regexp_extract_all(w, '[^ \t\r\n]+'))) <= 15""",
)
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of short elements that one page repeats six times and more, by the text right inside them."""
    g = lambda k: html_rows.all_of(F.col("html"), _TAGGED, k)
    x = all_pages(spark, sf_dir, "cards").select("page_id", F.arrays_zip(g(1).alias("t"), g(2).alias("c"), g(3).alias("w")).alias("all")).dropDuplicates(["page_id"])
    z = x.select("page_id", F.explode("all").alias("x")).select("page_id", F.lower("x.t").alias("tag"), F.col("x.c").alias("class"), F.regexp_count("x.w", F.lit(r"[^ \t\r\n]+")).alias("words"))
    return z.groupBy("page_id", "tag", "class").agg(F.count("*").alias("instances"), F.max("words").alias("longest")).where("instances >= 6 and longest <= 15")


def prose_rows(pages_: DataFrame) -> DataFrame:
    """``page_id, text``: prose of each page, without tables, lists, choices and repeated cards (a table function over the element tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [dom.prose(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages_.select("page_id", "html").mapInArrow(run, "page_id long, text string").dropDuplicates(["page_id"])


@query("b08_prose")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_rows(all_pages(spark, sf_dir, "cards"))


@query("b25_elements")
def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, node, parent, tag, classes, path`` of every element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = {}
                for n, node in enumerate(dom.parse(h)[0].walk()):
                    number[id(node)] = n
                    if node.parent is not None:
                        above = [node.tag]
                        up = node.parent
                        while up is not None and up.tag:
                            above.append(up.tag)
                            up = up.parent
                        rows.append((i, n, number[id(node.parent)], node.tag, node.attrs.get("class", ""), above[::-1]))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "node", "parent", "tag", "classes", "path"])

    p = all_pages(spark, sf_dir, "hidden", "cards").select("page_id", "html")
    return p.mapInArrow(run, "page_id long, node long, parent long, tag string, classes string, path array<string>").dropDuplicates(["page_id", "node"])


# Words that make no keyword.
_COMMON = ("the", "a", "an", "of", "for", "and", "or", "is", "are", "on", "in", "to", "by", "this", "that", "with", "it", "as", "at", "from", "be", "was")
_GRAM = "list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))"


@query(
    "j02_keyword_stuffing",
    f"""WITH {all_blocks_sql("cards")}, t AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_ord) AS t FROM b GROUP BY page_id), wl AS (SELECT page_id, regexp_extract_all(lower(t), {markup.sql_string("[a-z0-9']+")}) AS w FROM t),
    g AS (SELECT page_id, len(w) AS words, unnest({_GRAM}) AS gram FROM wl WHERE len(w) >= 80), c AS (SELECT page_id, gram, count(*) AS times, any_value(words) AS words FROM g WHERE len(list_filter(string_split(gram, ' '), lambda v: v NOT IN ({_LIST(_COMMON)}))) > 0 GROUP BY page_id, gram)
    SELECT page_id, gram, times, round(times * 4.0::DOUBLE / words, 6) AS density FROM c WHERE times >= 5 AND times * 4.0::DOUBLE / words >= 0.08""",
)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words in a row that make up 8 % of a page and more."""
    w = page_text(all_blocks(spark, sf_dir, "cards")).select("page_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 80)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    g = w.select("page_id", F.size("w").alias("words"), F.explode(grams).alias("gram"))
    told = F.exists(F.split("gram", " "), lambda v: ~v.isin(*_COMMON))
    c = g.where(told).groupBy("page_id", "gram").agg(F.count("*").alias("times"), F.first("words").alias("words"))
    d = F.col("times") * F.lit(4.0) / F.col("words")
    return c.where((F.col("times") >= 5) & (d >= 0.08)).select("page_id", "gram", "times", F.round(d, 6).alias("density"))
