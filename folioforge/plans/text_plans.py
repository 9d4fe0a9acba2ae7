"""Queries over block texts: tokens, sentences, values, signals of content quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.shared import B, P, Query, blocks, pages

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir, "text")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, block_ord, n, sentence``."""
    df = texts(spark, sf_dir).where("text is not null")
    return df.select("page_id", "block_ord", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).where("sentence <> ''")


_S = f"""{B}, sl AS (SELECT page_id, block_ord, {T.sql_sentences('text')} AS l FROM b WHERE text IS NOT NULL),
sx AS (SELECT page_id, block_ord, l, unnest(range(1, len(l) + 1)) AS i FROM sl),
s AS (SELECT page_id, block_ord, CAST(i - 1 AS INTEGER) AS n, l[i] AS sentence FROM sx WHERE l[i] <> '')"""


@query("b27_sentences", f"WITH {_S} SELECT * FROM s")
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_rows(spark, sf_dir)


@query("c01_collapse", rf"WITH {B} SELECT page_id, block_ord, trim(regexp_replace(nearest_heading, '[ \t\r\n\f]+', ' ', 'g')) AS heading FROM b")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir, "nearest_heading").select("page_id", "block_ord", T.collapse(F.col("nearest_heading")).alias("heading"))


@query(
    "c02_position",
    f"""WITH {B}, t AS (SELECT page_id, max(end_char) AS total FROM b GROUP BY page_id)
    SELECT page_id, block_ord, round(CASE WHEN total <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, start_char * 1.0::DOUBLE / total)) END, 6) AS position FROM b JOIN t USING (page_id)""",
)
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = blocks(spark, sf_dir, "start_char", "end_char")
    total = F.max("end_char").over(Window.partitionBy("page_id"))
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("start_char").cast("double") / F.col("total")))
    return df.withColumn("total", total).select(
        "page_id", "block_ord", F.round(F.when(F.col("total") <= 0, 0.0).otherwise(place), 6).alias("position")
    )


_WORDS = {k: p.replace("'", "''") for k, p in T.WORD_PATTERNS.items()}


@query(
    "c04_tokenizers",
    f"WITH {B} SELECT page_id, block_ord, " + ", ".join(f"CAST(len(regexp_extract_all(lower(text), '{p}')) AS INTEGER) AS {k}" for k, p in _WORDS.items()) + " FROM b",
)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("page_id", "block_ord", *(F.size(T.words(F.col("text"), k)).alias(k) for k in T.WORD_PATTERNS))


_KW = """list_filter(list_distinct(regexp_extract_all(lower(nearest_heading), '[a-z]+')), lambda x: len(x) > 2 AND x NOT IN ({}))""".format(
    ", ".join(f"'{w}'" for w in T.LABEL_STOPWORDS)
)


@query(
    "c05_keywords",
    f"""WITH {B}, h AS (SELECT DISTINCT nearest_heading FROM b WHERE nearest_heading IS NOT NULL), k AS (SELECT nearest_heading, {_KW} AS w FROM h)
    SELECT nearest_heading AS heading, array_to_string(list_sort(list_distinct(list_concat(w, list_transform(list_filter(w, lambda x: ends_with(x, 's') AND len(x) > 3), lambda x: left(x, len(x) - 1))))), ' ') AS words FROM k""",
)
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = blocks(spark, sf_dir, "nearest_heading").select("nearest_heading").where("nearest_heading is not null").distinct()
    return df.select(F.col("nearest_heading").alias("heading"), F.array_join(T.keywords(F.col("nearest_heading")), " ").alias("words"))


@query(
    "c06_units",
    rf"""WITH {B}, x AS (SELECT lower(regexp_extract(text, '([0-9]+) ([A-Za-z]+)', 2)) AS unit FROM b)
    SELECT CASE WHEN ends_with(unit, 's') AND len(unit) > 2 THEN left(unit, len(unit) - 1) ELSE unit END AS unit, count(*) AS blocks FROM x WHERE unit <> '' GROUP BY 1""",
)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.lower(F.regexp_extract("text", "([0-9]+) ([A-Za-z]+)", 2))
    df = texts(spark, sf_dir).select(unit.alias("unit")).where("unit <> ''")
    return df.groupBy(T.singular_unit(F.col("unit")).alias("unit")).agg(F.count("*").alias("blocks"))


@query(
    "c07_syllables",
    f"""WITH {B}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM b)
    SELECT word, CAST({T.sql_syllables('word')} AS INTEGER) AS syllables FROM w""",
)
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = texts(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.syllables(F.col("word")).cast("int").alias("syllables"))


@query(
    "c08_span_gap",
    f"""WITH {B}, x AS (SELECT page_id, block_ord, start_char, end_char, lag(start_char, 2) OVER w AS s, lag(end_char, 2) OVER w AS e FROM b WINDOW w AS (PARTITION BY page_id ORDER BY block_ord))
    SELECT page_id, block_ord, greatest(0, start_char - e, s - end_char) AS gap FROM x WHERE s IS NOT NULL""",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("block_ord")
    df = blocks(spark, sf_dir, "start_char", "end_char").withColumns({"s": F.lag("start_char", 2).over(w), "e": F.lag("end_char", 2).over(w)})
    return df.where("s is not null").select("page_id", "block_ord", T.span_gap(F.col("s"), F.col("e"), F.col("start_char"), F.col("end_char")).alias("gap"))


@query(
    "c11_numbers_survive",
    f"""WITH {B}, {P}, h AS (SELECT page_id, html FROM p WHERE html IS NOT NULL), n AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM b)
    SELECT page_id, count(*) AS numbers, count(*) FILTER (regexp_matches(html, '(^|[^0-9])' || number || '([^0-9]|$)')) AS surviving FROM n JOIN h USING (page_id) GROUP BY page_id""",
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = texts(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number")).distinct()
    h = pages(spark, sf_dir, "html").where("html is not null").select("page_id", "html")
    there = F.expr("html rlike concat('(^|[^0-9])', number, '([^0-9]|$)')")
    return n.join(h, "page_id").groupBy("page_id").agg(F.count("*").alias("numbers"), F.count_if(there).alias("surviving"))


@query("c12_typed_values", f"WITH {B}, x AS (SELECT page_id, block_ord, {T.sql_typed_value('text')} AS value FROM b) SELECT * FROM x WHERE value IS NOT NULL")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("page_id", "block_ord", T.typed_value(F.col("text")).alias("value")).where("value is not null")


@query(
    "c14_slug_and_hash",
    f"""WITH {B}, h AS (SELECT DISTINCT nearest_heading AS heading FROM b WHERE nearest_heading IS NOT NULL)
    SELECT heading, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, left(sha256(heading), 8) AS short_hash FROM h""",
)
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = blocks(spark, sf_dir, "nearest_heading").select(F.col("nearest_heading").alias("heading")).where("heading is not null").distinct()
    return h.select("heading", T.slug(F.col("heading")).alias("slug"), T.short_hash(F.col("heading")).alias("short_hash"))


@query(
    "c15_capped_lists",
    f"""WITH {B}, l AS (SELECT page_id, list(DISTINCT nearest_heading ORDER BY nearest_heading) FILTER (nearest_heading IS NOT NULL) AS a FROM b GROUP BY page_id)
    SELECT page_id, array_to_string(a[1:3], ' | ') AS shown, CAST(len(a) AS INTEGER) AS true_count FROM l WHERE a IS NOT NULL""",
)
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = blocks(spark, sf_dir, "nearest_heading").where("nearest_heading is not null").groupBy("page_id").agg(F.sort_array(F.collect_set("nearest_heading")).alias("a"))
    return g.select("page_id", F.array_join(F.slice("a", 1, 3), " | ").alias("shown"), F.size("a").alias("true_count"))


@query(
    "c19_heading_similarity",
    f"""WITH {B}, x AS (SELECT page_id, min(nearest_heading) AS a, max(nearest_heading) AS z FROM b WHERE nearest_heading IS NOT NULL GROUP BY page_id)
    SELECT page_id, round({T.sql_similarity('a', 'z')}, 4) AS score FROM x WHERE a <> z""",
)
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = blocks(spark, sf_dir, "nearest_heading").where("nearest_heading is not null").groupBy("page_id").agg(F.min("nearest_heading").alias("a"), F.max("nearest_heading").alias("z"))
    return x.where("a <> z").select("page_id", F.round(T.similarity(F.col("a"), F.col("z")), 4).alias("score"))


@query(
    "c21_shouted_lines",
    f"""WITH {B} SELECT page_id, block_ord, text FROM b WHERE len(string_split(text, ' ')) <= 6 AND upper(text) = text AND regexp_matches(text, '[A-Za-z]')""",
)
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = F.size(F.split("text", " ")) <= 6
    return texts(spark, sf_dir).where(few & (F.upper("text") == F.col("text")) & F.col("text").rlike("[A-Za-z]")).select("page_id", "block_ord", "text")


# Phrases of consent notices.
_COOKIE = "cookies?|traceurs|consent|privacy matters|small files on your device"


@query(
    "c22_after_cookie_notice",
    f"""WITH {B}, c AS (SELECT page_id, max(block_ord) FILTER (block_ord < 10 AND regexp_matches(lower(text), '{_COOKIE}')) AS last FROM b GROUP BY page_id)
    SELECT page_id, block_ord FROM b JOIN c USING (page_id) WHERE block_ord > coalesce(last, -1)""",
)
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = texts(spark, sf_dir)
    hit = F.when((F.col("block_ord") < 10) & F.lower("text").rlike(_COOKIE), F.col("block_ord"))
    last = F.max(hit).over(Window.partitionBy("page_id"))
    return df.withColumn("last", F.coalesce(last, F.lit(-1))).where("block_ord > last").select("page_id", "block_ord")


@query(
    "c23_cache_directives",
    f"""WITH {P}, e AS (SELECT page_id, unnest(map_entries(headers)) AS e FROM p), d AS (SELECT page_id, list_transform(string_split(e.value, ','), lambda x: lower(trim(x))) AS l FROM e WHERE lower(e.key) IN ('cache-control', 'x-robots-tag'))
    SELECT DISTINCT page_id, unnest(l) AS directive FROM d""",
)
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pages(spark, sf_dir, "headers").select("page_id", F.explode(F.map_entries("headers")).alias("e")).where(F.lower("e.key").isin("cache-control", "x-robots-tag"))
    return e.select("page_id", F.explode(F.transform(F.split("e.value", ","), lambda x: F.lower(F.trim(x)))).alias("directive")).distinct()


# ---- content quality

# Unfilled fields of three template languages.
_TEMPLATES = (r"\{\{ *[A-Za-z_][A-Za-z0-9_.-]{0,40} *\}\}", r"\{%-? *[a-z_]+[^%\n]{0,60}-?%\}", r"<%[-=]?[^%\n]{1,80}%>")


@query(
    "f01_template_leak",
    f"""WITH {B}, t AS (SELECT page_id, unnest(list_concat(list_concat(regexp_extract_all(text, '{_TEMPLATES[0]}'), regexp_extract_all(text, '{_TEMPLATES[1]}')), regexp_extract_all(text, '{_TEMPLATES[2]}'))) AS token FROM b),
    g AS (SELECT page_id, list(DISTINCT token ORDER BY token) AS a FROM t GROUP BY page_id)
    SELECT page_id, CAST(len(a) AS INTEGER) AS tokens, array_to_string(a[1:8], ' ') AS shown FROM g""",
)
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in _TEMPLATES))
    g = texts(spark, sf_dir).select("page_id", F.explode(all_).alias("token")).groupBy("page_id").agg(F.sort_array(F.collect_set("token")).alias("a"))
    return g.select("page_id", F.size("a").alias("tokens"), F.array_join(F.slice("a", 1, 8), " ").alias("shown"))


@query(
    "f06_low_readability",
    f"""WITH {B}, r AS (SELECT page_id, text, count(*) OVER (PARTITION BY page_id, text) AS k FROM b), {_S.replace(B + ", ", "").replace("FROM b WHERE text IS NOT NULL", "FROM (SELECT b.* FROM b JOIN (SELECT DISTINCT page_id, text FROM r WHERE k < 3) USING (page_id, text))")},
    w AS (SELECT page_id, regexp_extract_all(lower(sentence), '[a-z]+') AS w FROM s), ok AS (SELECT page_id, list_filter(w, lambda x: len(x) <= 30) AS w FROM w WHERE len(w) BETWEEN 1 AND 60),
    c AS (SELECT page_id, count(*) AS sentences, sum(len(w)) AS words, sum(list_sum(list_transform(w, lambda word: {T.sql_syllables('word')}))) AS syllables FROM ok GROUP BY page_id)
    SELECT page_id, sentences, CAST(words AS BIGINT) AS words, CAST(syllables AS BIGINT) AS syllables, round(206.835 - 1.015 * (words::DOUBLE / sentences) - 84.6 * (syllables::DOUBLE / words), 4) AS flesch
    FROM c WHERE sentences >= 5 AND words >= 100 AND 206.835 - 1.015 * (words::DOUBLE / sentences) - 84.6 * (syllables::DOUBLE / words) < 30""",
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.count("*").over(Window.partitionBy("page_id", "text"))
    df = texts(spark, sf_dir).withColumn("k", again).where("k < 3 and text is not null")
    s = df.select("page_id", F.explode(T.sentences(F.col("text"))).alias("s")).where("s <> ''")
    w = s.select("page_id", F.regexp_extract_all(F.lower("s"), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w").between(1, 60))
    w = w.withColumn("w", F.filter("w", lambda x: F.length(x) <= 30))
    per = w.groupBy("page_id").agg(
        F.count("*").alias("sentences"), F.sum(F.size("w")).alias("words"),
        F.sum(F.aggregate(F.transform("w", T.syllables), F.lit(0), lambda a, x: a + x)).alias("syllables"),
    )
    flesch = 206.835 - 1.015 * (F.col("words").cast("double") / F.col("sentences")) - 84.6 * (F.col("syllables").cast("double") / F.col("words"))
    return per.withColumn("f", flesch).where("sentences >= 5 and words >= 100 and f < 30").select("page_id", "sentences", "words", "syllables", F.round("f", 4).alias("flesch"))


# ---- citability and retrieval readiness


_GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"


def _word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.page_text import page_text

    return page_text(texts(spark, sf_dir)).select("page_id", T.words(F.col("text")).alias("w"))


def _grams(n: int):
    start = F.sequence(F.lit(1), F.size("w") - (n - 1))
    return F.when(F.size("w") >= n, F.transform(start, lambda i: F.array_join(F.slice("w", i, n), " ")))


_T = f"""{B}, t AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_ord) AS t FROM b GROUP BY page_id),
wl AS (SELECT page_id, regexp_extract_all(lower(t), '{_WORDS['alnum_apostrophe']}') AS w FROM t)"""


@query(
    "j09_dominant_trigram",
    f"""WITH {_T}, g AS (SELECT page_id, unnest({_GRAMS.format(n=3)}) AS gram FROM wl), c AS (SELECT page_id, gram, count(*) AS times FROM g GROUP BY page_id, gram HAVING count(*) >= 3)
    SELECT page_id, gram, times FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY times DESC, gram) AS r FROM c) WHERE r = 1""",
)
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _word_lists(spark, sf_dir).select("page_id", F.explode(_grams(3)).alias("gram"))
    c = g.groupBy("page_id", "gram").agg(F.count("*").alias("times")).where("times >= 3")
    top = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("times"), "gram"))
    return c.withColumn("r", top).where("r = 1").drop("r")


@query(
    "j08_context_dependent",
    f"""WITH {B}, x AS (SELECT page_id, regexp_matches(lower(text), '^(?:it|they|he|she|them|its|their|this|that|these|those)[^a-z]|^the (?:company|product|platform|service|tool|team)[^a-z]') AS dependent FROM b WHERE word_count >= 25)
    SELECT page_id, count(*) AS judged, count(*) FILTER (dependent) AS dependent FROM x GROUP BY page_id HAVING count(*) >= 4 AND count(*) FILTER (dependent) > 0""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    pat = "^(?:it|they|he|she|them|its|their|this|that|these|those)[^a-z]|^the (?:company|product|platform|service|tool|team)[^a-z]"
    df = blocks(spark, sf_dir, "text", "word_count").where("word_count >= 25").withColumn("d", F.lower("text").rlike(pat))
    return df.groupBy("page_id").agg(F.count("*").alias("judged"), F.count_if("d").alias("dependent")).where("judged >= 4 and dependent > 0")


@query(
    "j11_terminology",
    f"""WITH {_T} SELECT page_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_filter(w, lambda x: len(x) >= 9)) AS INTEGER) AS long_words FROM wl WHERE len(w) > 0""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_lists(spark, sf_dir).where(F.size("w") > 0).select("page_id", F.size("w").alias("words"), F.size(F.filter("w", lambda x: F.length(x) >= 9)).alias("long_words"))


@query(
    "j12_long_paragraphs",
    f"""WITH {_S} SELECT page_id, block_ord, count(*) AS sentences, any_value(word_count) AS words FROM s JOIN b USING (page_id, block_ord) WHERE word_count >= 80 GROUP BY page_id, block_ord HAVING count(*) >= 5""",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = blocks(spark, sf_dir, "text", "word_count").where("word_count >= 80")
    n = F.size(F.filter(T.sentences(F.col("text")), lambda s: s != "")).cast("bigint")
    return df.select("page_id", "block_ord", n.alias("sentences"), F.col("word_count").alias("words")).where("sentences >= 5")


@query(
    "j06_load_bearing_values",
    rf"""WITH {B}, v AS (SELECT page_id, block_ord, unnest(regexp_extract_all(text, '[0-9]+(?:[.,/][0-9]+)*(?: ?%| [a-z]+)?')) AS value FROM b),
    f AS (SELECT page_id, value, min(block_ord) AS first_block, count(*) AS times FROM v GROUP BY page_id, value)
    SELECT page_id, value, first_block, times FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_block, value) AS r FROM f) WHERE r <= 20""",
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    pat = "[0-9]+(?:[.,/][0-9]+)*(?: ?%| [a-z]+)?"
    v = texts(spark, sf_dir).select("page_id", "block_ord", F.explode(F.regexp_extract_all("text", F.lit(pat), F.lit(0))).alias("value"))
    f = v.groupBy("page_id", "value").agg(F.min("block_ord").alias("first_block"), F.count("*").alias("times"))
    r = F.row_number().over(Window.partitionBy("page_id").orderBy("first_block", "value"))
    return f.withColumn("r", r).where("r <= 20").drop("r")


@query(
    "i11_brand_mentions",
    f"""WITH {B}, {P}, x AS (SELECT page_id, block_ord, text, split_part(host, '.', 1) AS brand FROM b JOIN p USING (page_id))
    SELECT page_id, min(block_ord) AS block_ord, count(*) AS mentions FROM x WHERE brand <> '' AND contains(lower(text), brand) GROUP BY page_id""",
)
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = pages(spark, sf_dir).select("page_id", F.split_part("host", F.lit("."), F.lit(1)).alias("brand")).where("brand <> ''")
    x = texts(spark, sf_dir).join(brand, "page_id").where(F.lower("text").contains(F.col("brand")))
    return x.groupBy("page_id").agg(F.min("block_ord").alias("block_ord"), F.count("*").alias("mentions"))


