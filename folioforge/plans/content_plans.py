"""Detectors over what pages say: dates, numbers, facts, hedges, claims, quotes.

Sentences come from the blocks of all pages and of the examples; lines are the
blocks themselves and the labelled pairs of tables and definition lists.  Phrases
match between signs that are no letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import markup, signals
from folioforge.functions import text as T
from folioforge.functions.urls import page_host, template_key, url_path
from folioforge.operators import html_rows
from folioforge.plans.audit_plans import anchors, anchors_sql
from folioforge.plans.examples import all_blocks, all_blocks_sql, all_pages, all_pages_sql
from folioforge.plans.html_plans import _KEY
from folioforge.plans.shared import SITE, Query
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


# Phrases that name a time only by the day they were written.
RELATIVE = (
    "last year", "next year", "this year", "last month", "next month", "this month", "last week", "next week", "this week", "last quarter", "next quarter", "this quarter",
    "recently", "currently", "as of now", "as of today", "earlier this year", "later this year",
    "a few years ago", "a few months ago", "a few weeks ago", "several years ago", "several months ago", "several weeks ago",
)
# Verbs of claims that such a time makes stale.
CLAIM_VERBS = (
    "updated", "update", "updates", "changed", "change", "changes", "launched", "launch", "released", "release", "increased", "increase", "decreased", "decrease", "reduced", "reduce",
    "opened", "open", "closed", "close", "expired", "expires", "expire", "started", "start", "starts", "ended", "ends", "end", "added", "add", "removed", "remove",
    "moved", "move", "revised", "revise", "published", "publish", "modified", "modify", "raised", "raise", "lowered", "lower",
)
# Words that say how far a number goes.
QUALIFIERS = (
    "up to", "starting at", "from", "average", "approximately", "about", "depending on", "varies", "based on", "per", "each", "for the", "in the",
    "minimum", "maximum", "at least", "no more than", "typical", "estimated", "roughly",
)
# Words that make an average no plain one.
WEIGHTINGS = ("weighted", "excluding", "filtered", "verified only", "adjusted", "normalized", "normalised")
# Hedges.
HEDGES = (
    "it depends", "there is no one-size-fits-all", "there is no one size fits all", "everyone's needs are different", "the answer varies", "there is no clear answer",
    "it varies from person to person", "there is no simple answer", "it's complicated", "it is complicated", "results may vary", "your mileage may vary",
)
# Vague sizes, and what is measured.
VAGUE = ("large", "small", "medium", "significant", "substantial", "compact", "lightweight", "heavy-duty", "a lot", "quite a bit", "fairly big", "pretty big")
MEASURED = (
    "size", "weight", "weighs", "weigh", "dimensions", "capacity", "length", "width", "height", "diameter", "volume", "speed", "storage", "distance", "duration", "load", "measures", "measure", "holds", "spans",
)
# Phrases of advertising.
MARKETING = (
    "don't miss", "buy now", "sign up today", "award-winning", "best-in-class", "industry-leading", "limited time", "act now", "shop now", "join thousands of", "you won't regret it", "our customers love",
    "risk-free", "money-back guarantee",
)
# Phrases that fill.
FILLERS = (
    "in today's fast-paced world", "in today's digital age", "at the end of the day", "it goes without saying", "needless to say", "in this day and age", "when all is said and done",
    "in the grand scheme of things", "last but not least", "it is important to note that", "it should be noted that", "without further ado", "in the world of", "when it comes to", "the fact of the matter is",
)
# Superlatives.
SUPERLATIVES = (
    "the best", "the fastest", "the leading", "industry-leading", "industry leading", "world-class", "world class", "most trusted", "number one", "the number 1", "the largest", "the most popular",
    "cutting-edge", "cutting edge", "state-of-the-art", "state of the art", "unmatched", "unrivaled", "unrivalled", "best-in-class", "best in class", "the most advanced",
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def either(phrases: tuple[str, ...]) -> str:
    """Pattern of any of the phrases between signs that are no letters or digits, over lower case."""
    return "(?:^|[^a-z0-9])(?:" + "|".join(p.replace(".", r"\.") for p in phrases) + ")(?:[^a-z0-9]|$)"


_MONTH = "(?:" + "|".join(m.lower() for m in MONTHS) + "|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)"
_ABSOLUTE = rf"(?:(?:19|20)[0-9][0-9]|{_MONTH}\.? [0-9]{{1,2}}|[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}})"
_REL = "(?:" + "|".join(RELATIVE) + ")"
_DATED = rf"{_REL}.{{0,30}}{_ABSOLUTE}|{_ABSOLUTE}.{{0,30}}{_REL}"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, block_ord, n, sentence``."""

    def made() -> DataFrame:
        return all_blocks(spark, sf_dir).select("page_id", "block_ord", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).where("sentence <> ''")

    return once("sentences", made)


_S = f"""{all_blocks_sql()}, sl AS (SELECT page_id, block_ord, {T.sql_sentences("text")} AS l FROM b), sx AS (SELECT page_id, block_ord, l, unnest(range(1, len(l) + 1)) AS i FROM sl),
    s AS (SELECT page_id, block_ord, CAST(i - 1 AS INTEGER) AS n, l[i] AS sentence FROM sx WHERE l[i] <> '')"""
_FITS = "len(sentence) BETWEEN 20 AND 400"


def fits() -> Column:
    """Sentences of 20 to 400 signs."""
    return F.length("sentence").between(20, 400)


@query(
    "f02_relative_dates",
    f"""WITH {_S} SELECT page_id, block_ord, n, sentence FROM s WHERE {_FITS} AND len(string_split(sentence, ' ')) >= 4 AND regexp_matches(lower(sentence), {lit(either(RELATIVE))})
    AND regexp_matches(lower(sentence), {lit(either(CLAIM_VERBS))}) AND NOT regexp_matches(lower(sentence), {lit(_DATED)})""",
)
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims dated by the day they were written, with no date of the calendar within 30 signs."""
    low = F.lower("sentence")
    ok = fits() & (F.size(F.split("sentence", " ")) >= 4) & low.rlike(either(RELATIVE)) & low.rlike(either(CLAIM_VERBS)) & ~low.rlike(_DATED)
    return sentences(spark, sf_dir).where(ok)


# ---- lines and labels

_PAIRS = tuple(rf"(?is)<{a}(?:[ \t\r\n][^>]*)?>((?:[^<]|<[^/])*?)</{a}[ \t\r\n]*>[ \t\r\n]*<{b}(?:[ \t\r\n][^>]*)?>((?:[^<]|<[^/])*?)</{b}[ \t\r\n]*>" for a, b in (("dt", "dd"), ("th", "td")))
#: The same for Java, which goes one call deeper at each sign of a repeated choice and runs out of stack in cells of some
#: thousand signs.  A cell ends at the next ``</`` or not at all, so a run that gives nothing back holds the same text.
_DEEP_PAIRS = tuple(p.replace("((?:[^<]|<[^/])*?)", "((?:[^<]++|<[^/])*+)") for p in _PAIRS)


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, label, value`` of neighbouring cells and definitions, each once."""

    def made() -> DataFrame:
        pages = all_pages(spark, sf_dir, "facts")
        out = None
        for pattern in _DEEP_PAIRS:
            two = F.arrays_zip(html_rows.all_of(F.col("html"), pattern, 1).alias("a"), html_rows.all_of(F.col("html"), pattern, 2).alias("b"))
            rows = pages.select("page_id", F.explode(two).alias("x")).select("page_id", markup.plain(F.col("x.a")).alias("label"), markup.plain(F.col("x.b")).alias("value"))
            out = rows if out is None else out.unionByName(rows)
        return out.where("label <> '' and value <> ''").distinct()

    return once("labelled_pairs", made)


_PAIR_ROWS = f"""{all_pages_sql("facts")}, pz AS ({" UNION ALL ".join(f"SELECT page_id, unnest(regexp_extract_all(html, {lit(p)}, 1)) AS a, unnest(regexp_extract_all(html, {lit(p)}, 2)) AS v FROM x" for p in _PAIRS)}),
    pairs AS (SELECT DISTINCT page_id, {markup.sql_plain("a")} AS label, {markup.sql_plain("v")} AS value FROM pz WHERE {markup.sql_plain("a")} <> '' AND {markup.sql_plain("v")} <> '')"""


@query("b20_labelled_pairs", f"WITH {_PAIR_ROWS} SELECT * FROM pairs")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_pairs(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, ord, line``: the blocks, then the labelled pairs as lines."""
    own = all_blocks(spark, sf_dir).select("page_id", F.col("block_ord").cast("long").alias("ord"), F.col("text").alias("line"))
    return own.unionByName(labelled_pairs(spark, sf_dir).select("page_id", F.lit(1 << 40).alias("ord"), F.concat_ws(": ", "label", "value").alias("line")))


_LINES = f"""{all_blocks_sql()}, {_PAIR_ROWS}, ln AS (SELECT page_id, block_ord::BIGINT AS ord, text AS line FROM b UNION ALL SELECT page_id, {1 << 40}, label || ': ' || value FROM pairs)"""
_METRIC = r"^[ \t]*([A-Za-z][A-Za-z0-9 /()-]{2,40}?): *[$]?(-?[0-9]+(?:\.[0-9]+)?) *([A-Za-z%°]{0,15})"
_METRIC_ANY = r"^[ \t]*([A-Za-z][A-Za-z0-9 /()-]{2,40}?): *[^0-9]*(-?[0-9]+(?:\.[0-9]+)?) *([A-Za-z%°]{0,15})"
_UNIT = "CASE WHEN ends_with({0}, 's') AND len({0}) > 2 THEN left({0}, len({0}) - 1) ELSE {0} END"


@query("f05_label_lines", f"WITH {_LINES} SELECT page_id, line FROM ln WHERE ord = {1 << 40}")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(F.col("ord") == 1 << 40).select("page_id", "line")


@query(
    "f03_scope_ambiguous",
    f"""WITH {_LINES}, m AS (SELECT page_id, lower(trim(regexp_extract(line, {lit(_METRIC_ANY)}, 1))) AS label, CAST(regexp_extract(line, {lit(_METRIC_ANY)}, 2) AS DOUBLE) AS value, lower(regexp_extract(line, {lit(_METRIC_ANY)}, 3)) AS u,
      regexp_matches(lower(line), {lit(either(QUALIFIERS))}) AS q, regexp_matches(line, {lit(_METRIC)}) AS plain FROM ln WHERE regexp_matches(line, {lit(_METRIC_ANY)}))
    SELECT page_id, label, {_UNIT.format("u")} AS unit, count(DISTINCT value) AS readings, min(value) AS lowest, max(value) AS highest FROM m WHERE len(string_split(label, ' ')) >= 2 GROUP BY page_id, label, {_UNIT.format("u")}
    HAVING count(DISTINCT CASE WHEN plain THEN value END) >= 2 AND NOT bool_or(q)""",
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label and unit with several values on a page, and no line that says how far they go."""
    g = lambda k: F.regexp_extract("line", _METRIC_ANY, k)
    m = lines(spark, sf_dir).where(F.col("line").rlike(_METRIC_ANY)).select(
        "page_id", F.lower(F.trim(g(1))).alias("label"), T.singular_unit(F.lower(g(3))).alias("unit"), g(2).cast("double").alias("value"), F.lower("line").rlike(either(QUALIFIERS)).alias("q"), F.col("line").rlike(_METRIC).alias("plain")
    )
    r = m.where(F.size(F.split("label", " ")) >= 2).groupBy("page_id", "label", "unit").agg(
        F.count_distinct("value").alias("readings"), F.count_distinct(F.when(F.col("plain"), F.col("value"))).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.bool_or("q").alias("q")
    )
    return r.where("n >= 2 and not q").drop("n", "q")


_LIST = r"^[ \t]*([A-Za-z][A-Za-z0-9 /()-]{2,40}?): *(-?[0-9]+(?:\.[0-9]+)?(?: *, *-?[0-9]+(?:\.[0-9]+)?){2,}) *$"
#: The same for Java, in a list of any length; a number ends before the next comma or the end, so nothing need be given back.
_DEEP_LIST = _LIST.replace("){2,})", "){2,}+)")
_MEAN = r"(?:^|[^a-z])(?:average|avg|mean)(?:[^a-z0-9-][^.\n]{0,40}?)?(-?[0-9]+(?:\.[0-9]+)?)"


@query(
    "f04_computed_stat",
    f"""WITH {_LINES}, sl AS (SELECT page_id, unnest({T.sql_sentences("text")}) AS sentence FROM b), li AS (SELECT page_id, trim(regexp_extract(line, {lit(_LIST)}, 1)) AS label, list_transform(string_split(regexp_extract(line, {lit(_LIST)}, 2), ','), lambda v: CAST(trim(v) AS DOUBLE)) AS v FROM ln WHERE regexp_matches(line, {lit(_LIST)})),
    cl AS (SELECT DISTINCT page_id, sentence, CAST(regexp_extract(lower(sentence), {lit(_MEAN)}, 1) AS DOUBLE) AS claimed FROM sl WHERE regexp_matches(lower(sentence), {lit(_MEAN)}) AND NOT regexp_matches(lower(sentence), {lit(either(WEIGHTINGS))})),
    j AS (SELECT page_id, label, sentence, claimed, list_avg(v) AS mean, len(v) AS numbers FROM li JOIN cl USING (page_id) WHERE list_has_any(list_filter(regexp_extract_all(lower(label), '[a-z]+'), lambda w: len(w) > 2), regexp_extract_all(lower(sentence), '[a-z]+')))
    SELECT page_id, label, sentence, claimed, numbers, round(mean, 6) AS mean FROM j WHERE abs(claimed - mean) > greatest(0.15, 0.05 * abs(mean))""",
)
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages that a page claims and its own list of numbers does not give."""
    numbers = F.transform(F.split(F.regexp_extract("line", _DEEP_LIST, 2), ","), lambda v: F.trim(v).cast("double"))
    li = lines(spark, sf_dir).where(F.col("line").rlike(_DEEP_LIST)).select("page_id", F.trim(F.regexp_extract("line", _DEEP_LIST, 1)).alias("label"), numbers.alias("v"))
    low = F.lower("sentence")
    cl = sentences(spark, sf_dir).where(low.rlike(_MEAN) & ~low.rlike(either(WEIGHTINGS))).select("page_id", "sentence", F.regexp_extract(low, _MEAN, 1).cast("double").alias("claimed")).distinct()
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    j = li.join(cl, "page_id").where(F.arrays_overlap(F.filter(words("label"), lambda w: F.length(w) > 2), words("sentence")))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    j = j.withColumns({"mean": mean, "numbers": F.size("v").cast("long")}).where(F.abs(F.col("claimed") - F.col("mean")) > F.greatest(F.lit(0.15), 0.05 * F.abs("mean")))
    return j.select("page_id", "label", "sentence", "claimed", "numbers", F.round("mean", 6).alias("mean"))


_FACT = r"^([A-Za-z][A-Za-z0-9 /()-]{1,40}): +(.+)$"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, label, value`` of lines whose value has a type; the last of a label counts."""
    ln = lines(spark, sf_dir).where(F.col("line").rlike(_FACT)).select("page_id", "ord", F.lower(F.trim(F.regexp_extract("line", _FACT, 1))).alias("label"), T.typed_value(F.regexp_extract("line", _FACT, 2)).alias("value"))
    return ln.where("value is not null and value <> ''").groupBy("page_id", "label").agg(F.max(F.struct("ord", "value")).alias("m")).select("page_id", "label", "m.value")


_FACTS = f"""{_LINES}, fl AS (SELECT page_id, ord, lower(trim(regexp_extract(line, {lit(_FACT)}, 1))) AS label, regexp_extract(line, {lit(_FACT)}, 2) AS v FROM ln WHERE regexp_matches(line, {lit(_FACT)})),
    ft AS (SELECT page_id, ord, label, {T.sql_typed_value("v")} AS value FROM fl), facts AS (SELECT page_id, label, max({{'ord': ord, 'value': value}}).value AS value FROM ft WHERE value IS NOT NULL AND value <> '' GROUP BY page_id, label)"""


@query("d22_labelled_facts", f"WITH {_FACTS} SELECT * FROM facts")
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)


@query(
    "f09_fact_collisions",
    f"""WITH {_FACTS}, st AS (SELECT DISTINCT page_id, host, {_KEY} AS template FROM x) SELECT host, template, label, count(DISTINCT page_id) AS pages, count(DISTINCT value) AS readings FROM facts JOIN st USING (page_id) GROUP BY ALL HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT value) >= 2""",
)
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on three pages of one kind and more whose values differ."""
    st = all_pages(spark, sf_dir, "facts").select("page_id", "host", template_key(url_path("page_url")).alias("template")).distinct()
    g = facts(spark, sf_dir).join(st, "page_id").groupBy("host", "template", "label").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("value").alias("readings"))
    return g.where("pages >= 3 and readings >= 2")


_ANY_DATE = r"[A-Z][a-z]+ [0-9]{1,2},? [0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
_DATE = r"""CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(v AS DATE) WHEN regexp_matches(v, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN CAST(try_strptime(v, '%m/%d/%Y') AS DATE)
    WHEN regexp_matches(v, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$') THEN CAST(try_strptime(v, '%m/%d/%y') AS DATE) WHEN regexp_matches(v, '^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$') THEN CAST(try_strptime(v, '%B %d %Y') AS DATE) WHEN regexp_matches(v, '^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$') THEN CAST(try_strptime(v, '%b %d %Y') AS DATE) END"""


@query("c13_claimed_dates", f"WITH {all_blocks_sql()}, r AS (SELECT page_id, unnest(regexp_extract_all(text, {lit(_ANY_DATE)})) AS raw FROM b), v AS (SELECT page_id, raw, replace(raw, ',', '') AS v FROM r) SELECT page_id, raw, CAST({_DATE} AS VARCHAR) AS parsed, count(*) AS times FROM v GROUP BY ALL")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = all_blocks(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("text", F.lit(_ANY_DATE), F.lit(0))).alias("raw"))
    return r.groupBy("page_id", "raw", signals.parse_claimed_date(F.col("raw")).cast("string").alias("parsed")).agg(F.count("*").alias("times"))


# ---- hedges, vague words, advertising


@query(
    "f11_hedges_with_context",
    f"""WITH {_S}, q AS (SELECT page_id, block_ord, n, sentence, lag(sentence) OVER (PARTITION BY page_id ORDER BY block_ord, n) AS preceding FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY block_ord, n) AS r FROM q WHERE {_FITS} AND regexp_matches(lower(sentence), {lit(either(HEDGES))}))
    SELECT page_id, block_ord, n, sentence, coalesce(preceding, '') AS preceding FROM h WHERE r <= 15""",
)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen hedges of a page with the sentences before them."""
    w = Window.partitionBy("page_id").orderBy("block_ord", "n")
    q = sentences(spark, sf_dir).withColumn("preceding", F.coalesce(F.lag("sentence").over(w), F.lit("")))
    h = q.where(fits() & F.lower("sentence").rlike(either(HEDGES))).withColumn("r", F.row_number().over(w))
    return h.where("r <= 15").drop("r")


@query("f12_vague_measures", f"WITH {_S} SELECT page_id, block_ord, n, sentence FROM s WHERE {_FITS} AND NOT regexp_matches(sentence, '[0-9]') AND regexp_matches(lower(sentence), {lit(either(VAGUE))}) AND regexp_matches(lower(sentence), {lit(either(MEASURED))})")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("sentence")
    return sentences(spark, sf_dir).where(fits() & ~F.col("sentence").rlike("[0-9]") & low.rlike(either(VAGUE)) & low.rlike(either(MEASURED)))


_STEP = r"^(?:step *[0-9]+ *[:.)]?|[0-9]{1,2}[.)]) *[^ ]"


@query("f13_steps_with_marketing", f"WITH {all_blocks_sql()} SELECT page_id, block_ord, text FROM b WHERE regexp_matches(lower(text), {lit(_STEP)}) AND regexp_matches(lower(text), {lit(either(MARKETING))})")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return all_blocks(spark, sf_dir).where(low.rlike(_STEP) & low.rlike(either(MARKETING))).select("page_id", "block_ord", "text")


_FILL = "(?:" + "|".join(FILLERS) + ")"


@query(
    "f14_filler_density",
    f"""WITH {all_blocks_sql()}, y AS (SELECT page_id, sum(len(regexp_extract_all(lower(text), {lit(_FILL)}))) AS phrases, sum(word_count) AS words FROM b GROUP BY page_id)
    SELECT page_id, CAST(phrases AS BIGINT) AS phrases, CAST(words AS BIGINT) AS words, round(phrases::DOUBLE / words, 6) AS density FROM y WHERE words > 0 AND phrases > 0""",
)
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = all_blocks(spark, sf_dir).groupBy("page_id").agg(F.sum(F.regexp_count(F.lower("text"), F.lit(_FILL))).alias("phrases"), F.sum("word_count").alias("words"))
    return g.where("words > 0 and phrases > 0").withColumn("density", F.round(F.col("phrases").cast("double") / F.col("words"), 6))


@query(
    "f10_opening_words",
    f"""WITH {all_blocks_sql()}, t AS (SELECT page_id, string_agg(text, ' ' ORDER BY block_ord) AS t FROM b GROUP BY page_id), o AS (SELECT page_id, array_to_string(string_split(t, ' ')[1:150], ' ') AS opening FROM t)
    SELECT page_id, opening, len(regexp_extract_all(lower(opening), {lit("(?:" + "|".join(MARKETING) + ")")})) AS marketing FROM o""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators.page_text import page_text

    o = page_text(all_blocks(spark, sf_dir)).select("page_id", F.array_join(F.slice(F.split("text", " "), 1, 150), " ").alias("opening"))
    return o.withColumn("marketing", F.regexp_count(F.lower("opening"), F.lit("(?:" + "|".join(MARKETING) + ")")).cast("long"))


# ---- claims and their sources

_QUOTES = r'["“”]'


@query(
    "g03_superlatives",
    f"""WITH {_S}, {all_pages_sql("facts")}, hd AS (SELECT DISTINCT page_id, lower({markup.sql_plain("t")}) AS head FROM (SELECT page_id, unnest(regexp_extract_all(html, {lit(html_rows.HEADING)}, 2)) AS t FROM x))
    SELECT page_id, block_ord, n, sentence FROM s WHERE {_FITS} AND NOT regexp_matches(sentence, '[0-9]') AND NOT ends_with(sentence, '?') AND NOT regexp_matches(sentence, {lit(_QUOTES)}) AND regexp_matches(lower(sentence), {lit(either(SUPERLATIVES))})
    AND (page_id, lower(sentence)) NOT IN (SELECT page_id, head FROM hd)""",
)
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superlatives with no number, outside quotes, questions and headings."""
    s = F.col("sentence")
    ok = fits() & ~s.rlike("[0-9]") & ~s.endswith("?") & ~s.rlike(_QUOTES) & F.lower(s).rlike(either(SUPERLATIVES))
    heads = all_pages(spark, sf_dir, "facts").select("page_id", F.explode(html_rows.all_of(F.col("html"), html_rows.HEADING, 2)).alias("t")).select("page_id", F.lower(markup.plain(F.col("t"))).alias("low")).distinct()
    return sentences(spark, sf_dir).where(ok).withColumn("low", F.lower(s)).join(heads, ["page_id", "low"], "left_anti").drop("low")


_MARKED = "(?is)<a[ \t\r\n][^>]*>(.*?)</a[ \t\r\n]*>"


@query(
    "g07_claims_without_link",
    f"""WITH {_S}, {all_pages_sql("facts")}, mk AS (SELECT DISTINCT page_id, {markup.sql_plain("t")} AS label FROM (SELECT page_id, unnest(regexp_extract_all({markup.sql_without_hidden("html")}, {lit(_MARKED)}, 1)) AS t FROM x)), lb AS (SELECT page_id, list(label) AS labels FROM mk WHERE len(label) > 3 GROUP BY page_id)
    SELECT page_id, block_ord, n, sentence FROM s LEFT JOIN lb USING (page_id) WHERE {_FITS} AND regexp_matches(sentence, '[0-9]') AND len(list_filter(coalesce(labels, []), lambda k: contains(sentence, k))) = 0""",
)
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a number and no link of the page in them."""
    p = all_pages(spark, sf_dir, "facts").select("page_id", F.explode(html_rows.all_of(markup.without_hidden(F.col("html")), _MARKED, 1)).alias("t"))
    labels = p.select("page_id", markup.plain(F.col("t")).alias("label")).where(F.length("label") > 3).groupBy("page_id").agg(F.collect_set("label").alias("labels"))
    s = sentences(spark, sf_dir).where(fits() & F.col("sentence").rlike("[0-9]")).join(labels, "page_id", "left")
    return s.where(~F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda k: F.contains("sentence", k))).drop("labels")


_QUOTED = '["“][^"”]{20,1000}["”]'


@query("c20_quoted_spans", f"WITH {all_blocks_sql()}, q AS (SELECT page_id, block_ord, unnest(regexp_extract_all(text, {lit(_QUOTED)})) AS span FROM b) SELECT page_id, block_ord, span, regexp_matches(lower(span), {lit(either(('i', 'my', 'we', 'our', 'me')))}) AS first_person FROM q")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted spans of 20 to 1,000 signs (what both pattern languages count), and whether one speaks of itself."""
    q = all_blocks(spark, sf_dir).select("page_id", "block_ord", F.explode(F.regexp_extract_all("text", F.lit(_QUOTED), F.lit(0))).alias("span"))
    return q.withColumn("first_person", F.lower("span").rlike(either(("i", "my", "we", "our", "me"))))


_NO_NOUN = "^(?:" + "|".join((*MONTHS, *DAYS, "I")) + ")$"


@query(
    "c03_proper_nouns",
    f"""WITH {_S}, w AS (SELECT page_id, block_ord, n, list_transform(string_split(sentence, ' ')[2:], lambda v: regexp_replace(v, '[^A-Za-z]', '', 'g')) AS w FROM s)
    SELECT page_id, block_ord, n, array_to_string(list_filter(w, lambda v: regexp_matches(v, '^[A-Z][a-z]+$') AND NOT regexp_matches(v, {lit(_NO_NOUN)})), ' ') AS nouns FROM w WHERE len(list_filter(w, lambda v: regexp_matches(v, '^[A-Z][a-z]+$') AND NOT regexp_matches(v, {lit(_NO_NOUN)}))) > 0""",
)
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a capital inside a sentence, names of months and days left out."""
    rest = F.slice(F.split("sentence", " "), 2, F.greatest(F.size(F.split("sentence", " ")) - 1, F.lit(1)))
    plain = F.transform(rest, lambda v: F.regexp_replace(v, "[^A-Za-z]", ""))
    nouns = F.filter(plain, lambda v: v.rlike("^[A-Z][a-z]+$") & ~v.rlike(_NO_NOUN))
    return sentences(spark, sf_dir).select("page_id", "block_ord", "n", nouns.alias("w")).where(F.size("w") > 0).select("page_id", "block_ord", "n", F.array_join("w", " ").alias("nouns"))


_UHOST = SITE.replace("page_url", "url")


@query(
    "g02_no_outside_source",
    f"""WITH {anchors_sql("citations")}, {all_blocks_sql("citations")}, w AS (SELECT page_id, sum(word_count) AS words FROM b GROUP BY page_id HAVING sum(word_count) >= 500), o AS (SELECT DISTINCT page_id FROM an WHERE url IS NOT NULL AND {_UHOST} <> host)
    SELECT page_id, CAST(words AS BIGINT) AS words FROM w WHERE page_id NOT IN (SELECT page_id FROM o)""",
)
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = all_blocks(spark, sf_dir, "citations").groupBy("page_id").agg(F.sum("word_count").alias("words")).where("words >= 500")
    out = anchors(spark, sf_dir, "citations").where(F.col("url").isNotNull() & (page_host("url") != F.col("host"))).select("page_id")
    return w.join(out, "page_id", "left_anti")


# Path segments and title words of pages that compare.
COMPARING = ("vs", "versus", "alternative", "alternatives", "alternative-to", "alternatives-to", "compared-to", "comparison")
COMPARING_TITLES = ("vs", "versus", "alternative to", "alternatives to", "compared to", "comparison")
_TITLE = markup.sql_plain(f"regexp_extract(html, {lit(html_rows.TITLE)}, 1)")


def compares(path: Column, title: Column) -> Column:
    """Whether a page compares, by a part of its path or by its title."""
    parts = F.split(F.regexp_replace(F.lower(path), "[^a-z-]", "/"), "/")
    by_path = F.exists(parts, lambda s: s.isin(*COMPARING) | s.rlike("(?:^|-)(?:vs|versus|comparison)(?:-|$)"))
    return by_path | F.lower(title).rlike(either(COMPARING_TITLES))


@query(
    "g06_no_comparison_content",
    f"""WITH {all_pages_sql("facts")}, y AS (SELECT host, string_split(regexp_replace(lower(regexp_extract(trim(page_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '[^a-z-]', '/', 'g'), '/') AS parts, lower({_TITLE}) AS title FROM x),
    z AS (SELECT host, len(list_filter(parts, lambda s: s IN ({", ".join(map(lit, COMPARING))}) OR regexp_matches(s, '(?:^|-)(?:vs|versus|comparison)(?:-|$)'))) > 0 OR regexp_matches(title, {lit(either(COMPARING_TITLES))}) AS c FROM y)
    SELECT host, count(*) AS pages FROM z GROUP BY host HAVING count(*) >= 5 AND NOT bool_or(c)""",
)
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of five pages and more none of which compares."""
    p = all_pages(spark, sf_dir, "facts").select("page_id", "host", compares(url_path("page_url"), html_rows.title(F.col("html"))).alias("c")).dropDuplicates(["page_id"])
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.bool_or("c").alias("c")).where("pages >= 5 and not c").drop("c")
