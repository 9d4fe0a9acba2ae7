"""From findings to a report: validate, merge, order, number, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
CONFIDENCES = ("low", "medium", "high")
TRACKS = ("defect", "proactive")
SHOWN_PAGES = 10


def rank_in(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c)


def violations(findings: DataFrame) -> DataFrame:
    """``id, page_id, problem`` of findings outside the domains, or given twice for a page."""
    rules = {
        "unknown severity": ~F.col("severity").isin(*SEVERITIES) | F.col("severity").isNull(),
        "unknown track": ~F.col("track").isin(*TRACKS) | F.col("track").isNull(),
        "unknown confidence": ~F.col("confidence").isin(*CONFIDENCES) | F.col("confidence").isNull(),
        "given twice": F.col("times") > 1,
    }
    counted = findings.withColumn("times", F.count("*").over(Window.partitionBy("id", "page_id")))
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return counted.select("id", "page_id", F.explode(found).alias("problem"))


def merge(findings: DataFrame) -> DataFrame:
    """One row for each id: what its first page by address says, pages, the weakest confidence."""
    g = findings.groupBy("id").agg(
        F.min(F.struct("page_url", "page_id", "severity", "track", "skill")).alias("f"),
        F.countDistinct("severity", "track", "skill").alias("kinds"),
        F.min(rank_in(F.col("confidence"), CONFIDENCES)).alias("weakest"),
        F.countDistinct("page_url").alias("pages"), F.min("page_url").alias("first_page"),
    )
    return g.select(
        "id", "f.severity", "f.track", "f.skill", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("weakest").cast("int")).alias("confidence"),
        "pages", "first_page", (F.col("kinds") > 1).alias("conflict"),
    )


def examples(findings: DataFrame, most: int = SHOWN_PAGES) -> DataFrame:
    """``id, place, page_url`` of the first pages of each id; the top is kept
    during aggregation, so an id on very many pages is never collected."""
    once = findings.select("id", "page_url").dropDuplicates()
    w = Window.partitionBy("id").orderBy("page_url")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "place", "page_url")


def ordered(merged: DataFrame) -> list[Column]:
    return [rank_in(F.col("track"), TRACKS), rank_in(F.col("severity"), SEVERITIES), F.col("id")]


def numbered(merged: DataFrame) -> DataFrame:
    """``number``: F-001 and on, defects first, by severity, then id.  There is one row a check, so one window is small."""
    n = F.row_number().over(Window.orderBy(*ordered(merged)))
    return merged.withColumn("number", F.format_string("F-%03d", n))


def summary(merged: DataFrame) -> DataFrame:
    """Counts by severity, by track and of all."""
    g = merged.groupingSets([["severity"], ["track"], []], "severity", "track").agg(F.count("*").alias("findings"), F.sum("pages").alias("pages"))
    return g.select(F.coalesce("severity", "track", F.lit("all")).alias("what"), "findings", "pages")


def within_budget(units: DataFrame, by: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """``units`` with ``reached``: whether the costs up to and with it stay within the cap."""
    total = F.sum(cost).over(Window.partitionBy(by).orderBy(*order))
    return units.withColumn("reached", total <= cap)


def top_candidates(items: DataFrame, by: str, severity: str, order: list[str], most: int = 5) -> DataFrame:
    """The ``most`` severest items of each group; unknown severities come last."""
    rank = F.coalesce(F.nullif(rank_in(F.col(severity), SEVERITIES), F.lit(0).cast("bigint")), F.lit(len(SEVERITIES)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(rank, *order))
    return items.withColumn("place", place).where(F.col("place") <= most)
