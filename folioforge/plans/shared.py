"""Tables as the plans read them, each row once, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.urls import page_host
from folioforge.sources import table

Query = Callable[[SparkSession, str], DataFrame]

SITE = r"regexp_replace(regexp_extract(lower(trim(page_url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '^(?:www\.|m\.)', '')"
P = f"p AS (SELECT DISTINCT ON (page_id) *, {SITE} AS host FROM pages_in)"
B = "b AS (SELECT DISTINCT ON (page_id, block_ord) * FROM blocks_in)"
#: Site files of two small sites, read beside the table by plans and SQL alike: closed to some agents, closed paths, declared pages.
SITE_FILES = (
    ("acme.test", "robots", "present", "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: /private\nAllow: /private/open\nSitemap: https://acme.test/sitemap.xml", "text/plain"),
    ("acme.test", "llms", "present", "# Acme\n\n> Lamps\n\n## Pages\n- [B](https://acme.test/b): a page\n- [C](https://acme.test/later): another", "text/plain"),
    ("acme.test", "sitemap", "present", "<urlset><url><loc>https://acme.test/a</loc></url><url><loc>https://acme.test/private/x</loc></url><url><loc>https://acme.test/contact</loc></url></urlset>", "application/xml"),
    ("acme.test", "tdmrep", "absent", None, None),
    ("beta.test", "robots", "present", "User-agent: *\nDisallow: /", "text/plain"),
)
_FILES = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in row) + ")" for row in SITE_FILES)
A = f"a AS (SELECT DISTINCT site, kind, status, text, content_type FROM (SELECT site, kind, status, text, content_type FROM artifacts_in UNION ALL SELECT * FROM (VALUES {_FILES}) AS v(site, kind, status, text, content_type)))"


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every fetch once, with ``host``; only ``columns`` are read."""
    df = table(spark, sf_dir, "pages_in").select("page_id", "page_url", *columns).dropDuplicates(["page_id"])
    return df.withColumn("host", page_host("page_url"))


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "blocks_in").select("page_id", "block_ord", *columns).dropDuplicates(["page_id", "block_ord"])


def artifacts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The site files of the table and of the small sites, each once."""
    more = spark.createDataFrame(SITE_FILES, "site string, kind string, status string, text string, content_type string")
    df = table(spark, sf_dir, "artifacts_in").select("site", "kind", "status", "text", "content_type").unionByName(more)
    return (df.where(F.col("kind").isin(*kinds)) if kinds else df).dropDuplicates()
