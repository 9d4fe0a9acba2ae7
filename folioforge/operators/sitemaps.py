"""Walking sitemaps that name other sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.sources import keep

_LOC = r"(?i)<loc>[ \t\r\n]*([^< \t\r\n][^<]*)</loc>"
#: Levels, addresses of one file and addresses of one site that a walk takes.
MOST_LEVELS, MOST_OF_FILE, MOST_OF_SITE = 8, 500, 5000


def walk(roots: DataFrame, files: DataFrame, levels: int = MOST_LEVELS, of_file: int = MOST_OF_FILE, of_site: int = MOST_OF_SITE) -> DataFrame:
    """``site, url, sitemap, level`` of the page addresses that ``roots`` (``site, url``) lead to.

    ``files``: fetched sitemaps as ``url, text``; a file that is not there is
    skipped.  Addresses in an index, and addresses ending in ``.xml`` or ``.xml.gz``
    anywhere, are sitemaps to read next; one ring of files a level, each file once,
    so loops end.  A site keeps the first ``of_site`` addresses by level and place.
    """
    one = files.select(F.trim("url").alias("sitemap"), "text").dropDuplicates(["sitemap"])
    ring = roots.select("site", F.trim("url").alias("sitemap")).distinct()
    seen, pages = None, None
    for level in range(levels):
        ring = ring if seen is None else ring.join(seen, ["site", "sitemap"], "left_anti")
        ring = keep(ring, "sitemap_ring")
        if ring.isEmpty():
            break
        seen = ring if seen is None else seen.unionByName(ring)
        locs = ring.join(one, "sitemap").select("site", "sitemap", F.lower("text").contains("<sitemapindex").alias("index"), F.posexplode(F.regexp_extract_all("text", F.lit(_LOC), F.lit(1))).alias("ord", "u"))
        locs = locs.withColumns({"url": F.trim("u"), "more": F.col("index") | F.lower(F.trim("u")).rlike(r"\.xml(?:\.gz)?$")})
        found = locs.where(~F.col("more") & (F.col("ord") < of_file)).select("site", "url", "sitemap", "ord", F.lit(level).alias("level"))
        pages = found if pages is None else pages.unionByName(found)
        ring = locs.where("more").select("site", F.col("url").alias("sitemap")).distinct()
    if pages is None:
        return roots.limit(0).select("site", "url", F.lit("").alias("sitemap"), F.lit(0).alias("level"))
    first = pages.groupBy("site", "url").agg(F.min(F.struct("level", "sitemap", "ord")).alias("m")).select("site", "url", "m.*")
    place = F.row_number().over(Window.partitionBy("site").orderBy("level", "sitemap", "ord", "url"))
    return first.withColumn("place", place).where(F.col("place") <= of_site).select("site", "url", "sitemap", "level")
