"""Exact set-similarity join of documents by prefix filtering.

Two sets of similarity ``least`` or more share one of their rarest
``n - ceil(least n) + 1`` members, so only these are indexed: the join key is a
rare shingle, and a hot shingle never meets itself.  Texts with equal sets are
one class, and classes stand for their members.  The result is one row a
document with its group and its number of links; the links of a class are
counted, not written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.graph import connected_components
from folioforge.sources import keep


def shingles(words: str, size: int) -> F.Column:
    """Distinct hashes of the word sequences; a shorter text is one sequence, an empty one none."""
    w = F.col(words)
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) >= size, F.array_distinct(grams)).when(F.size(w) > 0, whole).otherwise(none)


def near_duplicate_groups(docs: DataFrame, key: str, text: str, size: int = 5, least: float = 0.8) -> DataFrame:
    """``key, group_id, links``; the group is its smallest key, empty texts stand alone."""
    w = docs.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    sets = keep(w.select("id", F.array_sort(shingles("w", size)).alias("s")).withColumn("c", F.xxhash64("s")).dropDuplicates(["id"]), "sets")
    members = sets.select("id", F.when(F.size("s") == 0, F.col("id")).otherwise(F.col("c")).alias("c"), (F.size("s") == 0).alias("empty"))
    classes = keep(sets.where(F.size("s") > 0).groupBy("c").agg(F.first("s").alias("s"), F.count("*").alias("k"), F.min("id").alias("low")), "classes")
    items = classes.select("c", F.size("s").alias("n"), F.explode("s").alias("g"))
    common = items.groupBy("g").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("df", "g"))
    prefix = items.join(common, "g").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    prefix = keep(prefix.where("df > 1").select("c", "n", "g"), "prefix")
    a, b = prefix.select(F.col("c").alias("a"), F.col("n").alias("na"), "g"), prefix.select(F.col("c").alias("b"), F.col("n").alias("nb"), "g")
    met = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").dropDuplicates()
    left, right = classes.select(F.col("c").alias("a"), F.col("s").alias("sa")), classes.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = keep(met.join(left, "a").join(right, "b").where(both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    over = ends.join(classes.select(F.col("c").alias("b"), "k"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("k").alias("over"))
    parts = connected_components(links, "a", "b").select(F.col("node").alias("c"), "component")
    info = classes.join(parts, "c", "left").join(over, "c", "left").withColumn("component", F.coalesce("component", "c"))
    low = info.groupBy("component").agg(F.min("low").alias("group_id"))
    info = info.join(low, "component").select("c", "group_id", (F.col("k") - 1 + F.coalesce("over", F.lit(0))).alias("links"))
    joined = members.where("not empty").join(info, "c").select("id", "group_id", "links")
    alone = members.where("empty").select("id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("links"))
    return joined.unionByName(alone).withColumnRenamed("id", key)
