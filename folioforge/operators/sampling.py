"""Samples of a site's pages over its templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: DataFrame, by: str, key: str, size: str, budget: int) -> DataFrame:
    """``by, key, size, slots``: slots of each key within ``by``.

    One for each key where the budget allows, the rest in proportion to size and
    cut to it, what is left by largest fraction (ties by key) in at most two
    rounds; with fewer slots than keys the largest keys get one.
    """
    w = Window.partitionBy(by)
    df = sizes.select(by, key, F.col(size).alias("size")).withColumns({"total": F.sum("size").over(w), "keys": F.count("*").over(w)})
    df = df.withColumn("share", F.col("size") / F.col("total") * (F.lit(budget) - F.col("keys")))
    df = df.withColumn("given", F.lit(1) + F.least(F.floor("share"), F.col("size") - 1))
    df = df.withColumn("left", F.lit(budget) - F.sum("given").over(w)).withColumn("fraction", F.col("share") - F.floor("share"))
    # rounds of one slot each: a grant stands at (round, place by fraction)
    rounds = df.where("keys <= {}".format(budget)).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2)))).where("size - given >= round")
    place = F.row_number().over(Window.partitionBy(by).orderBy("round", F.desc("fraction"), key))
    extra = rounds.withColumn("place", place).where("place <= left").groupBy(by, key).agg(F.count("*").alias("extra"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), key))
    df = df.withColumn("rank", rank).join(extra, [by, key], "left")
    slots = F.when(F.col("keys") > budget, (F.col("rank") <= budget).cast("bigint")).otherwise(F.col("given") + F.coalesce("extra", F.lit(0)))
    return df.select(by, key, "size", slots.cast("bigint").alias("slots"))


def pick_evenly(rows: DataFrame, by: list[str], order: list[str], slots: str) -> DataFrame:
    """The rows of each group at evenly spread places, ``slots`` of them."""
    w = Window.partitionBy(*by)
    df = rows.withColumns({"i": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count("*").over(w)})
    # row i is taken if some k in [0, slots) has floor(k * n / slots) = i
    k = F.ceil(F.col("i") * F.col(slots) / F.col("n"))
    hit = (k < F.col(slots)) & (F.floor(k * F.col("n") / F.col(slots)) == F.col("i"))
    return df.where((F.col(slots) >= F.col("n")) | hit).drop("i", "n")
