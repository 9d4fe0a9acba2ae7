"""Graph operators over edge tables, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources import keep


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps, which need a number of rounds
    logarithmic in the graph's diameter; each round is kept, so lineage stays
    short.  A node with very many neighbours is pre-aggregated (min) before the
    shuffle and never collected.  Null ends are left out, self-loops and
    repeated edges do no harm, an empty table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = keep(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).dropDuplicates(["node"]), "nodes")
    e = keep(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where("u <> v").dropDuplicates(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates(), "small")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree``: ends of edges at each node; a loop counts twice, repeated edges each."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    counts = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``node, rank`` by a fixed number of power iterations.

    Repeated edges weigh more; edges with an unknown end are left out; the rank
    of nodes without outgoing edges is spread over all.  Edges are aggregated
    once; each round is one join and one aggregation, and lineage is cut every
    few rounds.
    """
    nodes = keep(nodes.select("node").dropDuplicates(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    weighed = known.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = known.groupBy("src").agg(F.count("*").alias("out"))
    moves = keep(weighed.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("part")), "moves")
    sinks = keep(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti"), "sinks")
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        lost = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = moves.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("part") * F.col("rank")).alias("given"))
        base = (1.0 - damping) / n + damping * lost / n
        rank = nodes.join(given, F.col("node") == F.col("dst"), "left").select("node", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        rank = keep(rank, "rank")
    return rank
