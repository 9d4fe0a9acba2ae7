"""Mixing of sources to target shares of the total size, as a curriculum.

Each source has a weight schedule over training time ``t`` in [0, 1], straight
between given points and constant outside them, scaled so that its integral is
one; times the source's tokens it is its cumulative demand ``D(t)``.  Documents
of a source stand in a fixed pseudo-random order, epoch after epoch; the one
whose tokens begin at ``c`` gets the training position ``D^-1(c)``, the root of a
quadratic on one piece of the schedule.  The curriculum is sorted by position
over ranges.  A source without a schedule has the default: sources that may be
repeated are scarce and move to the end, the others keep an even weight.

A source ends with the document whose end is nearest to its demand.

Size of the mixture: ``total_tokens``, or else the largest total for which
every source that has documents can give its share within its repeats.  A
source with a target and no tokens gives nothing (its share is reported as 0,
the others' shares grow in proportion); one without a target is not used.  A
demand beyond ``max_repeats`` times a source's tokens is cut to that.

Sources are compared trimmed and in lower case.  Null, empty and repeated
texts: null and empty texts count 0 tokens and are used as often as their
place in the order says; each document counts by itself.  Targets given twice
are summed up, with the smaller ``max_repeats``; null targets and negative
ones count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.tokenizer import encode_corpus
from folioforge.sources import keep

#: Default schedules, ``(t, weight)`` points, of sources that may be repeated and of the others.
SCARCE, PLENTY = ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0))
#: Documents of a source in one bucket, about, whose running sum is taken in one task.
BUCKET_ROWS = 100_000


def clean_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, ring``; ``ring`` orders a source's documents."""
    counts = encode_corpus(documents, "doc_id", "text", path, counts_only=True)
    return (
        documents.select("doc_id", clean_source(F.col("source")).alias("source"))
        .join(counts, "doc_id")
        .withColumn("ring", F.xxhash64("doc_id"))
    )


def source_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a source: target, caps, available tokens and tokens demanded."""
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens_available"))
    want = (
        targets.select(
            clean_source(F.col("source")).alias("source"),
            F.greatest(F.lit(0.0), F.coalesce(F.col("target_share"), F.lit(0.0))).alias("target_share"),
            F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(1))).alias("max_repeats"),
        )
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    both = (
        want.withColumn("has_target", F.lit(True))
        .join(have, want.source.eqNullSafe(have.source), "full")
        .select(
            F.coalesce(want.source, have.source).alias("source"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("tokens_available", F.lit(0)).alias("tokens_available"),
        )
    )
    cap = F.col("tokens_available") * F.col("max_repeats")
    able = (F.col("target_share") > 0) & (cap > 0)
    both = keep(both, "sources")
    if total_tokens is None:  # one row
        total_tokens = both.agg(F.min(F.when(able, cap / F.col("target_share")))).first()[0]
    return both.withColumn(
        "tokens_demanded",
        F.when(able, F.least(cap.cast("double"), F.col("target_share") * F.lit(total_tokens))).otherwise(0.0).cast("long"),
    )


def usage(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, uses, offset, available, demanded, share``.

    The running sum of a source is taken in two levels, over hash buckets and
    within one, so a source with a third of all rows is no single task.
    """
    # buckets are ranges of the ring, so that they follow one another as its values do
    buckets = 1 << max(4, (sized.count() // BUCKET_ROWS).bit_length())
    bucketed = sized.withColumn("bucket", F.shiftright("ring", 64 - (buckets.bit_length() - 1)))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_tokens").over(upto), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("ring", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = bucketed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    at = at.join(base, at.source.eqNullSafe(base.s) & (at.bucket == base.b)).withColumn("offset", F.col("base") + F.col("inside"))
    p = plan.select(
        F.col("source").alias("ps"),
        F.col("tokens_available").alias("available"),
        F.col("tokens_demanded").alias("demanded"),
        "max_repeats",
        "target_share",
    )
    whole = F.when(F.col("available") > 0, F.floor(F.col("demanded") / F.col("available"))).otherwise(0)
    rest = F.col("demanded") - whole * F.col("available")
    return (
        at.join(p, at.source.eqNullSafe(p.ps), "left")
        .withColumn("uses", F.coalesce((whole + (2 * F.col("offset") + F.col("n_tokens") < 2 * rest).cast("int")).cast("long"), F.lit(0).cast("long")))
        .select("doc_id", "source", "n_tokens", "uses", "offset", "available", "demanded", "max_repeats", "target_share")
    )


def shares(used: DataFrame, plan: DataFrame) -> DataFrame:
    """One row a source: what it was to give and what it gives."""
    got = used.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses")
    )
    p = plan.alias("p").join(got.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")), "left")
    p = p.select(
        "p.source", "target_share", "max_repeats", "documents", "tokens_available", "tokens_demanded",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    p = keep(p, "shares")
    total = p.agg(F.sum("tokens_used")).first()[0] or 0
    return p.select(
        "source", "target_share", "max_repeats", "documents", "tokens_available", "tokens_demanded", "tokens_used", "most_uses",
        (F.col("tokens_used") / F.lit(float(max(total, 1)))).alias("actual_share"),
    )


def schedule_pieces(schedule: DataFrame) -> DataFrame:
    """``source, pieces`` of ``source, t, weight`` points, several a source.

    A piece is ``t0, t1, w0, w1, c0, c1``: times, weights and the integral of the
    weight up to both ends, as shares of the whole.  Null points and negative
    weights count as none and as 0; times are cut to [0, 1]; of points at one
    time the larger weight counts.  A schedule without weight has no pieces.
    """
    points = (
        schedule.where("t is not null and weight is not null")
        .select(clean_source(F.col("source")).alias("source"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("t"))).alias("t"), F.greatest(F.lit(0.0), F.col("weight")).alias("w"))
        .groupBy("source", "t")
        .agg(F.max("w").alias("w"))
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("p"))
    )
    # constant outside the points
    ends = points.withColumn("p", F.expr("concat(array(named_struct('t', 0D, 'w', p[0].w)), p, array(named_struct('t', 1D, 'w', element_at(p, -1).w)))"))
    area = "(p[i + 1].t - p[i].t) * (p[i + 1].w + p[i].w) / 2"
    cut = ends.selectExpr(
        "source",
        f"transform(sequence(0, size(p) - 2), i -> named_struct('t0', p[i].t, 't1', p[i + 1].t, 'w0', p[i].w, 'w1', p[i + 1].w, 'a', {area})) AS q",
    ).selectExpr("source", "q", "aggregate(q, 0D, (x, e) -> x + e.a) AS total")
    upto = "aggregate(slice(q, 1, i), 0D, (x, e) -> x + e.a)"
    return cut.where("total > 0").selectExpr(
        "source",
        "filter(transform(sequence(0, size(q) - 1), i -> named_struct('t0', q[i].t0, 't1', q[i].t1, 'w0', q[i].w0 / total, 'w1', q[i].w1 / total,"
        f" 'c0', {upto} / total, 'c1', ({upto} + q[i].a) / total)), e -> e.c1 > e.c0) AS pieces",
    )


#: ``t`` with ``D(t) = y`` on the piece of a schedule that holds it.
_POSITION = (
    "element_at(transform(filter(pieces, e -> e.c1 >= y OR e.c1 >= 1D - 1e-12), e -> e.t0 + CASE"
    " WHEN abs(e.w1 - e.w0) < 1e-12 THEN greatest(0D, y - e.c0) / e.w0"
    " ELSE (sqrt(greatest(0D, e.w0 * e.w0 + 2 * (e.w1 - e.w0) / (e.t1 - e.t0) * greatest(0D, y - e.c0))) - e.w0) * (e.t1 - e.t0) / (e.w1 - e.w0) END), 1)"
)


def curriculum(used: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """``position, doc_id, use_no, source, n_tokens`` in training order; ``schedule``: ``source, t, weight`` points."""
    spark = used.sparkSession
    plain = [("scarce" if points is SCARCE else "plenty", t, w) for points in (SCARCE, PLENTY) for t, w in points]
    kinds = schedule_pieces(spark.createDataFrame(plain, "source string, t double, weight double")).withColumnsRenamed({"source": "kind", "pieces": "usual"})
    rows = used.where("uses > 0").withColumn("kind", F.when(F.col("max_repeats") > 1, "scarce").otherwise("plenty")).join(F.broadcast(kinds), "kind")
    if schedule is None:
        rows = rows.withColumn("pieces", F.col("usual"))
    else:
        own = schedule_pieces(schedule).withColumnsRenamed({"source": "s", "pieces": "own"})
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("pieces", F.coalesce("own", "usual"))
    return (
        rows.withColumn("use_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
        .withColumn("y", F.least(F.lit(1.0), (F.col("use_no") * F.col("available") + F.col("offset")) / F.greatest(F.lit(1.0), F.col("demanded"))))
        .withColumn("position", F.expr(_POSITION))
        .select("position", "doc_id", "use_no", "source", "n_tokens")
        .orderBy("position", "doc_id", "use_no")
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usage of each document, plan of each source); texts are encoded once."""
    sized = keep(sized_documents(documents, path), "sized")
    plan = keep(source_plan(sized, targets, total_tokens), "plan")
    return usage(sized, plan), plan
