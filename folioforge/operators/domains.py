"""Registrable domains by a list of public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, suffix, domain, confidence`` of distinct ``host`` rows.

    ``suffixes``: ``suffix`` rules; ``*.x`` stands for any label before ``x`` and
    ``!y.x`` takes back a rule.  The longest rule wins; a host without any has its
    last label as suffix, with low confidence.  Every host gives its endings, which
    meet the rules by equality; the rules are a bounded public list.  A host that
    is a suffix itself, an address or one label has no domain.
    """
    one = hosts.select(F.lower(F.trim("host")).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    place = F.sequence(F.lit(1), n)
    tail = lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    ends = one.select("host", F.posexplode(F.transform(place, tail)).alias("i", "end")).withColumn("n", F.size(F.split("host", r"\.")))
    wild = F.concat(F.lit("*."), F.regexp_replace("end", r"^[^.]*\.", ""))
    keys = F.array(F.struct(F.col("end").alias("rule"), F.col("i").alias("at")), F.struct(wild.alias("rule"), F.col("i").alias("at")), F.struct(F.concat(F.lit("!"), "end").alias("rule"), (F.col("i") + 1).alias("at")))
    asked = ends.select("host", "n", F.explode(keys).alias("k")).select("host", "n", "k.rule", "k.at")
    rules = suffixes.select(F.lower(F.trim("suffix")).alias("rule")).where("rule <> ''").distinct()
    hit = asked.join(F.broadcast(rules), "rule")
    # an exception is preferred, else the rule that begins first
    best = hit.groupBy("host").agg(F.min(F.struct((~F.startswith("rule", F.lit("!"))).alias("plain"), "at")).alias("m")).select("host", F.col("m.at").alias("at"))
    all_ = one.join(best, "host", "left").withColumn("known", F.col("at").isNotNull()).withColumn("at", F.coalesce("at", n - 1))
    is_address = F.col("host").rlike(r"^[0-9.]+$|^\[|:")
    domain = F.when((F.col("at") >= 1) & ~is_address, F.array_join(F.slice(labels, F.greatest(F.col("at"), F.lit(1)), n), "."))
    suffix = F.when(~is_address, F.array_join(F.slice(labels, F.greatest(F.col("at") + 1, F.lit(1)), n), "."))
    return all_.select("host", suffix.alias("suffix"), domain.alias("domain"), F.when(F.col("known"), "high").otherwise("low").alias("confidence"))
