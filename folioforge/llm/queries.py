"""Queries of the operators for training text, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bodies, boilerplate, encoding_repair, mixing, near_dup, reading_level, residue, site_lines, subjects, tokenizer
from folioforge.sources import keep, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.find_damage(table(spark, sf_dir, "pages_in"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.find_damage(table(spark, sf_dir, "pages_in"), with_text=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(boilerplate.analyse(table(spark, sf_dir, "pages_in")))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.cleaned_blocks(table(spark, sf_dir, "blocks_in"), p2_found(spark, sf_dir))


def p2_cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.cleaned_pages(table(spark, sf_dir, "pages_in"), p2_found(spark, sf_dir))


#: TESTDATA.md: three words, 0.7, bodies of at least 50 words.
PAGE_COPIES = {"size": 3, "least": 0.7, "least_words": 50, "distinct_ids": True}


def _page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = boilerplate.analyse(table(spark, sf_dir, "pages_in"))
    bad = keep(boilerplate.find_boilerplate(p, residue.whole_residue(p)[0]), "boilerplate")
    own = bodies.body_blocks(table(spark, sf_dir, "blocks_in"), bad)
    return near_dup.near_duplicates(own.select(F.col("page_id").alias("id"), bodies.joined_text().alias("text")), **PAGE_COPIES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_dup.all_pairs(*_page_links(spark, sf_dir))
    return pairs.select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(*_page_links(spark, sf_dir)).withColumnRenamed("id", "page_id")


LEAST_LEVEL_WORDS = 60


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, reading_level.Grader]:
    p = boilerplate.analyse(table(spark, sf_dir, "pages_in"))
    odd, whole = residue.whole_residue(p)
    bad = keep(boilerplate.find_boilerplate(p, odd), "boilerplate")
    english = p.profile.where("lang like 'en%'").select("page_id", "host").dropDuplicates(["page_id"]).join(whole, "page_id", "left_anti")
    english = keep(english, "english")
    own = bodies.body_blocks(table(spark, sf_dir, "blocks_in").join(english, "page_id", "left_semi"), bad, odd)
    words = F.aggregate("items", F.lit(0), lambda n, b: n + F.coalesce(b["word_count"], F.lit(0)))
    own = own.where(words >= LEAST_LEVEL_WORDS).select("page_id", bodies.joined_text().alias("text")).join(english, "page_id")
    feats = keep(reading_level.body_features(own), "features")
    return feats, reading_level.train(feats, table(spark, sf_dir, "reading_labels"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.levels(*_graded(spark, sf_dir)).select("page_id", "band")


def p4_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, grader = _graded(spark, sf_dir)
    return reading_level.levels(feats, grader).join(feats.select("page_id", "host"), "page_id")


def p4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grader = _graded(spark, sf_dir)
    return spark.createDataFrame(grader.report, "fold int, labelled int, right int, years_off double")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = boilerplate.analyse(table(spark, sf_dir, "pages_in"))
    return boilerplate.find_boilerplate(p, residue.whole_residue(p)[0])


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.evidence_shares(boilerplate.analyse(table(spark, sf_dir, "pages_in")).profile)


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bodies.body_blocks(table(spark, sf_dir, "blocks_in"), keep(p5_found(spark, sf_dir), "boilerplate"))
    return own.select("page_id", bodies.joined_text().alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.find_repeated(table(spark, sf_dir, "pages_in"), table(spark, sf_dir, "blocks_in"))


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.sequences(table(spark, sf_dir, "pages_in"), table(spark, sf_dir, "blocks_in"))


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.line_texts(table(spark, sf_dir, "pages_in"), table(spark, sf_dir, "blocks_in"))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.cleaned_pages(table(spark, sf_dir, "pages_in"), table(spark, sf_dir, "blocks_in"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return used.select("doc_id", "source", "n_tokens", "uses")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, plan = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixing.shares(used, plan)


def p8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixing.curriculum(used)


def _topics(spark: SparkSession, sf_dir: str) -> tuple[subjects.Corpus, subjects.TopicModel, list[str]]:
    return subjects.model(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(*_topics(spark, sf_dir)).select("doc_id", "subject")


def p9_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, m, names = _topics(spark, sf_dir)
    return spark.createDataFrame(
        subjects.top_terms(corpus, m, names), "topic int, language int, subject string, rank int, term string, probability double"
    )


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.assign(*_topics(spark, sf_dir))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.avg("share").alias("mean_share"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_restored": p1_restored,
        "p2_found": p2_found,
        "p2_cleaned": p2_cleaned,
        "p2_cleaned_pages": p2_cleaned_pages,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p4_found": p4_found,
        "p4_levels": p4_levels,
        "p4_quality": p4_quality,
        "p5_found": p5_found,
        "p5_bodies": p5_bodies,
        "p5_shares": p5_shares,
        "p6_found": p6_found,
        "p6_sequences": p6_sequences,
        "p6_lines": p6_lines,
        "p6_cleaned": p6_cleaned,
        "p7_ids": p7_ids,
        "p8_usage": p8_usage,
        "p8_shares": p8_shares,
        "p8_curriculum": p8_curriculum,
        "p9_found": p9_found,
        "p9_topics": p9_topics,
        "p9_composition": p9_composition,
    }
