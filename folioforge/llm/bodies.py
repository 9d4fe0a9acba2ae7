"""Bodies of pages: blocks without boilerplate, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def body_blocks(blocks: DataFrame, *left_out: DataFrame) -> DataFrame:
    """``page_id, items`` (structs ``block_ord, text, word_count`` in order) without the blocks of ``left_out``.

    One shuffle of the blocks, by page; a page's blocks are collected, which
    its page bounds.  Blocks delivered twice count once, null texts not at all.
    """
    bad = left_out[0].select("page_id", "block_ord")
    for other in left_out[1:]:
        bad = bad.unionByName(other.select("page_id", "block_ord"))
    bad = bad.where("block_ord >= 0").groupBy("page_id").agg(F.collect_set("block_ord").alias("bad"))
    rows = blocks.where("text is not null").select("page_id", "block_ord", "text", "word_count").join(bad, "page_id", "left")
    rows = rows.where(F.col("bad").isNull() | ~F.array_contains("bad", F.col("block_ord")))
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("block_ord", "text", "word_count"))).alias("items"))


def joined_text() -> Column:
    return F.array_join(F.transform("items", lambda b: b["text"]), " ")
