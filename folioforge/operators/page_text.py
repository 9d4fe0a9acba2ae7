"""Texts of pages put together from their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_text(blocks: DataFrame, sep: str = " ") -> DataFrame:
    """``page_id, text``: blocks in order, null texts left out.  A page bounds what is collected."""
    rows = blocks.where("text is not null").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("x"))
    return rows.select("page_id", F.array_join(F.transform("x", lambda b: b["text"]), sep).alias("text"))
