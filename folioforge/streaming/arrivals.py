"""Structured Streaming over fetches and connection outcomes.

The same functions take batch tables; late rows beyond the watermark are dropped
in a stream only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.functions.urls import page_host


def latest_fetches(pages: DataFrame, late: str = "2 days") -> DataFrame:
    """Every fetch once, though it may be delivered again within ``late``."""
    if pages.isStreaming:
        return pages.where("loaded_at is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["page_id"])
    return pages.dropDuplicates(["page_id"])


def arrivals_by_window(pages: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, host, status, fetches`` by window of arrival."""
    df = pages.where("loaded_at is not null")
    if df.isStreaming:
        df = df.withWatermark("loaded_at", late)
    g = df.groupBy(F.window("loaded_at", width).alias("w"), page_host("page_url").alias("host"), "status").agg(F.count("*").alias("fetches"))
    return g.select(F.col("w.start").alias("start"), "host", "status", "fetches")


def open_circuits(outcomes: DataFrame, limit: int = 2) -> DataFrame:
    """``host, failures`` each time a host has failed ``limit`` times in a row.

    ``outcomes``: ``host, ts, failed``.  The state of a host is one number; rows
    of a micro-batch are taken by time.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        hits = []
        for failed in rows["failed"]:
            run = run + 1 if failed else 0
            if run == limit:
                hits.append((key[0], run))
        state.update((run,))
        yield pd.DataFrame(hits, columns=["host", "failures"])

    return outcomes.groupBy("host").applyInPandasWithState(
        step, "host string, failures long", "run long", "append", GroupStateTimeout.NoTimeout
    )
