"""Registered queries of the core with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.urls import page_host
from folioforge.plans.shared import SITE, Query
from folioforge.sources import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of each site by status, every fetch once."""
    pages = table(spark, sf_dir, "pages_in").select("page_id", "page_url", "status").dropDuplicates(["page_id"])
    return pages.groupBy(page_host("page_url").alias("site"), "status").agg(F.count("*").alias("pages"))


_MODULES = (
    "html_plans", "text_plans", "perimeter_plans", "site_plans", "derived_plans", "more_plans", "graph_plans", "audit_plans", "content_plans", "crawl_plans",
)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"site_status": flagship}
    for m in _MODULES:
        own = import_module(f"folioforge.plans.{m}").QUERIES
        if twice := sorted(found.keys() & own.keys()):
            raise ValueError(f"registered twice: {twice}")
        found |= own
    return found


def oracle_sql() -> dict[str, str]:
    found = {
        "site_status": f"SELECT host AS site, status, count(*) AS pages FROM (SELECT DISTINCT page_id, {SITE} AS host, status FROM pages_in) GROUP BY 1, 2"
    }
    for m in _MODULES:
        found |= import_module(f"folioforge.plans.{m}").ORACLES
    return found
