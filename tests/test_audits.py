"""Audits end on large tables: their plans stay small, and what several checks read is made once."""

import pytest

from folioforge.plans import catalog
from folioforge.plans.crawl_plans import CHECKS
from folioforge.sources import tables


@pytest.mark.parametrize("name", ["m15_page_audits", "m14_site_audits"])
def test_audit_plan_is_small(spark, data_dir, name, monkeypatch):
    made = []
    keep = tables.keep
    monkeypatch.setattr(tables, "keep", lambda df, n="t": made.append(n) or keep(df, n))
    df = catalog.queries()[name](spark, data_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= len(CHECKS) + 1 and "regexp_extract_all" not in plan
    assert len(made) == len(set(made)) and {"nodes", "sentences", "labelled_pairs"} <= set(made)


def test_once_is_made_again_outside_sharing(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("k")

    tables.once("k", make)
    assert tables.once("k", make).count() == 3 and len(made) == 2
    with tables.sharing():
        tables.once("k", make)
        assert tables.once("k", make).count() == 3
    assert len(made) == 3
