"""Every query over empty tables, and over tables with clashing extra columns, nulls and repeats."""

import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioforge.llm import queries

NAMES = sorted(queries.queries())


def tables(data_dir):
    return [f for f in os.listdir(data_dir) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def empty_dir(data_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for f in tables(data_dir):
        pq.write_table(pq.read_table(f"{data_dir}/{f}").slice(0, 0), out / f)
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    rows = queries.queries()[name](spark, empty_dir).collect()
    assert rows == [] or name == "p4_quality"


EXTRA = ("host", "flags", "line", "text_", "id", "cls", "n_tokens", "uses", "words", "subjects", "key", "f", "ring", "band", "share", "field")


@pytest.fixture(scope="module")
def odd_dir(data_dir, tmp_path_factory):
    """The tables twice over, with columns named as the operators name theirs."""
    out = tmp_path_factory.mktemp("odd")
    for f in tables(data_dir):
        t = pq.read_table(f"{data_dir}/{f}")
        once = f in ("mix_targets.parquet", "subject_areas.parquet", "documents.parquet")
        t = t if once else pa.concat_tables([t, t])
        for c in EXTRA:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([None] * t.num_rows, pa.string()))
        pq.write_table(t, out / f)
    yield str(out)
    shutil.rmtree(out)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_ids", "p8_usage", "p9_found"])
def test_repeats_and_clashing_columns_change_nothing(spark, data_dir, odd_dir, name):
    own = sorted(map(str, queries.queries()[name](spark, data_dir).collect()))
    assert sorted(map(str, queries.queries()[name](spark, odd_dir).collect())) == own
