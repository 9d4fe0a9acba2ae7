"""Cells with very many ``<`` that nothing closes give what the SQL gives, in time that grows with the text and not with its square."""

import os
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.plans import catalog
from test_oracles import rows

OPEN = "7 " + "<b c " * 120_000


@pytest.fixture(scope="module")
def open_dir(data_dir, tmp_path_factory):
    """The smallest tables and three pages of one kind whose cells are full of open tags."""
    out = tmp_path_factory.mktemp("open")
    con = duckdb.connect()
    for name in os.listdir(data_dir):
        if name != "pages_in.parquet":
            os.symlink(f"{data_dir}/{name}", out / name)
    con.execute("CREATE TABLE p (page_id BIGINT, page_url VARCHAR, html VARCHAR)")
    for k in range(3):
        html = f"<html><body><dl><dt>Opening day</dt><dd>201{k}-05-01 {OPEN}</dd></dl><table><tr><th>Weight limit</th><td>{30 + k} kg</td></tr><tr><th>Weight limit</th><td>40 kg</td></tr><tr><th>Note</th><td>{OPEN}</td></tr></table></body></html>"
        con.execute("INSERT INTO p VALUES (?, ?, ?)", [900_000_001 + k, f"https://open.example/rooms/{k}10-a", html])
    con.execute(f"COPY (SELECT * FROM '{data_dir}/pages_in.parquet' UNION ALL BY NAME SELECT * FROM p) TO '{out}/pages_in.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["f09_fact_collisions", "f05_label_lines", "f03_scope_ambiguous", "h04_fixed_widths"])
def test_open_tags(spark, open_dir, name, tmp_path):
    con = duckdb.connect()
    for f in os.listdir(open_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{open_dir}/{f}')")
    out, began = str(tmp_path / "out"), time.perf_counter()
    catalog.queries()[name](spark, open_dir).write.parquet(out)
    assert time.perf_counter() - began < 60
    mine, theirs = pd.read_parquet(out), con.execute(catalog.oracle_sql()[name]).df()
    assert len(mine) and rows(mine) == rows(theirs)


@pytest.mark.parametrize("text", ["", "a<b>c", "a < b", "<a<b>c<d<e", "x>y<z>", "<>", "<", "a$1<b\n>c<d\\", "<b c " * 3])
def test_without_tags(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(markup.without_tags(F.col("t"))).head()[0]
    assert got == duckdb.execute("SELECT regexp_replace(?, ?, '', 'g')", [text, markup.TAG]).fetchone()[0]
