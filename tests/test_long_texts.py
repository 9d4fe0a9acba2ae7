"""Cells and lists far longer than any of the test tables give what the SQL gives."""

import os

import duckdb
import pandas as pd
import pytest

from folioforge.plans import catalog
from test_oracles import rows

LONG = 20_000


@pytest.fixture(scope="module")
def long_dir(data_dir, tmp_path_factory):
    """The smallest tables, and three pages of one kind with long cells and their blocks."""
    out = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    for name in os.listdir(data_dir):
        if name not in ("pages_in.parquet", "blocks_in.parquet"):
            os.symlink(f"{data_dir}/{name}", out / name)
    for k in range(3):
        cell = "x" * LONG + " < y <b" + "z" * LONG
        html = (
            f"<html><body><h1>Rooms</h1><dl><dt>Opening day</dt><dd>201{k}-05-01 {cell}</dd><dt>{cell}</dt><dd>7</dd><dt>Never closed<dd>{cell}</dl>"
            f"<table><tr><th>Weight limit</th><td>30 kg</td></tr><tr><th>Weight limit</th><td>40 kg</td></tr><tr><th>Note</th><td>{cell}</td></tr></table></body></html>"
        )
        con.execute("CREATE TABLE IF NOT EXISTS p (page_id BIGINT, page_url VARCHAR, html VARCHAR)")
        con.execute("INSERT INTO p VALUES (?, ?, ?)", [900_000_001 + k, f"https://long.example/rooms/{k}10-a", html])
    con.execute("CREATE TABLE b (page_id BIGINT, block_ord INTEGER, text VARCHAR, word_count INTEGER)")
    con.execute("INSERT INTO b SELECT page_id, 0, 'The average of the rooms is 9.', 6 FROM p")
    con.execute(f"INSERT INTO b SELECT page_id, 1, 'Rooms: ' || array_to_string(list_transform(range({LONG}), lambda i: i % 7 + 1), ', '), {LONG} + 1 FROM p")
    for name, more in (("pages_in", "p"), ("blocks_in", "b")):
        con.execute(f"COPY (SELECT * FROM read_parquet('{data_dir}/{name}.parquet') UNION ALL BY NAME SELECT * FROM {more}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["d22_labelled_facts", "f04_computed_stat", "f09_fact_collisions", "m15_page_audits", "f05_label_lines", "m14_site_audits", "f03_scope_ambiguous"])
def test_long_texts(spark, long_dir, name, tmp_path):
    con = duckdb.connect()
    for f in os.listdir(long_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{long_dir}/{f}')")
    out = str(tmp_path / "out")
    catalog.queries()[name](spark, long_dir).write.parquet(out)
    mine, theirs = pd.read_parquet(out), con.execute(catalog.oracle_sql()[name]).df()
    assert len(mine) and rows(mine) == rows(theirs)
