import pytest

from folioforge.llm import queries

COLUMNS = {
    "p1_found": ["page_id", "field"], "p2_found": ["page_id", "block_ord"], "p3_found": ["page_id_a", "page_id_b"], "p4_found": ["page_id", "band"],
    "p5_found": ["page_id", "block_ord"], "p6_found": ["page_id", "block_ord"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_keys(spark, data_dir, name):
    df = queries.queries()[name](spark, data_dir)
    assert df.columns == COLUMNS[name]
    keys = [c for c in df.columns if c not in ("ids", "band")]
    assert df.count() == df.select(*keys).distinct().count()
