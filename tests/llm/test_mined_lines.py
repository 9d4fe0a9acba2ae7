"""The blocks to delete come from mined sequences."""

import numpy as np

from folioforge.llm import site_lines


def test_merged_growth_gives_each_last_line_and_projection_once():
    rng = np.random.default_rng(3)
    for repeats in (False, True):
        pages = [rng.choice(8, rng.integers(1, 8), replace=repeats) for _ in range(12)] + [np.array([0, 1, 2, 3, 4, 5, 6, 7] + [0] * repeats)] * 4
        whole = [x for p in site_lines.grow(pages, None, 3) for x in zip(p[4].tolist(), p[2].tolist())]
        once = [x for p in site_lines.grow(pages, None, 3, merge=True) for x in zip(p[4].tolist(), p[2].tolist())]
        assert set(once) == set(whole) and len(once) < len(whole)


def test_found_blocks_are_mined_and_long_equal_pages_end(spark, monkeypatch):
    mined = []
    whole = site_lines._projected
    monkeypatch.setattr(site_lines, "_projected", lambda rows: mined.append(1) or whole(rows))
    lines = [f"line {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    pages = [(i, f"https://a.example/{i}") for i in range(6)]
    blocks = [(i, k, t) for i in range(6) for k, t in enumerate(lines + [f"own {chr(97 + i)}"])]
    got = site_lines.find_repeated(spark.createDataFrame(pages, "page_id long, page_url string"), spark.createDataFrame(blocks, "page_id long, block_ord int, text string"))
    assert mined and {tuple(r) for r in got.collect()} == {(i, k) for i in range(6) for k in range(60)}
