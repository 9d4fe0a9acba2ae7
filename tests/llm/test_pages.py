import itertools
import re

import numpy as np
import pytest

from folioforge.functions.html_blocks import extract_blocks
from folioforge.llm import bodies, boilerplate, near_dup, reading_level, residue, residue_text, site_lines
from tests.llm import pages as P

PAGES = "page_id long, page_url string, html string"


def blocks_of(spark, rows):
    out = [(i, b.ord, b.text, len(b.text.split())) for i, _, h in rows for b in extract_blocks(h)]
    return spark.createDataFrame(out, "page_id long, block_ord int, text string, word_count int")


def found(df):
    return {tuple(r) for r in df.collect()}


def test_boilerplate_by_structure_and_repeats(spark):
    rows = P.site() + [(1, *P.site()[0][1:])] + [(99, "https://b.example/", None)]
    p = boilerplate.analyse(spark.createDataFrame(rows, PAGES))
    got = found(boilerplate.find_boilerplate(p, residue.whole_residue(p)[0]))
    for i, _, h in P.site():
        for b in extract_blocks(h):
            inside = b.in_main and not b.text.startswith(("Written by", "Share this"))
            assert ((i, b.ord) in got) != inside, (i, b)


def test_copied_articles_are_no_boilerplate(spark):
    same = P.body(5)
    rows = [(i, f"https://a.example/{i}", P.html(same, title=f"T {i}")) for i in range(1, 8)]
    p = boilerplate.analyse(spark.createDataFrame(rows, PAGES))
    got = found(boilerplate.find_boilerplate(p, residue.whole_residue(p)[0]))
    for i, _, h in rows:
        for b in extract_blocks(h):
            if b.in_main and b.text in same[1:-1]:
                assert (i, b.ord) not in got


def test_suffix_ranks_against_brute_force():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 200)
    for j, rank in enumerate(boilerplate.doubled_ranks(s, 16)):
        h = 1 << j
        cut = [tuple(s[i : i + h]) for i in range(len(s))]
        order = sorted(set(cut))
        assert [order.index(c) for c in cut] == list(rank)


def test_residue_blocks_pages_and_mentions(spark):
    good = P.body(3)
    rows = [
        (1, "https://a.example/1", P.html([*good, "Welcome back, {{ user.name }}! Your order is waiting."])),
        (2, "https://a.example/2", P.html(["Too many requests from your address. Slow down and retry."], title="Oops")),
        (3, "https://a.example/3", P.html([*good, "The printers of Rajira used lorem ipsum because nobody tries to read it."])),
        (4, "https://a.example/4", '<html><head><title>App</title></head><body><div id="app"></div><noscript>Please turn on JavaScript to see this page.</noscript></body></html>'),
        (5, "https://a.example/5", P.html([*good, "The service is down for maintenance. Back in 21 minutes."])),
        (6, "https://a.example/6", P.html(good, extra="<noscript>Please turn on JavaScript to see this page.</noscript><!-- {{ x }} --><script>404 page not found</script>")),
        (7, "https://a.example/7", None),
    ] + [(20 + i, u, h) for i, u, h in P.site()]
    # what no list of messages holds is learned: it stands alone on pages of several hosts
    for k, host in enumerate(("b", "c", "d")):
        rows.append((50 + 4 * k, f"https://{host}.example/1", P.html(["Too many requests from your address. Slow down and retry."], title="Nope")))
        rows.append((51 + 4 * k, f"https://{host}.example/2", rows[3][2]))
        rows.append((52 + 4 * k, f"https://{host}.example/3", P.html(["The service is down for maintenance. Back in 5 minutes."], title="Nope")))
    p = boilerplate.analyse(spark.createDataFrame(rows, PAGES))
    got = found(residue.find_residue(p))
    text = {(i, b.ord): b.text for i, _, h in rows for b in extract_blocks(h)}
    by_page = {}
    for i, o in got:
        by_page.setdefault(i, set()).add(text.get((i, o), -1))
    assert by_page[1] == {"Welcome back, {{ user.name }}! Your order is waiting."}
    assert by_page[2] == {-1, text[2, 0], "Too many requests from your address. Slow down and retry."}
    assert by_page[4] == {-1} and {i for i in by_page if i < 50} == {1, 2, 4, 5}
    # the title of residue pages alone is learned with them
    assert all(text[i, 0] in by_page[i] for i in (50, 52, 54, 56, 58, 60))


def test_near_duplicate_sentence_gets_the_label(spark):
    rows = [(1, "https://a.example/1", P.html([*P.body(1), "The page you are looking for really does not exist."]))]
    p = boilerplate.analyse(spark.createDataFrame(rows, PAGES))
    assert len(found(residue.find_residue(p))) == 1


@pytest.mark.parametrize(
    ("text", "is_field"),
    [
        ("${item.name}", True), ("<%= x.y %>", True), ("[[a:b]]", True), ("%CITY_NAME% has it", True), ("[INSERT NAME HERE]", True),
        ("undefined: 5", True), ("Dolor nisi magna cillum cupidatat mollit nulla aliqua.", True), ("", False),
        ("The set {1, 2, 11} has three members.", False), ("reading past the end is called undefined behaviour.", False),
        ("Dear {{ name | default('" + "x" * 5000 + "') }}, hello.", True), ("The sign in page greets {{ user }} at the exhibition.", True),
        ("Tags are removed from {{ title }} on Monday.", True), ("TODO: write this", True), ("asdf qwer", True), ("A foo walks into a bar.", False),
        ("The result remains undefined.", False), ("Read more about undefined and the map.", True), ("Use {% block %} in your template to begin.", False),
        ("A sum of 44 % applies [1].", False), ("He types {{ title }} in the theme file and the shop fills it in.", False),
    ],
)
def test_fields(text, is_field):
    assert residue_text.contains_field(text) == is_field


def test_language_and_title_behind_a_long_head():
    from folioforge.llm import page_profile

    head = "<!-- " + "x" * 9000 + " -->"
    row = page_profile.profile_batch([1], ["a"], [f'{head}<html lang="EN-gb"><head>{head}<title>404</title></head><body><h1>T</h1><p>Some text.</p></body></html>'])
    assert row.column("lang").to_pylist() == ["en-gb"]
    assert row.column("flags")[0].as_py()[0] & page_profile.MESSAGE_TITLE


def brute_pairs(rows, size, least, least_words):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(least_words, size):
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.integers(len(w))] = "edit" + str(rng.integers(1000))
    return " ".join(w)


@pytest.mark.parametrize("chunk", [near_dup.CHUNK, 5])
def test_near_duplicates_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for seed in range(12):
        base = " ".join(P.body(seed, 12))
        for k in (0, 0, 2, 4, 30):
            n += 1
            rows.append((n, edited(rng, base, k)))
    rows += [(900, None), (901, ""), (902, "short text"), (1, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("text", "text")
    members, links = near_dup.near_duplicates(df, size=3, least=0.7, least_words=50)
    got = found(near_dup.all_pairs(members, links))
    assert got == brute_pairs(dict(rows).items(), 3, 0.7, 50)
    groups = {r["id"]: r for r in near_dup.groups(members, links).collect()}
    for a, b in got:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    assert groups[1]["links"] == sum(1 in pair for pair in got)
    assert near_dup.all_pairs(*near_dup.near_duplicates(df.limit(0))).count() == 0


def test_tree_finds_all_within_radius():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, (2, 600), dtype=np.uint64)
    f[:, 300:] = f[:, :300] ^ (np.uint64(1) << rng.integers(0, 60, 300).astype(np.uint64))
    f[:, 590:] = f[:, [3]]
    everyone = np.arange(600)
    got = {(min(a, b), max(a, b)) for q, n in near_dup.tree_pairs(f, everyone) for a, b in zip(q.tolist(), n.tolist()) if a != b}
    d = np.bitwise_count(f[0][:, None] ^ f[0][None]).astype(int) + np.bitwise_count(f[1][:, None] ^ f[1][None])
    a, b = np.nonzero(np.triu(d <= near_dup.RADIUS, 1))
    assert got == set(zip(a.tolist(), b.tolist()))


def test_site_lines(spark):
    rows = P.site(12) + P.site(3, "b.example")[:0]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, page_url string")
    blocks = blocks_of(spark, rows)
    extra = spark.createDataFrame([(1, 90, "12 — 34", 2), (1, 91, None, 0), (1, 90, "12 — 34", 2)], blocks.schema)
    blocks = blocks.unionByName(extra)
    got = found(site_lines.find_repeated(pages, blocks))
    text = {(i, b.ord): b.text for i, _, h in rows for b in extract_blocks(h)}
    # titles differ in digits only, so they are one line
    assert {re.sub("[0-9]+", "#", text[k]) for k in got} == {"Title # | Site", "Home", "About us", "Written by Ana Bell", "Share this page with a friend", "All rights reserved by the site owners."}
    assert len(got) == 6 * 12
    patterns = site_lines.sequences(pages, blocks).collect()
    assert max(r["length"] for r in patterns) == 6 and all(r["support"] == 12 for r in patterns)
    clean = {r["page_id"]: r["text"] for r in site_lines.cleaned_pages(pages, blocks).collect()}
    assert "Share this" not in clean[2] and P.body(2)[0] in clean[2]
    assert site_lines.find_repeated(pages, blocks.limit(0)).count() == 0


def test_body_blocks_keep_order_and_drop_repeats(spark):
    rows = [(1, 2, "c", 1), (1, 0, "a", 1), (1, 1, "b", 1), (1, 1, "b", 1), (2, 0, None, 0)]
    df = spark.createDataFrame(rows, "page_id long, block_ord int, text string, word_count int")
    bad = spark.createDataFrame([(1, 0), (1, -1)], "page_id long, block_ord int")
    got = bodies.body_blocks(df, bad).select("page_id", bodies.joined_text().alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, "b c")]


EASY = "The cat sat on the mat. We ran to the big red bus. I like my dog and he likes me. "
HARD = "Institutional methodologies necessitate comprehensive interdisciplinary reconsideration, notwithstanding considerable organisational complexity. "
PLAIN = "The company opened a new office in the town last summer, although many people had asked for a later date. "


def test_reading_levels(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(180):
        band = ("easy", "plain", "hard")[i % 3]
        text = {"easy": EASY, "plain": PLAIN, "hard": HARD}[band] * int(rng.integers(4, 9))
        rows.append((i, f"h{i % 11}.example", text))
        if i % 2 == 0:
            labels.append((i, "plain" if i == 0 else band))
    labels += [(1, None), (3, "unknown"), (4, labels[2][1])]
    feats = reading_level.body_features(spark.createDataFrame(rows, "page_id long, host string, text string"))
    grader = reading_level.train(feats, spark.createDataFrame(labels, "page_id long, band string"))
    got = {r["page_id"]: r["band"] for r in reading_level.levels(feats, grader).collect()}
    assert all(got[i] == ("easy", "plain", "hard")[i % 3] for i in range(180))
    assert sum(r[1] for r in grader.report) == 90
    bare = reading_level.train(feats, spark.createDataFrame([], "page_id long, band string"))
    assert bare.model is None
    assert {r["page_id"]: r["band"] for r in reading_level.levels(feats, bare).collect()}[2] == "hard"


def test_features_of_nothing():
    import pyarrow as pa

    x = reading_level.features(pa.array(["", None, "?!", "One word"]))
    assert x.shape == (4, len(reading_level.FEATURES)) and not x[:3, 0].any() and np.isfinite(x).all()
    assert reading_level.features(pa.array([], pa.string())).shape == (0, len(reading_level.FEATURES))
