"""Results against plain exhaustive search, where a cut would leave something out."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions.html_blocks import extract_blocks
from folioforge.llm import boilerplate, page_profile, queries, residue, residue_text, site_lines
from tests.llm import pages as P
from tests.llm.test_pages import found


def brute_sequences(pages):
    """All frequent sequences of lines of one site, by every choice of places."""
    support = {}
    for seq in pages:
        for p in {p for n in range(1, len(seq) + 1) for p in itertools.combinations(seq, n)}:
            support[p] = support.get(p, 0) + 1
    need = max(site_lines.LEAST_PAGES, -(-len(pages) // site_lines.ONE_IN))
    return {p: n for p, n in support.items() if n >= need}


def lines_tables(spark, sites):
    pages, blocks = [], []
    for host, seqs in sites.items():
        for seq in seqs:
            pages.append((len(pages), f"https://{host}/{len(pages)}"))
            blocks += [(pages[-1][0], k, line) for k, line in enumerate(seq)]
    return spark.createDataFrame(pages, "page_id long, page_url string"), spark.createDataFrame(blocks, "page_id long, block_ord int, text string")


@pytest.mark.parametrize("whole", [site_lines.WHOLE_PAGES, 12])
def test_sequences_with_gaps_and_repeats_against_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(site_lines, "WHOLE_PAGES", whole)
    rng = random.Random(4)
    sites = {h: [[rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(1, 8))] for _ in range(n)] for h, n, k in (("a.example", 14, 4), ("b.example", 9, 8))}
    sites["c.example"] = [rng.sample("abcdefgh", 6) for _ in range(70)]
    tables = lines_tables(spark, sites)
    rows = site_lines.sequences(*tables).collect()
    got = {tuple(r)[:4] for r in rows}
    # a pattern is read back by its prefixes
    texts = {(r["host"], r["line"]): r["text"] for r in site_lines.line_texts(*tables).collect()}
    by = {(r["host"], r["pattern"]): r for r in rows}
    back = set()
    for r in rows:
        lines, at = [], r
        while at is not None:
            lines.append(texts[at["host"], at["line"]])
            at = by[at["host"], at["prefix"]] if at["length"] > 1 else None
        back.add((r["host"], tuple(reversed(lines)), r["support"]))
    assert back == {(h, tuple(p), n) for h, seqs in sites.items() for p, n in brute_sequences(seqs).items()}
    want = set()
    for host, seqs in sites.items():
        rows = [(host, list(p), len(p), n) for p, n in brute_sequences(seqs).items()]
        df = spark.createDataFrame(rows, "host string, p array<string>, length int, support long").withColumn("lines", F.transform("p", lambda x: F.xxhash64(x)))
        chained = F.aggregate(F.slice("lines", 2, 99), F.xxhash64(F.col("lines")[0]), lambda h, l: F.xxhash64(h, l))
        want |= found(df.select("host", chained.alias("pattern"), "length", "support"))
    assert got == want and max(r[2] for r in got) > 2


def test_sequences_longer_than_eight(spark):
    lines = ["line " + c for c in "abcdefghijkl"]
    rows = site_lines.sequences(*lines_tables(spark, {"a.example": [lines] * 5 + [[]]})).collect()
    assert len({r["pattern"] for r in rows}) == len(rows) == 2**12 - 1
    assert max(r["length"] for r in rows) == 12 and all(r["support"] == 5 for r in rows)


def test_hash_of_longs_is_that_of_spark(spark):
    values = np.array([0, 1, -1, 2**63 - 1, -(2**63), 1234567890123], np.int64)
    got = site_lines.hash_long(values.view(np.uint64), np.uint64(42)).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    assert [r[0] for r in df.select(F.xxhash64("v")).collect()] == got.tolist()


def near_sentences(spark, sentences):
    """The sentences of a list that get a label, by the operator."""
    import pyarrow as pa

    cut = page_profile.sentences_of(pa.array(sentences))
    owner, slots, words = page_profile._near(cut)
    rows = list(zip(range(len(owner)), slots.to_pylist(), words.to_pylist()))
    labels = {r["key"] for r in residue.labelled_sentences(spark.createDataFrame(rows, "key long, slots array<int>, folded string")).collect()}
    return {sentences[i] for k, i in enumerate(owner.tolist()) if k in labels}


def similar(a, b):
    a, b = set(a.split()), set(b.split())
    return 5 * len(a & b) >= 4 * len(a | b)


def test_every_similar_sentence_gets_the_label(spark):
    rng = random.Random(6)
    seeds, cases = page_profile.seeds().folded, set()
    for m in seeds:
        for _ in range(12):
            w = m.split()
            for _ in range(rng.choice((1, 1, 2, 3))):
                w.insert(rng.randrange(len(w) + 1), "".join(rng.choices("abcdefghijklmnop", k=6)))
            cases.add(" ".join(w))
    cases = sorted(cases)
    graph = {c for c in cases if any(similar(c, m) for m in seeds)}
    while more := {c for c in cases if c not in graph and any(similar(c, g) for g in graph)}:
        graph |= more
    assert 0 < len(graph) < len(cases)
    assert near_sentences(spark, cases) == graph


def test_labels_walk_far_from_the_message(spark):
    message = "the page you are looking for does not exist"
    assert message in page_profile.seeds().folded
    chain, words = [], message.split()
    for new in ("newa", "newb", "newc", "newd", "newe"):  # one word more, then one of the message less
        chain.append(" ".join([*words, new]))
        words = [*words[1:], new]
        chain.append(" ".join(words))
    assert all(similar(a, b) for a, b in zip([message, *chain], chain)) and not similar(chain[-1], message)
    assert near_sentences(spark, [*chain, "nothing of the kind is said here"]) == set(chain)


def test_collections_without_the_found_rows(spark, data_dir):
    q = queries.queries()
    odd = found(q["p2_found"](spark, data_dir))
    whole = {i for i, o in odd if o == -1}
    blocks = {(r["page_id"], r["block_ord"]): r["text"] for r in spark.read.parquet(f"{data_dir}/blocks_in.parquet").collect()}
    pages = {r["page_id"] for r in spark.read.parquet(f"{data_dir}/pages_in.parquet").select("page_id").collect()}
    left = q["p2_cleaned"](spark, data_dir).collect()
    assert sorted((r["page_id"], r["block_ord"]) for r in left) == sorted(k for k in blocks if k not in odd and k[0] not in whole)
    assert all(r["text"] == blocks[r["page_id"], r["block_ord"]] for r in left) and len(left) < len(blocks)
    assert sorted(r["page_id"] for r in q["p2_cleaned_pages"](spark, data_dir).collect()) == sorted(pages - whole)
    bad = found(q["p5_found"](spark, data_dir))
    want = {}
    for k in sorted(k for k, t in blocks.items() if k not in bad and t is not None):
        want.setdefault(k[0], []).append(blocks[k])
    assert found(q["p5_bodies"](spark, data_dir)) == {(i, " ".join(t)) for i, t in want.items()}


def test_whole_pages_leave_both_collections(spark):
    found_rows = spark.createDataFrame([(1, -1), (1, 0), (2, 3)], "page_id long, block_ord int")
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 3, "c"), (2, 4, "d"), (2, 4, "d"), (3, 0, None)], "page_id long, block_ord int, text string")
    assert found(residue.cleaned_blocks(blocks, found_rows)) == {(2, 4, "d"), (3, 0, None)}
    pages = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "page_id long, html string")
    assert sorted(map(tuple, residue.cleaned_pages(pages, found_rows).collect()), key=str) == [(2, "y"), (3, None)]


def test_held_out_messages_are_learned(spark):
    """Messages in no seed: found where they stand alone on several hosts, then wherever else they stand."""
    messages = ["Nothing answers at this door today.", "Ce rayon dort encore un peu.", "Der Laden schläft noch, klopfen hilft nicht."]
    assert not any(residue_text.contains_field(m) for m in messages)
    rows, want, n = [], set(), 0
    for m in messages:
        for host in "abcd":
            n += 1
            rows.append((n, f"https://{host}.example/{n}", P.html([m], title=f"T{n}")))
            want |= {(n, -1), (n, m)}
    for m in messages:
        n += 1
        rows.append((n, f"https://e.example/{n}", P.html([*P.body(n), m], title=f"T{n}")))
        want.add((n, m))
    n += 1
    rows.append((n, f"https://f.example/{n}", P.html([*P.body(n), "He said that nothing answers at this door today, not even the old dog."], title=f"T{n}")))
    rows += [(100 + i, u, h) for i, u, h in P.site()]
    got = found(residue.find_residue(boilerplate.analyse(spark.createDataFrame(rows, "page_id long, page_url string, html string"))))
    texts = {(i, b.ord): b.text for i, _, h in rows for b in extract_blocks(h)}
    assert {(i, texts.get((i, o), o)) for i, o in got} == want
