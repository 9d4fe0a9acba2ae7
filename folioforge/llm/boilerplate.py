"""Main body of pages against boilerplate, by suffix arrays over each host.

The token streams of a host's pages are concatenated, and the suffixes are
ranked by prefix doubling, within bounded shards: a large host is split by
page, small hosts share a shard, and a token is told apart by its host, so a
repeat never spans hosts or pages.  A line (block) of the main container whose
whole token run is repeated on several pages of its host between unlike
neighbours is evidence; a run shared with its neighbours is a copied article.
Evidence is summed over all shards and hosts: a line found on at least
``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the pages of the hosts that repeat
it is boilerplate everywhere.  An exact check by the page's structure follows:
what stands outside the container of the page's main heading is no body, nor
is a byline under the heading.

Lines compare by letters in lower case, so counters, bullets and capitals do
not hide a repeat.  Pages without html give no rows, repeated pages give each
block once; ties cannot occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.page_profile import BYLINE, FIELD, MAIN, MESSAGE_TITLE, profile_pages
from folioforge.sources import keep

SHARD_PAGES = 2000
LEAST_PAGES = 5
LEAST_SHARE = 0.15
#: Pages with a line must differ in what stands before or after it at least so much.
LEAST_UNLIKE = 0.4

EVIDENCE = "line long, pages long, host_pages long"


def dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def doubled_ranks(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Rank of each suffix by its first 1, 2, 4, ... symbols, up to ``longest``.

    Suffixes that are unique already keep their rank; only the others are
    ranked again, so a round costs what is still repeated.
    """
    ranks = [dense(symbols)]
    n, h = len(symbols), 1
    while 2 * h <= longest:
        rank = ranks[-1]
        counts = np.bincount(rank)
        open_ = np.flatnonzero(counts[rank] > 1)
        if not len(open_):
            break
        second = np.zeros(len(open_), np.int64)
        inside = open_ + h < n
        second[inside] = rank[open_[inside] + h] + 1
        pair = rank[open_] * (n + 2) + second
        # rank in the whole: suffixes of smaller old rank, then smaller pairs
        uniq, inv, per = np.unique(pair, return_inverse=True, return_counts=True)
        below = np.concatenate(([0], np.cumsum(counts)))[rank]
        before = np.concatenate(([0], np.cumsum(per)[:-1]))
        old = uniq // (n + 2)
        first = np.concatenate(([True], old[1:] != old[:-1]))
        base = before[np.maximum.accumulate(np.where(first, np.arange(len(uniq)), 0))]
        nxt = below.copy()
        nxt[open_] += (before - base)[inv]
        ranks.append(dense(nxt))
        h *= 2
    return ranks


def run_classes(ranks: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each run of symbols, equal exactly for equal runs (up to the longest rank's reach from both ends)."""
    level = np.minimum(np.log2(np.maximum(lengths, 1)).astype(np.int64), len(ranks) - 1)
    head = np.zeros(len(starts), np.int64)
    tail = np.zeros(len(starts), np.int64)
    for j, rank in enumerate(ranks):
        at = np.flatnonzero(level == j)
        head[at] = rank[starts[at]]
        tail[at] = rank[starts[at] + np.maximum(lengths[at] - (1 << j), 0)]
    return dense(dense(head * (max(int(tail.max()), 0) + 2) + tail) * (int(lengths.max()) + 1) + lengths) if len(starts) else head


class Shard(NamedTuple):
    """Blocks of a shard in page order, flattened."""

    page: np.ndarray
    host: np.ndarray
    flags: np.ndarray
    lines: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray


def shard_of(table: pa.Table) -> Shard:
    """Flat arrays of a shard; a page delivered twice counts once."""
    ids = table.column("page_id").to_numpy()
    _, first = np.unique(ids, return_index=True)
    if len(first) < len(ids):
        table = table.take(pa.array(np.sort(first)))
    table = table.combine_chunks()
    host_ids = dense(np.asarray(table.column("host").to_pylist(), dtype=object).astype(str)) if table.num_rows else np.zeros(0, np.int64)

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        col = table.column(name).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())

    flags, n = flat("flags")
    lines, _ = flat("lines")
    merged, m = flat("tokens")
    page = np.repeat(np.arange(len(n)), n)
    # a page's list begins with the token counts of its blocks
    begin = np.concatenate(([0], np.cumsum(m)[:-1])) if len(m) else np.zeros(0, np.int64)
    block_begin = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.zeros(0, np.int64)
    at = np.repeat(begin, n) + np.arange(len(page)) - np.repeat(block_begin, n)
    lengths = merged[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
    is_token = np.ones(len(merged), bool)
    is_token[at] = False
    return Shard(page, host_ids[page] if len(page) else page, flags, lines, lengths, merged[is_token])


class Runs(NamedTuple):
    """Token runs of chosen blocks, ranked by the suffixes of their shard."""

    cls: np.ndarray  # equal for equal runs of one host
    pages: np.ndarray  # distinct pages of each class
    host_pages: np.ndarray  # pages of each host of the shard


def distinct_per_class(cls: np.ndarray, other: np.ndarray) -> np.ndarray:
    pairs = np.unique(np.stack((cls, other)), axis=1)[0]
    return np.bincount(pairs, minlength=int(cls.max()) + 1)


def ranked_runs(s: Shard, pick: np.ndarray) -> Runs:
    """The runs of the blocks ``pick``, at least one, over the suffixes of the shard.

    A run lies within its block, so the stream holds the tokens of these blocks alone.
    """
    chosen = np.zeros(len(s.page), bool)
    chosen[pick] = True
    token_block = np.repeat(np.arange(len(s.page)), s.lengths)
    tokens, token_block = s.tokens[chosen[token_block]], token_block[chosen[token_block]]
    lengths = np.where(chosen, s.lengths, 0)
    # symbols: (host, token), and an own separator after each page
    token_page = s.page[token_block]
    symbol = dense(s.host[token_block] * (1 << 32) + tokens.astype(np.int64)) if len(tokens) else np.zeros(0, np.int64)
    pages = int(s.page[-1]) + 1
    top = int(symbol.max()) + 1 if len(symbol) else 0
    where = np.arange(len(symbol)) + token_page
    stream = np.empty(len(symbol) + pages, np.int64)
    stream[where] = symbol
    sep = np.ones(len(stream), bool)
    sep[where] = False
    stream[sep] = top + np.arange(pages)
    block_start = np.concatenate(([0], np.cumsum(lengths)[:-1])) + s.page
    ranks = doubled_ranks(stream, int(s.lengths[pick].max()))
    cls = run_classes(ranks, block_start[pick], s.lengths[pick])
    first_of_page = np.flatnonzero(np.concatenate(([True], s.page[1:] != s.page[:-1])))
    host_pages = np.bincount(s.host[first_of_page], minlength=int(s.host.max()) + 1)
    return Runs(cls, distinct_per_class(cls, s.page[pick]), host_pages)


def line_evidence(s: Shard) -> pa.Table:
    """``EVIDENCE`` of one shard."""
    none = pa.table({"line": pa.array([], pa.int64()), "pages": pa.array([], pa.int64()), "host_pages": pa.array([], pa.int64())})
    pick = np.flatnonzero(((s.flags & MAIN) > 0) & (s.lengths > 1) & (s.lines != 0))
    if not len(pick):
        return none
    cls, page_count, host_pages = ranked_runs(s, pick)
    # neighbours: the line before and after, on the same page
    same_before = np.concatenate(([False], s.page[1:] == s.page[:-1]))
    same_after = np.concatenate((s.page[1:] == s.page[:-1], [False]))
    before = np.where(same_before, np.roll(s.lines, 1), 0)[pick]
    after = np.where(same_after, np.roll(s.lines, -1), 0)[pick]
    unlike = np.maximum(distinct_per_class(cls, dense(before)), distinct_per_class(cls, dense(after)))
    good = (page_count >= 2) & (unlike >= LEAST_UNLIKE * page_count)
    rep = np.full(len(page_count), -1)
    rep[cls] = pick
    chosen = rep[np.flatnonzero(good & (rep >= 0))]
    counts = page_count[np.flatnonzero(good & (rep >= 0))]
    # spellings of a line that differ in damaged letters are one line
    host_line = np.stack((s.host[chosen], s.lines[chosen]))
    uniq, inv = np.unique(host_line, axis=1, return_inverse=True)
    summed = np.bincount(inv.ravel(), weights=counts, minlength=uniq.shape[1]).astype(np.int64)
    return pa.table({"line": uniq[1], "pages": summed, "host_pages": host_pages[uniq[0]].astype(np.int64)})


def outside_counts(s: Shard) -> pa.Table:
    """``blocks, repeated, twice`` of one shard: blocks outside the main container, those whose run stands on
    ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of its host's pages, and those whose run stands on two pages."""
    outside = (s.flags & MAIN) == 0
    pick = np.flatnonzero(outside & (s.lengths > 0))
    repeated = twice = 0
    if len(pick):
        cls, page_count, host_pages = ranked_runs(s, pick)
        n, of = page_count[cls], host_pages[s.host[pick]]
        repeated, twice = int(((n >= LEAST_PAGES) & (n >= LEAST_SHARE * of)).sum()), int((n >= 2).sum())
    return pa.table({"blocks": [int(outside.sum())], "repeated": [repeated], "twice": [twice]})


def sharded(profile: DataFrame) -> DataFrame:
    """``profile`` with the shard of each page, of some ``SHARD_PAGES`` pages."""
    sizes = profile.groupBy("host").agg(F.count("*").alias("n"))
    total = profile.count()
    large = sizes.where(F.col("n") > SHARD_PAGES).select(F.col("host").alias("large_host"), "n")
    buckets = max(1, math.ceil(total / SHARD_PAGES))
    split = F.pmod(F.xxhash64("page_id"), F.ceil(F.col("n") / SHARD_PAGES))
    return profile.join(large, F.col("host") == F.col("large_host"), "left").withColumn(
        "shard",
        F.when(F.col("n").isNull(), F.pmod(F.xxhash64("host"), F.lit(buckets))).otherwise(
            F.xxhash64("host", split).bitwiseOR(F.lit(1 << 62))
        ),
    )


def boilerplate_lines(profile: DataFrame) -> DataFrame:
    """``line`` of each line that is boilerplate."""
    shards = sharded(profile.select("page_id", "host", "flags", "lines", "tokens"))
    found = shards.select("shard", "page_id", "host", "flags", "lines", "tokens").groupBy("shard").applyInArrow(
        lambda t: line_evidence(shard_of(t)), EVIDENCE
    )
    return (
        found.groupBy("line")
        .agg(F.sum("pages").alias("pages"), F.sum("host_pages").alias("host_pages"))
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("host_pages")))
        .select("line")
    )


def evidence_shares(profile: DataFrame) -> DataFrame:
    """One row (none without pages): how many blocks outside the main containers the suffix arrays prove by repetition."""
    shards = sharded(profile.select("page_id", "host", "flags", "lines", "tokens"))
    counts = shards.select("shard", "page_id", "host", "flags", "lines", "tokens").groupBy("shard").applyInArrow(
        lambda t: outside_counts(shard_of(t)), "blocks long, repeated long, twice long"
    )
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blocks", "repeated", "twice"))).where("blocks > 0")


class Pages(NamedTuple):
    """Profile of all pages, each once, and what follows from it."""

    profile: DataFrame
    lines: DataFrame


def analyse(pages: DataFrame) -> Pages:
    """One pass over the html, kept; then the boilerplate lines, kept."""
    profile = keep(profile_pages(pages), "profile")
    return Pages(profile, keep(boilerplate_lines(profile), "lines"))


def block_marks(p: Pages) -> DataFrame:
    """``page_id, block_ord, flags, words, is_body`` of every block, once for each delivery of its page.

    ``is_body``: in the main container, no byline and no boilerplate line.
    """
    rows = p.profile.select("page_id", F.posexplode(F.arrays_zip("flags", "lines", "words")).alias("block_ord", "b")).select(
        "page_id", "block_ord", F.col("b.flags").alias("flags"), F.col("b.lines").alias("line"), F.col("b.words").alias("words")
    )
    inside = (F.col("flags").bitwiseAND(MAIN) != 0) & (F.col("flags").bitwiseAND(BYLINE) == 0)
    known = p.lines.select(F.col("line").alias("bad_line"))
    main = rows.where(inside).join(known, F.col("line") == F.col("bad_line"), "left")
    return (
        rows.where(~inside)
        .select("page_id", "block_ord", "flags", "words", F.lit(False).alias("is_body"))
        .unionByName(main.select("page_id", "block_ord", "flags", "words", F.col("bad_line").isNull().alias("is_body")))
    )


def field_flag() -> Column:
    """Whether a block shows residue by itself."""
    return F.col("flags").bitwiseAND(FIELD | MESSAGE_TITLE) != 0


def find_boilerplate(p: Pages, residue: DataFrame) -> DataFrame:
    """``page_id, block_ord`` of the blocks outside the main body; ``residue``
    holds the blocks that are template residue, which are none of them."""
    # a page delivered twice leaves before its blocks are rows
    once = p.profile.select("page_id", "flags", "lines", "words").dropDuplicates(["page_id"])
    marks = block_marks(p._replace(profile=once)).where(~F.col("is_body")).select("page_id", "block_ord")
    return marks.join(residue.where("block_ord >= 0"), ["page_id", "block_ord"], "left_anti")
