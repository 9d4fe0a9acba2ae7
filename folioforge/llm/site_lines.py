"""Lines repeated across one site's documents, by PrefixSpan over line sequences.

A page is the sequence of its blocks' line identifiers (letters in lower case,
hashed).  Frequent single lines are found first; each longer pattern is grown
from the projected database of its prefix: every later frequent line of the
pages that hold the prefix may extend it, whatever stands between, until no
pattern is left to grow.  A pattern is frequent on at least ``LEAST_PAGES`` pages of its site and on
one in ``ONE_IN`` of the site's pages that have blocks.  The blocks to delete are
all occurrences of the lines of frequent patterns, single lines included: all
patterns are grown, those with equal projected databases as one, and the last
line of each is marked.

Hosts are mined side by side, a large host by the first line of its patterns; a
projected database is a set of bits, one a page.  All frequent sequences are
given, and a page of n frequent lines has 2^n - 1, so the result outgrows the
input where many lines return in one order.  Blocks without letters and null
texts are no lines; repeated rows count once; a page without address belongs to
the site named by the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.urls import page_host
from folioforge.sources import keep

LEAST_PAGES = 5
ONE_IN = 10
#: Pages of a host that are mined in one task.
WHOLE_PAGES = 1000
#: Numbers in an array while mining, and rows in a batch of results.
CELLS = 1 << 20
OUT_ROWS = 1 << 16

_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5, _SEED = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5), np.uint64(42)


def line_rows(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``page_id, block_ord, host, line`` of blocks with letters, ``host, need`` pages for a frequent line)."""
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "")
    own = blocks.select("page_id", "block_ord", F.when(F.length(letters) > 0, F.xxhash64(letters)).alias("line"))
    hosts = pages.select("page_id", F.coalesce(page_host("page_url"), F.lit("")).alias("host")).dropDuplicates(["page_id"])
    rows = own.join(hosts, "page_id").dropDuplicates(["page_id", "block_ord"])
    return rows, hosts


def frequent_lines(rows: DataFrame) -> DataFrame:
    """``host, line, support`` of the frequent single lines."""
    once = rows.groupBy("host", "line", "page_id").agg(F.lit(1).alias("one"))
    counted = once.groupBy("host", "line").agg(F.count("*").alias("support"))
    sizes = rows.groupBy("host", "page_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    return (
        counted.where(F.col("line").isNotNull() & (F.col("support") >= LEAST_PAGES))
        .join(sizes, "host")
        .where(F.col("support") * ONE_IN >= F.col("pages"))
    )


def find_repeated(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page_id, block_ord`` of the blocks that hold a line of a frequent sequence, mined whole."""
    rows, _ = line_rows(pages, blocks)
    rows = keep(rows, "lines")
    lines = sequence_lines(rows)
    return rows.join(lines, ["host", "line"], "left_semi").select("page_id", "block_ord")


def sequence_lines(rows: DataFrame) -> DataFrame:
    """``host, line`` of the frequent sequences, each marked by its last line; a line inside a sequence ends its beginning, which is frequent too."""
    return _projected(rows).mapInArrow(_mark_groups, "host string, line long").distinct()


def hash_long(values: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, as unsigned numbers; ``seed`` is 42 or the hash so far."""
    h = values * _P2
    h = (h << np.uint64(31) | h >> np.uint64(33)) * _P1 ^ (seed + _P5 + np.uint64(8))
    h = (h << np.uint64(27) | h >> np.uint64(37)) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


class _Projection:
    """Which pages hold line ``b`` after line ``a``, for all pages of a group.

    A page without repeated lines is one bit of ``after[a, b]``: it holds a
    sequence exactly if it holds every two neighbours of it in order.  For the
    other pages ``step`` gives the place behind the next ``b`` from any place.
    """

    def __init__(self, pages: list[np.ndarray]) -> None:
        flat = np.concatenate(pages)
        self.lines, ids = np.unique(flat, return_inverse=True)
        n = len(self.lines)
        cut = np.split(ids, np.cumsum([len(p) for p in pages])[:-1])
        once = [c for c in cut if len(np.unique(c)) == len(c)]
        odd = [c for c in cut if len(np.unique(c)) < len(c)]
        per = max(64, CELLS // (n * n) // 64 * 64)
        after, holds = [], []
        for lo in range(0, max(len(once), 1), per):
            part = once[lo : lo + per]
            none = np.iinfo(np.int32).max
            at = np.full((n, -(-max(len(part), 1) // 64) * 64), none, np.int32)
            for k, c in enumerate(part):
                at[c, k] = np.arange(len(c), dtype=np.int32)
            held = at != none
            after.append(np.packbits((at[:, None] < at[None, :]) & held[None, :], axis=-1).view(np.uint64))
            holds.append(np.packbits(held, axis=-1).view(np.uint64))
        self.after, self.holds = np.concatenate(after, axis=-1), np.concatenate(holds, axis=-1)
        self.dead = max(map(len, odd), default=0) + 1
        self.step = np.full((len(odd), self.dead + 1, n), self.dead, np.int32)
        for r, c in enumerate(odd):
            for k in range(len(c) - 1, -1, -1):
                self.step[r, k] = self.step[r, k + 1] if k + 1 < len(c) else self.dead
                self.step[r, k, c[k]] = k + 1


def grow(pages: list[np.ndarray], first: int | None, need: int, merge: bool = False) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(pattern, length, support, pattern without its last line, last line) of all sequences on at least ``need`` of ``pages``, any lines between allowed.

    ``first``: only those that begin with this line.  Prefixes are grown until
    none is left, depth first in blocks, so memory does not grow with the patterns.

    ``merge``: of prefixes with one last line and one projected database (told by a
    hash of 64 bits), whose continuations are the same, only the first is given and
    grown; memory then holds a number for each that differs.
    """
    seen: set[int] = set()
    x = _Projection(pages)
    rows = np.arange(len(x.step))
    words = x.after.shape[-1]
    size = max(1, CELLS // (len(x.lines) * (words + len(rows))))
    keys = x.lines.view(np.uint64)
    roots = np.arange(len(x.lines)) if first is None else np.flatnonzero(x.lines == first)
    where = x.step[:, 0, roots].T
    support = np.bitwise_count(x.holds[roots]).sum(-1, dtype=np.int64) + (where != x.dead).sum(-1)
    good = support >= need
    roots, support = roots[good], support[good]
    pattern = hash_long(keys[roots], _SEED)
    yield pattern, 1, support, np.zeros(len(roots), np.uint64), keys[roots]
    stack = [(1, roots, x.holds[roots], where[good], pattern)]
    while stack:
        length, last, bits, where, pattern = stack.pop()
        if len(last) > size:
            stack.append((length, last[size:], bits[size:], where[size:], pattern[size:]))
            last, bits, where, pattern = last[:size], bits[:size], where[:size], pattern[:size]
        held = bits[:, None, :] & x.after[last]
        count = np.bitwise_count(held)
        support = count[..., 0].astype(np.int64) if words == 1 else count.sum(-1, dtype=np.int64)
        if len(rows):
            to = x.step[rows[None, :], where]
            support += (to != x.dead).sum(1)
        i, b = np.nonzero(support >= need)
        if merge and len(i):
            state = hash_long(b.astype(np.uint64), _SEED)
            for part in (held[i, b].T, to[i, :, b].T if len(rows) else ()):
                for word in part:
                    state = hash_long(word.astype(np.uint64), state)
            state, at = np.unique(state, return_index=True)
            new = [k for k, v in zip(at.tolist(), state.tolist()) if v not in seen]
            seen.update(state.tolist())
            i, b = i[new], b[new]
        if len(i):
            longer = hash_long(keys[b], hash_long(pattern[i], _SEED))
            yield longer, length + 1, support[i, b], pattern[i], keys[b]
            stack.append((length + 1, b, held[i, b], to[i, :, b] if len(rows) else where[i], longer))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, int, list[np.ndarray]]]:
    """(host, first, need, pages) of each run of rows with one ``host, first``."""
    key, need, pages = None, 0, []
    for batch in batches:
        hosts, firsts, needs = (batch.column(i).to_pylist() for i in range(3))
        for k in range(batch.num_rows):
            if (hosts[k], firsts[k]) != key:
                if pages:
                    yield *key, need, pages
                key, need, pages = (hosts[k], firsts[k]), needs[k], []
            pages.append(batch.column(3)[k].values.to_numpy())
    if pages:
        yield *key, need, pages


def _grow_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns of each group."""
    for host, first, need, pages in _groups(batches):
        for pattern, length, support, prefix, last in grow(pages, first, need):
            for lo in range(0, len(pattern), OUT_ROWS):
                part = pattern[lo : lo + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(host, pa.string()), len(part)), pa.array(part.view(np.int64)), pa.repeat(pa.scalar(length, pa.int32()), len(part)), pa.array(support[lo : lo + OUT_ROWS]),
                     pa.array(prefix[lo : lo + OUT_ROWS].view(np.int64)), pa.array(last[lo : lo + OUT_ROWS].view(np.int64))],
                    names=["host", "pattern", "length", "support", "prefix", "line"],
                )


def _mark_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last lines of each group's patterns; equal projected databases are grown once."""
    for host, first, need, pages in _groups(batches):
        lines = np.unique(np.concatenate([last for *_, last in grow(pages, first, need, merge=True)])).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(host, pa.string()), len(lines)), pa.array(lines)], names=["host", "line"])


def sequences(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``host, pattern, length, support, prefix, line`` of all frequent sequences, whatever stands between their lines.

    A pattern is named by the hash of its lines in order; ``prefix`` is the pattern
    without its last line ``line`` (0 for single lines), so a pattern can be read
    back line by line; :func:`line_texts` gives their texts.
    """
    rows, _ = line_rows(pages, blocks)
    return _projected(keep(rows, "lines")).mapInArrow(_grow_groups, "host string, pattern long, length int, support long, prefix long, line long")


def _projected(rows: DataFrame) -> DataFrame:
    """``host, first, need, seq``: the frequent lines of each page in order, groups that are mined together side by side."""
    single = keep(frequent_lines(rows), "frequent")
    need = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") / ONE_IN)).cast("int").alias("need")
    pair = F.array_sort(F.collect_list(F.struct("block_ord", "line")))
    seqs = (
        rows.join(single.select("host", "line", need, "pages"), ["host", "line"])
        .groupBy("host", "page_id")
        .agg(F.first("need").alias("need"), F.first("pages").alias("pages"), F.transform(pair, lambda b: b["line"]).alias("seq"))
    )
    # a large host is cut by the first line of its patterns, each with what follows it on its pages
    firsts = F.when(F.col("pages") > WHOLE_PAGES, F.array_distinct("seq")).otherwise(F.array(F.lit(None).cast("long")))
    left = F.expr("CASE WHEN first IS NULL THEN seq ELSE slice(seq, CAST(array_position(seq, first) AS INT), size(seq)) END")
    cut = seqs.withColumn("first", F.explode(firsts)).select("host", "first", "need", left.alias("seq"))
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(parts, "host", "first").sortWithinPartitions("host", "first")


def line_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``host, line, support, text`` of the frequent single lines, with the first of their spellings."""
    rows, _ = line_rows(pages, blocks)
    rows = keep(rows, "lines")
    lines = frequent_lines(rows).select("host", "line", "support")
    where = rows.join(lines, ["host", "line"], "left_semi").groupBy("host", "line").agg(F.min(F.struct("page_id", "block_ord")).alias("at"))
    texts = blocks.select("page_id", "block_ord", "text").dropDuplicates(["page_id", "block_ord"])
    return where.select("host", "line", "at.*").join(texts, ["page_id", "block_ord"]).join(lines, ["host", "line"]).select("host", "line", "support", "text")


def cleaned_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page_id, text``: each page's blocks, without the repeated lines, in order."""
    bad = find_repeated(pages, blocks)
    left = blocks.select("page_id", "block_ord", "text").dropDuplicates(["page_id", "block_ord"]).join(bad, ["page_id", "block_ord"], "left_anti")
    return left.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda b: b["text"]), "\n").alias("text")
    )
