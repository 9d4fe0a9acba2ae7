"""Near-duplicate pages with small edits, by vantage-point trees over fingerprints.

A body's fingerprint is one bit of each of ``HASHES`` minima over its distinct
word sequences; the Hamming distance of two fingerprints estimates how unlike
the bodies are.  On the whole fingerprint all unlike bodies are about equally
far from any vantage point, so one tree could prune nothing; the minima are
therefore cut into bands, and a shard holds the bodies at distance 0 in a band.
Every body is in ``BANDS`` shards, which so overlap.  Within a shard a
vantage-point tree over whole fingerprints answers which bodies lie within
``RADIUS`` bits, and prunes branches by triangle bounds.  A shard beyond
``CHUNK`` bodies is cut into chunks that are searched pair by pair, so that no
task grows with a hot shard and no pair is lost.  The pairs found are checked
exactly on their word sequences.

Bodies with equal sets of sequences are one class; a class is searched once.
The chance to miss a pair of similarity 0.7 is (1 - 0.7^4)^24 = 0.14 %, of 0.8
under 0.001 %.

Null and empty texts and bodies under ``least_words`` words match nothing;
repeated ids count once; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.simhash import hash_strings
from folioforge.operators.graph import connected_components
from folioforge.sources import keep

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
RADIUS = 32
LEAF = 24
CHUNK = 4096

_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("cls", T.LongType()),
        T.StructField("shingles", T.ArrayType(T.LongType(), False)),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("f0", T.LongType()),
        T.StructField("f1", T.LongType()),
    ]
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with enough words, distinct sequence hashes of all of them, number of each)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "))
    lists = pc.split_pattern(spaced, " ")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = hash_strings(pc.list_flatten(lists))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ok = lengths >= max(least_words, size)
    n = len(hashes) - size + 1
    if n <= 0 or not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seq = np.zeros(n, np.uint64)
    for k in range(size):
        seq = mixed(seq + hashes[k : k + n] * _MIX[1] + np.uint64(k + 1) * _MIX[2])
    whole = (owner[:n] == owner[size - 1 :]) & ok[owner[:n]]
    owner, seq = owner[:n][whole], seq[whole]
    order = np.lexsort((seq, owner))
    owner, seq = owner[order], seq[order]
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (seq[1:] != seq[:-1]))) if len(seq) else np.zeros(0, bool)
    owner, seq = owner[first], seq[first]
    which, counts = np.unique(owner, return_counts=True)
    return which, seq, counts


def fingerprints(seq: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands as int64, two words of fingerprint bits) of each set."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    minima = np.empty((HASHES, len(counts)), np.uint64)
    for k in range(HASHES):
        minima[k] = np.minimum.reduceat(seq * _MUL[k] + _ADD[k], starts)
    top = mixed(minima)
    bits = (top >> np.uint64(63)).astype(np.uint64)
    f = np.zeros((2, len(counts)), np.uint64)
    for k in range(HASHES):
        f[k // 64] |= bits[k] << np.uint64(k % 64)
    bands = np.zeros((BANDS, len(counts)), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(counts), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mixed(acc * _MIX[1] + top[b * ROWS + r])
        bands[b] = acc
    return bands.T.astype(np.int64), f.astype(np.int64)


def describe(bodies: DataFrame, size: int, least_words: int) -> DataFrame:
    """:data:`SETS` of ``id, text`` rows with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                which, seq, counts = shingle_sets(part.column(1), size, least_words)
                if not len(which):
                    continue
                bands, f = fingerprints(seq, counts)
                starts = np.concatenate(([0], np.cumsum(counts)))
                cls = mixed(np.add.reduceat(mixed(seq ^ _MIX[2]), starts[:-1]) + counts.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(which)),
                        pa.array(cls.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(seq.astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                        pa.array(f[0]),
                        pa.array(f[1]),
                    ],
                    names=SETS.names,
                )

    return bodies.select("id", "text").mapInArrow(run, SETS)


def distances(f: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(f[0][i] ^ f[0][j]) + np.bitwise_count(f[1][i] ^ f[1][j])).astype(np.int64)


def tree_pairs(f: np.ndarray, members: np.ndarray, left: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``members`` within ``RADIUS``; with ``left``, only those between it and ``members``.

    The members are put into a vantage-point tree, median by median; a branch
    is searched for all queries that its bounds allow at once.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(members, members if left is None else left)]
    while stack:
        nodes, asks = stack.pop()
        if not len(nodes) or not len(asks):
            continue
        if len(nodes) <= LEAF:
            d = (np.bitwise_count(f[0][asks][:, None] ^ f[0][nodes][None]) + np.bitwise_count(f[1][asks][:, None] ^ f[1][nodes][None])).astype(np.int64)
            q, n = np.nonzero(d <= RADIUS)
            out.append((asks[q], nodes[n]))
            continue
        v, rest = nodes[0], nodes[1:]
        d_rest, d_asks = distances(f, v, rest), distances(f, v, asks)
        hit = d_asks <= RADIUS
        out.append((asks[hit], np.full(int(hit.sum()), v)))
        mu = int(np.median(d_rest))
        near = d_rest <= mu
        if near.all():
            lo, hi = int(d_rest.min()), int(d_rest.max())
            if lo == hi:  # nothing to tell apart: search the rest in leaves
                asks = asks[(d_asks >= lo - RADIUS) & (d_asks <= hi + RADIUS)]
                stack += [(rest[k : k + LEAF], asks) for k in range(0, len(rest), LEAF)]
                continue
            mu = hi - 1
            near = d_rest <= mu
        stack.append((rest[near], asks[d_asks <= mu + RADIUS]))
        stack.append((rest[~near], asks[d_asks > mu - RADIUS]))
    return out


def shard_pairs(rows: DataFrame) -> DataFrame:
    """``a, b`` (a < b) within ``RADIUS`` in a common shard; ``rows``: ``shard, side, cls, f0, f1``, sorted by shard.

    ``side`` is 0 for bodies searched among themselves, 1 and 2 for the two
    chunks of a cut shard that are searched against each other.
    """

    def search(shard: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = shard.column("shard").to_numpy()
        side = shard.column("side").to_numpy()
        ids = shard.column("cls").to_numpy()
        f = np.stack((shard.column("f0").to_numpy(), shard.column("f1").to_numpy())).astype(np.uint64)
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        sizes = ends - starts
        plain = np.maximum.reduceat(side, starts) == 0 if len(key) else np.zeros(0, bool)
        # most shards are pairs and triples: all at once
        for n in range(2, LEAF + 1):
            at = starts[(sizes == n) & plain]
            for i in range(n):
                for j in range(i + 1, n):
                    ok = distances(f, at + i, at + j) <= RADIUS if len(at) else np.zeros(0, bool)
                    yield ids[at[ok] + i], ids[at[ok] + j]
        for lo, hi in zip(starts[(sizes > LEAF) | ~plain], ends[(sizes > LEAF) | ~plain]):
            here = np.arange(lo, hi)
            one, two = here[side[lo:hi] == 1], here[side[lo:hi] == 2]
            found = tree_pairs(f, here) if side[lo] == 0 else tree_pairs(f, two, one)
            for q, n in found:
                yield ids[q], ids[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not batch.num_rows:
                return
            got = list(search(batch))
            a = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in got]) if got else np.zeros(0, np.int64)
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack((low, high))[:, low < high], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            key = whole.column("shard").to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last shard may go on
            if end:
                yield from flush(whole.slice(0, end))
            held = [whole.slice(end)]
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select("shard", "side", "cls", "f0", "f1").mapInArrow(run, "a long, b long")


def shards(classes: DataFrame) -> list[DataFrame]:
    """``shard, side, cls, f0, f1`` of all classes in shards of two or more, none beyond two chunks.

    The first table holds the shards of usual size, the second the chunks of
    the large ones.  Sizes are counted with partial sums, so a hot shard is never
    whole in one task.
    """
    rows = classes.select("cls", "f0", "f1", F.explode("bands").alias("band"))
    hot = rows.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = keep(hot, "hot")
    usual = rows.join(hot, "band", "left_anti")
    one = usual.select(F.col("band").alias("shard"), F.lit(0).alias("side"), "cls", "f0", "f1").repartition("shard")
    large = rows.join(hot, "band").withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    # chunk c meets every chunk: itself, those after it as the first side, those before it as the second
    met = large.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cut = met.select(
        F.xxhash64("band", F.least("c", "o"), F.greatest("c", "o")).alias("shard"),
        F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"),
        "cls", "f0", "f1",
    )
    return [one.sortWithinPartitions("shard"), cut.repartition("shard").sortWithinPartitions("shard")]


def class_links(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(``id, cls`` of all bodies, ``a, b, similarity`` of linked classes); ``sets`` kept, ids distinct."""
    members = sets.select("id", "cls")
    several = members.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    copies = members.join(several.select("cls", "first"), "cls").where("id <> first").select("id")
    # the sets stay where they are: only the ids of copies travel
    classes = sets.join(copies, "id", "left_anti")
    near = keep(reduce(DataFrame.unionByName, map(shard_pairs, shards(classes))).dropDuplicates(["a", "b"]), "near")
    # only the sets of classes with a candidate travel
    wanted = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).dropDuplicates(["cls"])
    chosen = classes.select("cls", "shingles").join(wanted, "cls", "left_semi")
    left = chosen.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = chosen.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both / (F.size("sa") + F.size("sb") - both)
    links = near.join(left, "a").join(right, "b").select("a", "b", similar.alias("similarity")).where(F.col("similarity") >= least)
    return members, keep(links, "links")


def near_duplicates(
    bodies: DataFrame, size: int = 5, least: float = 0.8, least_words: int = 0, distinct_ids: bool = False
) -> tuple[DataFrame, DataFrame]:
    """:func:`class_links` of ``id, text`` rows; ``distinct_ids`` says that no id comes twice."""
    own = bodies if distinct_ids else bodies.select("id", "text").dropDuplicates(["id"])
    sets = keep(describe(own, size, least_words), "sets")
    return class_links(sets, least)


def salted(members: DataFrame, wanted: DataFrame, cls: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The bodies ``name`` of the classes in ``wanted`` (``cls, k``: class and size): as they
    are, cut in ``CHUNK`` bodies a part, and with ``part`` for the number of parts.

    A hot class is so joined part by part, and no task gets all of it.
    """
    parts = wanted.select(F.col("cls").alias(cls), F.ceil(F.col("k") / CHUNK).alias("parts"))
    rows = members.select(F.col("id").alias(name), F.col("cls").alias(cls)).join(parts, cls)
    return rows.withColumn("part", F.pmod(F.xxhash64(name), "parts")), parts


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b`` (a < b): all linked bodies and all copies, written out."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("k"))
    several = sizes.where("k > 1")
    right, _ = salted(members, several, "c", "y")
    left = right.select(F.col("y").alias("x"), "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    same = left.join(right.select("c", "part", "y"), ["c", "part"]).where("x < y").select("x", "y")
    # over a link, the bodies of the one class meet the parts of the other
    right, parts = salted(members, sizes.join(links.select(F.col("b").alias("cls")).dropDuplicates(), "cls", "left_semi"), "b", "y")
    met = links.select("a", "b").join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    one = members.select(F.col("id").alias("x"), F.col("cls").alias("a"))
    over = met.select("a", "b", "part").join(one, "a").join(right.select("b", "part", "y"), ["b", "part"]).select("x", "y")
    return same.unionByName(over).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, cls, group_id, links``: class, connected group and number of linked bodies of each body."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("k"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("k").alias("over"))
    parts = connected_components(links, "a", "b").select(F.col("node").alias("cls"), "component")
    return (
        members.join(sizes, "cls")
        .join(linked, "cls", "left")
        .join(parts, "cls", "left")
        .select("id", "cls", F.coalesce("component", "cls").alias("group_id"), (F.col("k") - 1 + F.coalesce("over", F.lit(0))).alias("links"))
    )
