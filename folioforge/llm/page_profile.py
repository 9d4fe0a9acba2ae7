"""One pass over the pages: everything that the operators on page bodies share.

Each page gives one compact row: host, declared language and, for each block in
page order, its place (main container or not), line key, word count and tokens;
further all its sentences, those of headings and noscript notices too.
Lines damaged by a wrong encoding are compared in their repaired form.  Texts
are read whole.  Pages without html have no row; repeated pages give one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.html_blocks import extract_blocks
from folioforge.functions.urls import page_host
from folioforge.llm import residue_text
from folioforge.llm.encoding_repair import repair
from folioforge.llm.simhash import fold_words, hash_strings, token_hashes

MAIN, BYLINE, TITLE, FIELD, MESSAGE_TITLE = 1, 2, 4, 8, 16
#: Frequent words of the four languages, last in the order of words, so that they seldom name a slot.
COMMON = """the of a an and to in is it for on that this with as was are be by at from or not but you your we our they he she
de la le les des du et un une en à que qui est pour dans sur pas au il elle nous vous ce se
der die das und ist von zu den dem mit ein eine für auf nicht im es sie wir ich auch
el los las y del una por con para no su al lo como más""".split()
#: Places of sentences that stand in no block: in a heading or noscript notice, and as a part of the title.
NOTICE, TITLE_PART = -2, -3

#: Bodies up to so many words are short.
SHORT_WORDS = 25

_SUSPECT = r"[^\x00-\x{ff}–—‘’“”„…•›‹€→·А-яЁё№™]|[ÂÃÐÑ][^A-Za-z]|[a-zß-ÿ][À-ÖØ-Þ]|[\x{80}-\x{9f}]|[РС][Ѐ-Џѐ-џ°±»«]|[а-яё][А-ЯЁ]"
_BYLINE = re.compile(
    r"^\W*(?:\d+\.\s*)?(?:written by|text:|texto de|\S{1,4}crit par|автор:?)\s+\S+\s+\S+"
    r"|^\W*(?:\d+\.\s*)?(?:by|von|par|por)\s+\S+\s+\S+\s*,\s*(?:staff|redak|r\S{1,4}dac|reda)",
    re.I,
)
_TITLE_TAG = re.compile(r"<title\b", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", re.I | re.S)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)(?:</noscript>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_SENTENCE = r"[.!?…]+[\s\"”»]+|[.!?…]+$"

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("flags", T.ArrayType(T.ByteType(), False)),
        T.StructField("lines", T.ArrayType(T.LongType(), False)),
        T.StructField("words", T.ArrayType(T.IntegerType(), False)),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
        T.StructField("unblocked", T.BooleanType()),
        T.StructField("long_line", T.LongType()),
        T.StructField("marked", T.ArrayType(T.IntegerType(), False)),
        T.StructField(
            "near",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("block_ord", T.IntegerType()),
                        T.StructField("slots", T.ArrayType(T.IntegerType(), False)),
                        T.StructField("folded", T.StringType()),
                    ]
                ),
                False,
            ),
        ),
    ]
)


_COMMON_HASHES = hash_strings(pa.array(COMMON))
_MESSAGE_HASHES = np.unique(token_hashes(fold_words(pa.array(residue_text.MESSAGES)))[0])


def prefix_slots(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all sentences, ends): of n distinct words the first n // 5 + 1 in one order of all words.

    Two sentences that share 0.8 of their words share a slot: each has all but
    a fifth of its words in common with the other, so the first common word in
    the order is among the first n // 5 + 1 words of both.  Any order will do;
    with the words of the messages behind all others, a sentence of a page
    that has some other words shares no slot with a message.
    """
    tier = np.isin(hashes, _MESSAGE_HASHES).astype(np.uint64)
    tier[np.isin(hashes, _COMMON_HASHES)] = 2
    order = hashes >> np.uint64(2) | tier << np.uint64(62)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.lexsort((order, owner))
    order, owner = order[at], owner[at]
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] != order[:-1]) | (owner[1:] != owner[:-1])
    order, owner = order[new], owner[new]
    count = np.bincount(owner, minlength=len(lengths))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    take = np.where(count > 0, count // 5 + 1, 0)
    slots = (order[rank < take[owner]] & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return slots, np.concatenate(([0], np.cumsum(take)))


class Seeds:
    """Trusted messages with their slots."""

    def __init__(self) -> None:
        folded = fold_words(pa.array(residue_text.MESSAGES))
        self.folded = folded.to_pylist()
        slots, ends = prefix_slots(*token_hashes(folded))
        self.slots = [slots[lo:hi].tolist() for lo, hi in zip(ends, ends[1:])]


_SEEDS: list[Seeds] = []


def seeds() -> Seeds:
    if not _SEEDS:
        _SEEDS.append(Seeds())
    return _SEEDS[0]


def line_keys(folded: pa.Array) -> np.ndarray:
    """Key of a line: its letters, without those beside ASCII where enough
    remain, so that damaged and whole copies of a line agree; 0 without letters."""
    joined = pc.replace_substring(folded, " ", "")
    plain = pc.replace_substring_regex(joined, r"[^a-z]+", "")
    enough = pc.greater_equal(pc.multiply(pc.utf8_length(plain), 2), pc.utf8_length(joined))
    keys = hash_strings(pc.if_else(enough, plain, joined)).astype(np.int64)
    return np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, keys)


class Sentences(NamedTuple):
    """Folded sentences of all texts; ``hashes`` and ``lengths`` of their words."""

    owner: np.ndarray
    folded: pa.Array
    hashes: np.ndarray
    lengths: np.ndarray
    texts: pa.Array


def sentences_of(texts: pa.Array) -> Sentences:
    """Every text is cut and folded once; ``texts`` are the folded texts put together again."""
    lists = pc.split_pattern_regex(texts, _SENTENCE)
    folded = fold_words(pc.list_flatten(lists))
    whole = pc.utf8_trim_whitespace(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, folded), " "))
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return Sentences(owner, folded, *token_hashes(folded), whole)


def _near(x: Sentences, least: int = 2) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(text, slots, words) of the sentences of at least ``least`` words."""
    some = x.lengths >= least
    keep = np.flatnonzero(some)
    words = x.folded.take(pa.array(keep))
    slots, ends = prefix_slots(x.hashes[np.repeat(some, x.lengths)], x.lengths[keep])
    return x.owner[keep], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slots)), words


def profile_batch(ids: list[int], hosts: list[str | None], htmls: list[str | None]) -> pa.RecordBatch:
    """Rows of :data:`SCHEMA` for pages with html."""
    pages = [extract_blocks(h) for h in htmls]
    counts = np.fromiter((len(p) for p in pages), np.int64, len(pages))
    texts = pa.array([b.text for p in pages for b in p], pa.string())
    flags = np.zeros(len(texts), np.int8)
    suspect = pc.indices_nonzero(pc.match_substring_regex(texts, _SUSPECT)).to_pylist() if len(texts) else []
    if suspect:
        plain = texts.to_pylist()
        for i in suspect:
            plain[i] = repair(plain[i])[0]
        texts = pa.array(plain, pa.string())
    words = pc.list_value_length(pc.utf8_split_whitespace(texts)).to_numpy(zero_copy_only=False).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
    at = 0
    beside: list[tuple[int, int, str]] = []  # (page, place, text) beside the blocks
    for i, (p, h) in enumerate(zip(pages, htmls)):
        main = [b.ord for b in p if b.in_main]
        if not main:
            main = _without_heading(p, words, at)
        for o in main:
            flags[at + o] |= MAIN
        for o in main[:2]:
            if words[at + o] <= 25 and _BYLINE.match(texts[at + o].as_py()):
                flags[at + o] |= BYLINE
        if p and (p[0].tag == "title" or p[0].heading is None and not p[0].in_main and _TITLE_TAG.search(h)):
            flags[at] |= TITLE
            parts = residue_text.title_parts(texts[at].as_py())
            if parts and residue_text.TITLES.match(parts[0]):
                flags[at] |= MESSAGE_TITLE
            beside += [(i, TITLE_PART, part) for part in parts]
        notices = {b.heading for b in p if b.heading}
        if "noscript" in h or "NOSCRIPT" in h.upper():
            notices |= {_TAG.sub(" ", m[1]) for m in _NOSCRIPT.finditer(h)}
        beside += [(i, NOTICE, n) for n in notices]
        at += len(p)
    unblocked = np.zeros(len(pages), bool)
    of, place_of, said = (list(x) for x in zip(*beside)) if beside else ([], [], [])
    said = pa.array(said, pa.string())
    maybe = pc.match_substring_regex(said, residue_text.MAYBE_FIELD).to_pylist()
    for i, place, text, m in zip(of, place_of, said.to_pylist(), maybe):
        if place == NOTICE and (residue_text.TITLES.match(text) or m and residue_text.contains_field(text)):
            unblocked[i] = True
    if len(texts):
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, residue_text.MAYBE_FIELD)).to_pylist():
            if residue_text.contains_field(texts[i].as_py()):
                flags[i] |= FIELD
    cut = sentences_of(texts)
    folded, hashes = cut.texts, cut.hashes
    lengths = np.bincount(cut.owner, weights=cut.lengths, minlength=len(texts)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    token_ends = np.concatenate(([0], np.cumsum(lengths)))
    owner, slots, near_words = _near(cut)
    page_of = np.searchsorted(ends, owner, side="right") - 1
    place = owner - ends[page_of]
    if beside:
        # titles and notices of one word count too
        owner2, slots2, words2 = _near(sentences_of(said), 1)
        page_of = np.concatenate((page_of, np.array(of)[owner2]))
        order = np.argsort(page_of, kind="stable")
        page_of, place = page_of[order], np.concatenate((place, np.array(place_of)[owner2]))[order]
        slots = pa.concat_arrays([slots, slots2]).take(pa.array(order))
        near_words = pa.concat_arrays([near_words, words2]).take(pa.array(order))
    near_ends = np.searchsorted(page_of, np.arange(len(pages) + 1))

    def listed(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    token_count = lengths.astype(np.int32)
    marked = np.flatnonzero(flags & (FIELD | MESSAGE_TITLE))  # blocks that are residue by themselves
    # the line of the first block of the main container that alone makes a body long; null without
    long = np.flatnonzero(((flags & MAIN) != 0) & ((flags & BYLINE) == 0) & (words > SHORT_WORDS))
    at = np.searchsorted(long, ends[:-1])
    some = (at < len(long)) & (long[np.minimum(at, max(len(long) - 1, 0))] < ends[1:] if len(long) else False)
    keys = line_keys(folded) if len(texts) else np.zeros(0, np.int64)
    long_line = pa.array(keys[long[at[some]]] if some.any() else np.zeros(0, np.int64)).take(pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some)) if some.any() else pa.nulls(len(pages), pa.int64())
    langs = [(m[1].lower() if (m := _LANG.search(h)) else None) for h in htmls]
    struct = pa.StructArray.from_arrays(
        [pa.array(place.astype(np.int32)), slots, near_words],
        names=["block_ord", "slots", "folded"],
    )
    # the tokens of a page come after the token counts of its blocks
    merged_ends = ends + token_ends[ends]
    merged = np.empty(int(merged_ends[-1]), np.int32)
    is_count = np.zeros(len(merged), bool)
    is_count[np.repeat(merged_ends[:-1], counts) + (np.arange(len(token_count)) - np.repeat(ends[:-1], counts))] = True
    merged[is_count] = token_count
    merged[~is_count] = (hashes & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(hosts, pa.string()),
            pa.array(langs, pa.string()),
            listed(pa.array(flags), ends),
            listed(pa.array(keys), ends),
            listed(pa.array(words), ends),
            listed(pa.array(merged), merged_ends),
            pa.array(unblocked, pa.bool_()),
            long_line,
            listed(pa.array((marked - ends[np.searchsorted(ends, marked, side="right") - 1]).astype(np.int32)), np.searchsorted(marked, ends)),
            listed(struct, near_ends),
        ],
        names=SCHEMA.names,
    )


def _without_heading(blocks: list, words: np.ndarray, at: int) -> list[int]:
    """The main container of a page without ``h1``: the one with most long blocks."""
    best: dict[int, int] = {}
    for b in blocks:
        if b.ord and words[at + b.ord] >= 20:
            best[b.container] = best.get(b.container, 0) + int(words[at + b.ord])
    box = max(best, key=lambda k: best[k], default=None)
    if box is None or best[box] < 40:
        return []
    return [b.ord for b in blocks if b.container == box and b.ord]


def profile_pages(pages: DataFrame) -> DataFrame:
    """:data:`SCHEMA` of every page with html, once."""
    own = pages.where("html is not null").select("page_id", F.coalesce(page_host("page_url"), F.lit("")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield profile_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist())

    return own.mapInArrow(run, SCHEMA)


__all__ = ["BYLINE", "FIELD", "MAIN", "MESSAGE_TITLE", "NOTICE", "SCHEMA", "TITLE", "TITLE_PART", "profile_pages", "seeds"]
