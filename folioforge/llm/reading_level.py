"""Reading level of page bodies by boosted regression trees.

Features of a body: distributions of word length, syllables and sentence
length, vocabulary richness, syntax marks, and cohesion between neighbouring
sentences.  Trees are fitted to the labelled pages (a bounded sample of
``MOST_LABELS``, chosen by hash) with the middle school year of their band as
target; predictions are cross-validated over sources (hosts), and the cuts
between the bands are calibrated on the held-out predictions.

Pages without enough words have no row; null and unknown bands are no labels;
labels given twice count once, contradicting ones not at all.  Without labels of at least two bands the grade
is the Flesch-Kincaid school year with cuts at 6 and 13.  Empty tables give an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import boosting
from folioforge.llm.simhash import hash_strings

MOST_LABELS = 20_000
FOLDS = 5
BANDS = ("easy", "plain", "hard")
GRADE = {"easy": 3.0, "plain": 9.0, "hard": 15.0}

FEATURES = (
    "word_mean", "word_std", "word_p50", "word_p90", "long7", "long10", "syllables", "syllables3",
    "sentence_mean", "sentence_std", "sentence_max", "sentence_p50", "types", "once", "function_words",
    "pronouns", "commas", "subordinators", "connectives", "overlap", "questions", "flesch_kincaid",
)

# Short lists of English words by grammatical use.
_FUNCTION = "the a an of to in and or for on with at by from as is was are were be been it its this that these those not but".split()
_PRONOUNS = "i you he she we they me him her us them my your his our their mine yours".split()
_SUBORDINATORS = "because although though whereas while if unless whenever since after before when which who whom whose until whether".split()
_CONNECTIVES = "however therefore moreover consequently furthermore nevertheless thus hence otherwise meanwhile subsequently paradoxically irrespective thereby notwithstanding".split()


def _keys(words: list[str]) -> np.ndarray:
    return np.sort(hash_strings(pa.array(words)))


_SETS = {"function_words": _keys(_FUNCTION), "pronouns": _keys(_PRONOUNS), "subordinators": _keys(_SUBORDINATORS), "connectives": _keys(_CONNECTIVES)}


def _per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _quantile(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray, q: float) -> np.ndarray:
    """Quantile of each group; ``order`` sorts values within groups."""
    at = starts + np.minimum((counts * q).astype(np.int64), np.maximum(counts - 1, 0))
    out = np.zeros(len(counts))
    some = counts > 0
    out[some] = values[order][at[some]]
    return out


def features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text; zeros where there are no words."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    # sentences
    sent_lists = pc.split_pattern_regex(texts, r"[.!?…]+[\s\"”»’)]*")
    sent_owner = pc.list_parent_indices(sent_lists).to_numpy(zero_copy_only=False)
    low = pc.utf8_lower(pc.list_flatten(sent_lists))
    folded = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}’']+", " "))
    some = pc.not_equal(folded, "").to_numpy(zero_copy_only=False)
    folded, sent_owner = folded.filter(pa.array(some)), sent_owner[some]
    lists = pc.split_pattern(folded, " ")
    sent_len = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists).dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    index = words.indices.to_numpy(zero_copy_only=False)
    kinds = words.dictionary
    kind_len = pc.utf8_length(kinds).to_numpy(zero_copy_only=False).astype(float)
    kind_syl = np.maximum(1.0, pc.count_substring_regex(kinds, r"[aeiouyàâäéèêëíîïóôöúûü]+").to_numpy(zero_copy_only=False).astype(float))
    kind_key = hash_strings(kinds) if len(kinds) else np.zeros(0, np.uint64)
    word_sent = np.repeat(np.arange(len(sent_len)), sent_len)
    owner = sent_owner[word_sent]
    wl, syl, key = kind_len[index], kind_syl[index], kind_key[index]
    count = np.bincount(owner, minlength=n)
    nw = np.maximum(count, 1)
    sents = np.bincount(sent_owner, minlength=n)
    ns = np.maximum(sents, 1)
    f: dict[str, np.ndarray] = {}
    f["word_mean"] = _per(wl, owner, n) / nw
    f["word_std"] = np.sqrt(np.maximum(0, _per(wl * wl, owner, n) / nw - f["word_mean"] ** 2))
    starts = np.concatenate(([0], np.cumsum(count)[:-1])) if n else np.zeros(0, np.int64)
    order = np.lexsort((wl, owner))
    f["word_p50"] = _quantile(wl, starts, count, order, 0.5)
    f["word_p90"] = _quantile(wl, starts, count, order, 0.9)
    f["long7"] = _per((wl >= 7).astype(float), owner, n) / nw
    f["long10"] = _per((wl >= 10).astype(float), owner, n) / nw
    f["syllables"] = _per(syl, owner, n) / nw
    f["syllables3"] = _per((syl >= 3).astype(float), owner, n) / nw
    sl = sent_len.astype(float)
    f["sentence_mean"] = _per(sl, sent_owner, n) / ns
    f["sentence_std"] = np.sqrt(np.maximum(0, _per(sl * sl, sent_owner, n) / ns - f["sentence_mean"] ** 2))
    s_starts = np.concatenate(([0], np.cumsum(sents)[:-1])) if n else np.zeros(0, np.int64)
    s_order = np.lexsort((sl, sent_owner))
    f["sentence_max"] = _quantile(sl, s_starts, sents, s_order, 1.0)
    f["sentence_p50"] = _quantile(sl, s_starts, sents, s_order, 0.5)
    pair, times = np.unique(owner.astype(np.int64) * (len(kinds) + 1) + index, return_counts=True)
    pair_owner = pair // (len(kinds) + 1)
    types = np.bincount(pair_owner, minlength=n)
    f["types"] = types / np.sqrt(nw)
    f["once"] = np.bincount(pair_owner[times == 1], minlength=n) / np.maximum(types, 1)
    for name, keys in _SETS.items():
        f[name] = _per(np.isin(key, keys).astype(float), owner, n) / nw
    f["commas"] = pc.count_substring(texts, ",").to_numpy(zero_copy_only=False) / ns
    f["questions"] = pc.count_substring(texts, "?").to_numpy(zero_copy_only=False) / ns
    # cohesion: longer words that a sentence shares with the one before
    content = wl >= 4
    sk = np.unique(word_sent[content].astype(np.int64) * (len(kinds) + 1) + index[content])
    s_of, k_of = sk // (len(kinds) + 1), sk % (len(kinds) + 1)
    in_next = np.isin((s_of + 1) * (len(kinds) + 1) + k_of, sk)
    linked = s_of[in_next]
    same = sent_owner[linked] == sent_owner[np.minimum(linked + 1, len(sent_owner) - 1)] if len(linked) else np.zeros(0, bool)
    f["overlap"] = np.bincount(sent_owner[linked[same]], minlength=n) / np.maximum(np.bincount(sent_owner[s_of], minlength=n), 1)
    f["flesch_kincaid"] = np.where(count > 0, 0.39 * count / ns + 11.8 * f["syllables"] - 15.59, 0.0)
    return np.stack([np.asarray(f[k], float) for k in FEATURES], axis=1) if n else np.zeros((0, len(FEATURES)))


def body_features(bodies: DataFrame) -> DataFrame:
    """``page_id, host, f`` of ``page_id, host, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = features(part.column(2))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], names=["page_id", "host", "f"])

    return bodies.select("page_id", "host", "text").mapInArrow(run, "page_id long, host string, f array<double>")


class Grader(NamedTuple):
    model: boosting.Model | None
    cuts: tuple[float, float]
    #: (host fold, labelled pages, right bands, mean absolute error in years) of the cross-validation
    report: list[tuple[int, int, int, float]]

    def grade(self, x: np.ndarray) -> np.ndarray:
        return self.model.predict(x) if self.model else x[:, FEATURES.index("flesch_kincaid")]


def fold_of(host: str) -> int:
    return hashlib.blake2b((host or "").encode(), digest_size=4).digest()[0] % FOLDS


def train(feats: DataFrame, labels: DataFrame) -> Grader:
    """Fit on a bounded sample of labelled pages, calibrated across sources."""
    known = labels.select("page_id", F.lower(F.trim("band")).alias("band")).where(F.col("band").isin(*BANDS))
    known = known.groupBy("page_id").agg(F.min("band").alias("band"), F.max("band").alias("other")).where("band = other").drop("other")
    got = feats.join(known, "page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(MOST_LABELS).select("host", "band", "f").toArrow()
    band = got.column("band").to_pylist()
    if len(set(band)) < 2:
        return Grader(None, (6.0, 13.0), [])
    x = np.array(got.column("f").to_pylist(), float)
    y = np.array([GRADE[b] for b in band])
    fold = np.array([fold_of(h) for h in got.column("host").to_pylist()])
    pred = boosting.cross_predict(x, y, fold)
    cuts = boosting.best_cuts(pred, y, [GRADE[b] for b in BANDS])
    said = np.array([GRADE[b] for b in BANDS])[np.searchsorted(cuts, pred, side="left")]
    report = [(int(k), int((fold == k).sum()), int((said == y)[fold == k].sum()), float(np.abs(pred - y)[fold == k].mean())) for k in np.unique(fold)]
    return Grader(boosting.fit(x, y), (cuts[0], cuts[1]), report)


def levels(feats: DataFrame, grader: Grader) -> DataFrame:
    """``page_id, grade, band``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            g = grader.grade(x)
            band = np.array(BANDS, dtype=object)[np.searchsorted(grader.cuts, g, side="left")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g), pa.array(band, pa.string())], names=["page_id", "grade", "band"])

    return feats.select("page_id", "f").mapInArrow(run, "page_id long, grade double, band string")
