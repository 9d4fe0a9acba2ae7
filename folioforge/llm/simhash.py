"""64-bit SimHash over tokens, for whole arrays of texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BANDS = 4


def fold_words(texts: pa.Array) -> pa.Array:
    """Words of letters in lower case, one space apart; null gives the empty text."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\p{L}]+", " "))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each text, equal on all machines."""
    enc = values.dictionary_encode() if not isinstance(values, pa.DictionaryArray) else values
    words = np.asarray(enc.dictionary.to_pylist(), dtype=object)
    if not len(words):
        return np.zeros(len(values), np.uint64)
    return pd.util.hash_array(words, categorize=False)[enc.indices.to_numpy(zero_copy_only=False)]


def token_hashes(folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    lists = pc.split_pattern(folded, " ")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(folded, "").to_numpy(zero_copy_only=False)
    words = pc.list_flatten(lists)
    if empty.any():
        words = words.filter(pc.not_equal(words, ""))
        lengths = np.where(empty, 0, lengths)
    return hash_strings(words), lengths


_SHIFTS = np.arange(64, dtype=np.uint64)


def simhash(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Majority of each hash bit over a text's tokens; 0 for texts without tokens."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    uniq, inv = np.unique(hashes, return_inverse=True)
    signs = (((uniq[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)
    got = np.empty(len(full), np.uint64)
    step = 4096
    bounds = np.append(starts, len(hashes))
    for lo in range(0, len(full), step):  # bounded memory
        hi = min(lo + step, len(full))
        part = signs[inv[bounds[lo] : bounds[hi]]]
        sums = np.add.reduceat(part, bounds[lo:hi] - bounds[lo], axis=0, dtype=np.int32)
        got[lo:hi] = ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    out[full] = got
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)
