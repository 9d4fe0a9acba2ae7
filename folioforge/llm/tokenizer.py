"""Encoding of texts with a public byte-level BPE vocabulary.

Words (the matches of the pre-tokenizer's pattern) are inserted into a trie of
bytes, and a depth-first walk gives each node its *last token*: the last token
of the encoding of the prefix that ends there.  For byte-pair merges that token
is unique, and ``encoding(prefix) = encoding(prefix without it) + [token]``, so
prefixes shared by several words are encoded once.  A token ``b`` may follow
``a`` exactly if merging the bytes of both gives ``a, b`` again, which is
decided by undoing merges along the seam.

Empty and null texts give the empty list.  Texts of any length are handled:
the walk is iterative, and a word's cost is linear in its bytes times the
vocabulary's depth.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NO_TOKEN = -1


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_pattern() -> str:
    """The public pre-tokenizer pattern that belongs to the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixBpe:
    """Byte-pair encoder over a trie of words; ``ranks`` maps bytes to ids,
    merges in the order of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = 400_000):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = self._splits()
        self.merged = {p: t for t, p in self.pieces.items() if p is not None}
        self.seams: dict[tuple[int, int], bool] = {}
        self.starts: set[bytes] = {b[:i] for b in ranks for i in range(1, len(b) + 1)}
        self.words: dict[str, list[int]] = {}
        self.cache_words = cache_words

    @classmethod
    def load(cls, path: str, pattern: str) -> PrefixBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging with the merges under ``below``; only for the vocabulary's own tokens."""
        ranks, parts = self.ranks, [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _splits(self) -> dict[int, tuple[int, int] | None]:
        """The two tokens that each token is merged from; None for bytes."""
        out: dict[int, tuple[int, int] | None] = {}
        for b, i in self.ranks.items():
            two = self._merge(b, i) if len(b) > 1 else []
            out[i] = (two[0], two[1]) if len(two) == 2 else None
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens ``a`` and ``b`` together encode to ``[a, b]``."""
        known = self.seams.get((a, b))
        if known is None:
            known = self.seams[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Walk down both sides of the seam from the latest merge to the
        first: a merge over the seam spoils the pair only if its turn came
        before the merges that made the pieces beside it."""
        merged, pieces = self.merged, self.pieces
        turn = 1 << 60
        while True:
            over = merged.get((a, b))
            if over is not None and over < turn:
                return False
            left_later = a > b
            for side in (left_later, not left_later):
                if side:
                    if pieces[a] is not None:
                        turn, a = a, pieces[a][1]
                        break
                elif pieces[b] is not None:
                    turn, b = b + 1, pieces[b][0]
                    break
            else:
                return True

    def encode_words(self, words: list[str]) -> None:
        """Encode distinct words through one trie; results go to ``self.words``."""
        # node: children by byte, last token, bytes of that token, parent
        kids: list[dict[int, int]] = [{}]
        byte: list[int] = [0]
        parent: list[int] = [-1]
        ends: list[tuple[str, int]] = []
        for w in words:
            n = 0
            for b in w.encode("utf-8", "surrogatepass"):
                k = kids[n].get(b)
                if k is None:
                    k = kids[n][b] = len(kids)
                    kids.append({})
                    byte.append(b)
                    parent.append(n)
                n = k
            ends.append((w, n))
        last = [NO_TOKEN] * len(kids)
        back = [-1] * len(kids)  # the node before the last token
        ranks, starts, fits = self.ranks, self.starts, self.fits
        # parents come before children, and a node's last token is settled when
        # all nodes above have been walked from, so walking in depth-first
        # preorder from every settled node settles each node exactly once
        stack = [0]
        while stack:
            n = stack.pop()
            before = last[n]
            walk = [(k, bytes([b])) for b, k in kids[n].items()]
            while walk:
                m, run = walk.pop()
                if last[m] < 0:
                    t = ranks.get(run)
                    if t is not None and (before < 0 or fits(before, t)):
                        last[m], back[m] = t, n
                for b, k in kids[m].items():
                    if (longer := run + bytes([b])) in starts:
                        walk.append((k, longer))
            stack.extend(kids[n].values())
        for w, n in ends:
            ids = []
            while n > 0:
                ids.append(last[n])
                n = back[n]
            ids.reverse()
            self.words[w] = ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        if len(self.words) > self.cache_words:
            self.words.clear()
            self.seams.clear()
        parts = [self.find(t) if t else [] for t in texts]
        known = self.words
        new = {w for p in parts for w in p if w not in known}
        if new:
            self.encode_words(sorted(new))
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += known[w]
            out.append(ids)
        return out


_ENCODERS: dict[tuple[str, str], PrefixBpe] = {}


def encoder(path: str, pattern: str) -> PrefixBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PrefixBpe.load(path, pattern)
    return _ENCODERS[path, pattern]


def encode_corpus(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    counts_only: bool = False,
) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens``) of each row, one row for each row.

    Narrow: no shuffle; other columns are not read.
    """
    path = path or vocabulary_path()
    pattern = word_pattern()
    df.sparkSession.sparkContext.addFile(path)  # executors need not have the driver's folders
    name = os.path.basename(path)
    key_type = df.schema[key].dataType
    out = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        ]
    )
    own = df.select(df[key].alias("k"), df[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(SparkFiles.get(name), pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                col = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), col], names=[out[0].name, out[1].name])

    return own.mapInArrow(run, out)
