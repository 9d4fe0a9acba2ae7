"""Subject areas of documents by a distributed latent Dirichlet topic model.

One topic for each subject and a few for what is common to all; variational
updates of document proportions run in the map side of each pass, and word
statistics are summed by word, so a pass moves one row a word and task.  Topics
start from the labelled documents, and are mapped to subjects afterwards by an
inspection of their top terms: a topic gets the subject whose labelled documents
use these terms most beyond their common rate.  A document's subjects are those
that at least ``LEAST_SHARE`` of its sentences are about, a sentence being about
the subject that most of its topic-bearing words are assigned to under the
document's topic proportions.

The vocabulary leaves out names (words written with a capital, but for German nouns) and holds the words of at least ``LEAST_DOCUMENTS`` documents and
one in ``RAREST`` documents, which bounds it by ``RAREST`` times the mean number
of distinct words of a document, whatever the corpus' size.  Labels that are
null or name no subject are left out; labels are used of ``MOST_LABELS``
documents at most, chosen by hash.  Null, empty and subjectless texts have no
row; repeated texts count each; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources import keep

COMMON_TOPICS = 4
#: Prior weight of a labelled document's subjects, and factor for the others (some labels are wrong).
LABELLED, UNLABELLED = 1.0, 0.1
PASSES = 8
#: Rounds within a document, when the topics are fitted and when subjects are assigned.
INNER_FIT, INNER = 8, 12
#: Words of the documents that are worked on side by side.
CELLS = 1 << 15
ALPHA_SUBJECT, ALPHA_COMMON, BETA = 0.05, 0.5, 0.02
RAREST = 20_000
LEAST_DOCUMENTS = 3
MOST_LABELS = 50_000
LEAST_SHARE = 0.25
#: A word bears a subject from this posterior on; a sentence is about the subject of most such words.
LEAST_POSTERIOR = 0.6
TOP_TERMS = 30
#: A single sentence is a mention in passing below this share of a document.
LEAST_SHARE_ONCE = 0.3
#: Known words of a sentence, unless it bears a subject.
LEAST_SENTENCE = 3

_SENTENCE = r"[.!?…]+[\s\"”»’)]+|[.!?…]+$|[\r\n\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]+"


def sentence_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each sentence, words of all sentences as written, number of words of each sentence)."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), _SENTENCE)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    folded = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.list_flatten(lists), r"[^\p{L}]+", " "))
    some = pc.not_equal(folded, "")
    folded, owner = folded.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    words = pc.split_pattern(folded, " ")
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return owner, pc.list_flatten(words), counts


class Corpus(NamedTuple):
    """``doc_id, words`` (ids of language and word, all sentences), ``sentences`` (known words
    of each sentence), ``bag, times`` (distinct words, and how often each stands there)."""

    rows: DataFrame
    words: list[str]
    languages: int


#: Fixed value: languages that write all nouns with a capital.
CAPITAL_NOUNS = ("de",)
#: A word is a name if it is written with a capital so many times as often as without.
NAME_CAPITALS = 30
#: Languages of the labels that at least one in so many documents declares.
RAREST_LANGUAGE = 200


def prepare(documents: DataFrame) -> Corpus:
    """Vocabulary over all documents, then every document as word ids, kept.

    A document's language is the one under which its words are likeliest by the
    declared languages of all documents; a wrong or missing declaration so does
    no harm.  Topics have word distributions of their own in each language.
    """
    tag = F.lower(F.substring(F.trim("lang"), 1, 2))
    own = documents.select("doc_id", "text", F.when(tag.rlike("^[a-z]{2}$"), tag).otherwise("").alias("lang")).where("text is not null")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                owner, words, counts = sentence_words(part.column(1))
                enc, lang = pc.utf8_lower(words).dictionary_encode(), part.column(2).dictionary_encode()
                index = enc.indices.to_numpy(zero_copy_only=False)
                small = np.bincount(index[pc.utf8_is_lower(words).to_numpy(zero_copy_only=False)], minlength=len(enc.dictionary))
                title = np.bincount(index[pc.utf8_is_title(words).to_numpy(zero_copy_only=False)], minlength=len(enc.dictionary))
                n, m = len(enc.dictionary) + 1, len(lang.dictionary)
                pairs = np.unique(np.repeat(owner, counts).astype(np.int64) * n + index)
                which = lang.indices.to_numpy(zero_copy_only=False)[pairs // n]
                key, df = np.unique(pairs % n * m + which, return_counts=True)
                first = np.concatenate(([True], key[1:] // m != key[:-1] // m)) if len(key) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        enc.dictionary.take(pa.array(key // m)),
                        lang.dictionary.take(pa.array(key % m)),
                        pa.array(df),
                        pa.array(small[key // m] * first),
                        pa.array(title[key // m] * first),
                    ],
                    names=["word", "lang", "n", "small", "title"],
                )

    declared = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    total = sum(declared.values())
    least = max(LEAST_DOCUMENTS, -(-total // RAREST))
    languages = sorted(k for k, n in declared.items() if k and n * RAREST_LANGUAGE >= total) or [""]
    by_lang = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"l{i}") for i, k in enumerate(languages)]
    capital = F.sum(F.when(F.col("lang").isin(*CAPITAL_NOUNS), F.col("n")).otherwise(0))
    vocabulary = (
        own.mapInArrow(distinct, "word string, lang string, n long, small long, title long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("small").alias("small"), F.sum("title").alias("title"), capital.alias("capital"), *by_lang)
        .where((F.col("title") < NAME_CAPITALS * (F.col("small") + 0.1)) | (F.col("capital") >= 0.8 * F.col("n")))
    )
    got = vocabulary.where(F.col("n") >= least).select("word", *(f"l{i}" for i in range(len(languages)))).toArrow().sort_by("word")
    words = got.column("word").to_pylist()
    known = pa.array(words, pa.string())
    seen = np.stack([got.column(f"l{i}").to_numpy().astype(float) for i in range(len(languages))], axis=1) + 0.1
    size = np.array([declared.get(k, 0) for k in languages], float) + 1.0
    speaks = np.log(seen / size / (seen / size).sum(axis=1, keepdims=True)) if len(words) else np.zeros((0, len(languages)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                owner, tokens, counts = sentence_words(part.column(1))
                ids = pc.index_in(pc.utf8_lower(tokens), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                sent = np.repeat(np.arange(len(counts)), counts)
                kept = ids >= 0
                ids, sent = ids[kept], sent[kept]
                doc = owner[sent]
                score = np.stack([np.bincount(doc, weights=speaks[ids, k], minlength=part.num_rows) for k in range(len(languages))], axis=1)
                ids = ids + score.argmax(axis=1)[doc] * len(words)
                per_sentence = np.bincount(sent, minlength=len(counts))
                n_words = np.bincount(doc, minlength=part.num_rows)
                n_sents = np.bincount(owner, minlength=part.num_rows)
                span = len(words) * len(languages) + 1
                pair, times = np.unique(doc * span + ids, return_counts=True)
                n_bag = np.bincount(pair // span, minlength=part.num_rows)
                bag_ends = pa.array(np.concatenate(([0], np.cumsum(n_bag))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_words))).astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_sents))).astype(np.int32)), pa.array(per_sentence.astype(np.int32))),
                        pa.ListArray.from_arrays(bag_ends, pa.array((pair % span).astype(np.int32))),
                        pa.ListArray.from_arrays(bag_ends, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "words", "sentences", "bag", "times"],
                )

    coded = own.select("doc_id", "text").mapInArrow(encode, "doc_id long, words array<int>, sentences array<int>, bag array<int>, times array<int>")
    return Corpus(keep(coded, "words"), words, len(languages))


def infer(bag: np.ndarray, times: np.ndarray, lengths: np.ndarray, by_word: np.ndarray, alpha: np.ndarray, inner: int = INNER) -> np.ndarray:
    """Topic proportions of each document.

    ``bag, times, lengths``: distinct words of the documents, one after the
    other, their counts, and how many each document has; ``by_word``: words x
    topics, single precision; ``alpha`` may differ by document.  Documents of like length
    are worked on side by side, as one dense product.
    """
    n, k = len(lengths), alpha.shape[-1]
    prior = np.broadcast_to(alpha, (n, k)).astype(np.float32)
    theta = prior / prior.sum(axis=1, keepdims=True)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    while len(order):
        # as many documents as fit, a long one by itself
        cells = np.arange(1, len(order) + 1) * lengths[order]
        some, order = np.split(order, [max(1, int(np.searchsorted(cells, CELLS)))])
        width = int(lengths[some].max())
        inside = np.arange(width)[None] < lengths[some][:, None]
        at = np.where(inside, starts[some][:, None] + np.arange(width)[None], 0)
        like = by_word[bag[at]] * inside[..., None]
        weight = np.where(inside, times[at], 0).astype(np.float32)
        x = theta[some]
        for _ in range(inner):
            norm = np.matmul(like, x[:, :, None])[..., 0] + np.float32(1e-30)
            x = x * np.matmul((weight / norm)[:, None, :], like)[:, 0] + prior[some]
            x /= x.sum(axis=1, keepdims=True)
        theta[some] = x
    return theta


def posterior(ids: np.ndarray, doc: np.ndarray, theta: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """Topic posterior of each word under its document's proportions."""
    post = by_word[ids] * theta[doc]
    post /= post.sum(axis=1, keepdims=True) + np.float32(1e-30)
    return post


def _columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def document_prior(alpha: np.ndarray, labels: list[list[int] | None]) -> np.ndarray:
    """``alpha`` of each document; a labelled one rather holds its subjects than others."""
    out = np.tile(alpha, (len(labels), 1))
    for i, own in enumerate(labels):
        if own:
            out[i, : len(alpha) - COMMON_TOPICS] *= UNLABELLED
            out[i, own] = LABELLED
    return out


def word_statistics(rows: DataFrame, phi: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Expected uses of each word by each topic, over all documents; ``rows`` with ``subjects``."""
    k, v = phi.shape
    names = [f"t{i}" for i in range(k)]
    by_word = np.ascontiguousarray(phi.T, dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = np.zeros((k, v))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                bag, lengths = _columns(part, "bag")
                times, _ = _columns(part, "times")
                doc = np.repeat(np.arange(part.num_rows), lengths)
                known = part.column(part.schema.get_field_index("subjects")).to_pylist() if k > COMMON_TOPICS else []
                theta = infer(bag, times, lengths, by_word, document_prior(alpha, known) if known else np.tile(alpha, (part.num_rows, 1)), INNER_FIT)
                post = posterior(bag, doc, theta, by_word) * times[:, None]
                for t in range(k):
                    stats[t] += np.bincount(bag, weights=post[:, t], minlength=v)
        used = np.flatnonzero(stats.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(stats[t, used]) for t in range(k))], names=["word", *names])

    schema = "word int, " + ", ".join(f"{c} double" for c in names)
    got = rows.select("bag", "times", "subjects").mapInArrow(run, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((v, k))
    at = got.column("word").to_numpy()
    for t, c in enumerate(names):
        out[at, t] = got.column(c).to_numpy()
    return out


def with_labels(corpus: Corpus, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """``doc_id, bag, times`` of ``corpus.rows`` with ``subjects``: places of the labelled subjects, null without; kept."""
    place = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")) - 1 if subjects else F.lit(None).cast("long")
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(subjects))
    per_doc = clean.groupBy("doc_id").agg(F.sort_array(F.collect_set(place.cast("int"))).alias("subjects"))
    per_doc = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    return keep(corpus.rows.select("doc_id", "bag", "times").join(per_doc, "doc_id", "left"), "labelled")


def labelled_counts(rows: DataFrame, v: int, s: int) -> np.ndarray:
    """Labelled documents with each word, by subject; a document weighs one over its subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.zeros((s, v))
        for batch in batches:
            ids, lengths = _columns(batch, "bag")
            ends = np.concatenate(([0], np.cumsum(lengths)))
            for i, own in enumerate(batch.column(batch.schema.get_field_index("subjects")).to_pylist()):
                w = ids[ends[i] : ends[i + 1]]
                for x in own:
                    by[x, w] += 1.0 / len(own)
        a, b = np.nonzero(by)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(by[a, b])], names=["s", "w", "n"])

    got = rows.where("subjects is not null").select("bag", "subjects").mapInArrow(run, "s int, w int, n double").groupBy("s", "w").agg(F.sum("n").alias("n")).toArrow()
    by = np.zeros((s, v))
    by[got.column("s").to_numpy(), got.column("w").to_numpy()] = got.column("n").to_numpy()
    return by


class TopicModel(NamedTuple):
    phi: np.ndarray
    alpha: np.ndarray
    #: Place of the subject of each topic in each language; -1 for what is common to all.
    subject: np.ndarray
    languages: int


def start(by: np.ndarray, total: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """First word distributions: subjects prefer the words their labelled documents use beyond the common rate."""
    s, v = by.shape
    lift = by / np.maximum(total, 1e-9)
    phi = np.empty((s + COMMON_TOPICS, v))
    weight = np.where(total > 0, np.maximum(lift - 1.5 / s, 0.0) ** 2, 0.05 / s**2)
    phi[:s] = (uses + 1.0) * (weight + 1e-4)
    rng = np.random.default_rng(7)
    flat = np.where(total > 0, np.clip(1.2 - lift.max(axis=0), 0.02, 1.0) ** 2, 0.3) if s else np.ones(v)
    phi[s:] = (uses + 1.0) * flat * rng.uniform(0.8, 1.25, (COMMON_TOPICS, v))
    return phi / phi.sum(axis=1, keepdims=True)


def per_language(phi: np.ndarray, uses: np.ndarray, languages: int) -> np.ndarray:
    """Distributions over the words used in each language."""
    blocks = (phi * (uses > 0)).reshape(len(phi), languages, -1)
    return (blocks / np.maximum(blocks.sum(axis=2, keepdims=True), 1e-300)).reshape(len(phi), -1)


def typical_terms(phi: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Places of the top terms of each topic: frequent in it, and rather there than elsewhere."""
    weight = phi * (phi / np.maximum(phi.sum(axis=0, keepdims=True), 1e-300)) * (uses > 0)
    return np.argsort(-weight, axis=1, kind="stable")[:, :TOP_TERMS]


def map_topics(phi: np.ndarray, by: np.ndarray, uses: np.ndarray, languages: int) -> np.ndarray:
    """Subject of each topic in each language: the one whose labelled documents
    hold most of its top terms there; without such documents, the one it began
    with.  The last ``COMMON_TOPICS`` topics have none."""
    s = len(by)
    out = np.full((len(phi), languages), -1)
    rate = by / np.maximum(by.sum(axis=0, keepdims=True), 1e-9)
    size = phi.shape[1] // max(languages, 1)
    for k in range(languages):
        block = slice(k * size, (k + 1) * size)
        tops = typical_terms(phi[:, block], uses[block])
        for t in range(s):
            top = tops[t] + k * size
            seen = by[:, top].sum(axis=0) > 0
            score = (rate[:, top] * np.minimum(by[:, top].sum(axis=0), 3.0)).sum(axis=1)
            out[t, k] = int(np.argmax(score)) if seen.any() else t
    return out


def fit(corpus: Corpus, labels: DataFrame, subjects: list[str]) -> TopicModel:
    """Variational passes over all documents."""
    s, v = len(subjects), len(corpus.words) * corpus.languages
    alpha = np.array([ALPHA_SUBJECT] * s + [ALPHA_COMMON] * COMMON_TOPICS)
    if not v or not s:
        return TopicModel(np.full((len(alpha), v), 1.0 / max(v, 1)), alpha, np.full((len(alpha), corpus.languages), -1), corpus.languages)
    rows = with_labels(corpus, labels, subjects)
    by = labelled_counts(rows, v, s)
    uses = word_statistics(rows, np.full((1, v), 1.0 / v), np.ones(1))[:, 0]
    phi = per_language(start(by, by.sum(axis=0), uses), uses, corpus.languages)
    for _ in range(PASSES):
        phi = per_language(word_statistics(rows, phi, alpha).T + BETA, uses, corpus.languages)
    return TopicModel(phi, alpha, map_topics(phi, by, uses, corpus.languages), corpus.languages)


def _table(at: np.ndarray, rows: int, columns: int, weights: np.ndarray | None) -> np.ndarray:
    """Sums of ``weights`` (ones without) at flat places of a table."""
    return np.bincount(at, weights=weights, minlength=rows * columns).reshape(rows, columns).astype(float)


def sentence_subjects(batch: pa.RecordBatch, m: TopicModel, by_word: np.ndarray, subjects: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, subject, share of its sentences) for each pair that occurs."""
    ids, lengths = _columns(batch, "words")
    sent_len, sents = _columns(batch, "sentences")
    bag, sizes = _columns(batch, "bag")
    times, _ = _columns(batch, "times")
    theta = infer(bag, times, sizes, by_word, np.tile(m.alpha, (batch.num_rows, 1)))
    post = posterior(ids, np.repeat(np.arange(batch.num_rows), lengths), theta, by_word)
    by = np.zeros((len(ids), len(subjects)))
    language = ids // max(len(by_word) // max(m.languages, 1), 1)
    for t in range(len(m.subject) - COMMON_TOPICS):
        own = m.subject[t][language] if len(ids) else np.zeros(0, np.int64)
        at = np.flatnonzero(own >= 0)
        by[at, own[at]] += post[at, t]  # each word once
    sentence = np.repeat(np.arange(len(sent_len)), sent_len)
    best = by.argmax(axis=1) if by.shape[1] else np.zeros(len(ids), np.int64)
    bears = by.max(axis=1, initial=0.0) >= LEAST_POSTERIOR if len(ids) else np.zeros(0, bool)
    s_count = max(len(subjects), 1)
    votes = _table(sentence[bears] * s_count + best[bears], len(sent_len), s_count, by[bears, best[bears]] if by.shape[1] else None)
    doc = np.repeat(np.arange(len(sents)), sents)
    # a mention in passing does not outvote what the document is about
    voted, voted_for = np.nonzero(votes)
    weight = _table(doc[voted] * s_count + voted_for, len(sents), s_count, votes[voted, voted_for])
    weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
    votes *= 0.2 + weight[doc]
    says = votes.max(axis=1, initial=0.0) > 0
    chosen = votes.argmax(axis=1) if votes.shape[1] else np.zeros(len(votes), np.int64)
    counts = _table(doc[says] * s_count + chosen[says], len(sents), s_count, None)
    real = says | (sent_len >= LEAST_SENTENCE)  # a heading without a subject is no sentence
    share = counts / np.maximum(np.bincount(doc[real], minlength=len(sents)), 1)[:, None]
    d, s = np.nonzero(share)
    once = counts[d, s] == 1
    keep_ = ~once | (share[d, s] >= LEAST_SHARE_ONCE)
    return d[keep_], s[keep_], share[d, s][keep_]


def assign(corpus: Corpus, m: TopicModel, subjects: list[str], least: float = LEAST_SHARE) -> DataFrame:
    """``doc_id, subject, share`` of each document's subjects."""
    by_word = np.ascontiguousarray(m.phi.T, dtype=np.float32)
    m = m._replace(phi=m.phi[:, :0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                d, s, share = sentence_subjects(part, m, by_word, subjects)
                ok = share >= least - 1e-9
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d[ok])), pa.array([subjects[i] for i in s[ok]], pa.string()), pa.array(share[ok])],
                    names=["doc_id", "subject", "share"],
                )

    return corpus.rows.mapInArrow(run, "doc_id long, subject string, share double").dropDuplicates(["doc_id", "subject"])


def subject_names(areas: DataFrame) -> list[str]:
    """The fixed list of subjects."""
    rows = areas.select(F.lower(F.trim("subject")).alias("s")).where("s is not null").distinct().orderBy("s").toArrow()
    return rows.column(0).to_pylist()


def model(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[Corpus, TopicModel, list[str]]:
    subjects = subject_names(areas)
    corpus = prepare(documents)
    return corpus, fit(corpus, labels, subjects), subjects


def top_terms(corpus: Corpus, m: TopicModel, subjects: list[str]) -> list[tuple[int, int, str | None, int, str, float]]:
    """(topic, language, subject, rank, term, probability in its language) of the terms that name the topics."""
    out = []
    size = len(corpus.words)
    for k in range(corpus.languages if size else 0):
        phi = m.phi[:, k * size : (k + 1) * size]
        for t, top in enumerate(typical_terms(phi, phi.sum(axis=0))):
            name = subjects[m.subject[t, k]] if m.subject[t, k] >= 0 else None
            for r, w in enumerate(top):
                out.append((t, k, name, r + 1, corpus.words[w], float(phi[t, w])))
    return out
