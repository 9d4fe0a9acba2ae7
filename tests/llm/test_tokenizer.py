import random

import pytest

from folioforge.llm import tokenizer

PAGE = ["", None, " ", "a", "Hello world", "x" * 5000, "<|endoftext|>", "naïve café – Ω ≥ 日本語 🙂👨‍👩‍👧", "\r\n\t  \n a", "ﷺ" * 50, "don't we'll I'd", "1234567890" * 30]


@pytest.fixture(scope="module")
def bpe():
    return tokenizer.encoder(tokenizer.vocabulary_path(), tokenizer.word_pattern())


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_agrees_with_public_tokenizer(bpe, public):
    assert bpe.encode_batch(PAGE) == public(PAGE)


def test_random_texts_and_round_trip(bpe, public):
    rng = random.Random(3)
    alphabet = "abcdeéüßñ ÄЖжя 中🙂'.,-_0123\n\t"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    mine = bpe.encode_batch(texts)
    assert mine == public(texts)
    assert [b"".join(bpe.bytes_of[i] for i in ids).decode() for ids in mine] == texts


def test_shared_prefixes_are_encoded_alike(bpe, public):
    words = ["un", "unbe", "unbeliev", "unbelievable", "unbelievably"]
    assert bpe.encode_batch(words) == public(words)


def test_corpus_has_one_row_each(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (3, "some words", None), (4, "some words", "z")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode_corpus(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == got[4] and len(got) == 4
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizer.encode_corpus(df, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
