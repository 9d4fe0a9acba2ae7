import numpy as np

from folioforge.llm import subjects

NOUNS = {
    "music": "guitar violin drum chorus melody album trumpet piano".split(),
    "law": "court verdict lawyer statute clause appeal judge tribunal".split(),
    "food": "soup bread cheese recipe sauce pepper butter noodle".split(),
}
FRAMES = ["we saw the {} near the {} last week", "nobody asked about the {} or the {}", "the {} and a {} were on the list again"]


def document(rng, mix):
    out = []
    for s, n in mix:
        for _ in range(n):
            out.append(FRAMES[rng.integers(3)].format(*rng.choice(NOUNS[s], 2)).capitalize() + ".")
    return " ".join(out)


def test_subjects_by_sentences(spark):
    rng = np.random.default_rng(1)
    docs, truth = [], {}
    names = sorted(NOUNS)
    for i in range(240):
        a, b = names[i % 3], names[(i + 1) % 3]
        mix = [(a, 6)] if i % 4 else [(a, 3), (b, 3)]
        if i % 5 == 0:
            mix.append((names[(i + 2) % 3], 1))  # a mention in passing
        docs.append((i, document(rng, mix), "en" if i % 9 else None, i))
        truth[i] = {a} if i % 4 else {a, b}
    docs += [(900, None, "en", 0), (901, "", None, 0), (902, "Nobody was on the list again last week.", "en", 0)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject long")
    areas = spark.createDataFrame([(n, "about " + n) for n in names], "subject string, description string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 240, 7) for s in truth[i]] + [(1, None), (2, "nosuch")], "doc_id long, subject string")
    corpus, model, known = subjects.model(documents, areas, labels)
    rows = subjects.assign(corpus, model, known).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in range(240))
    assert right >= 228
    assert not {900, 901} & set(got)
    terms = subjects.top_terms(corpus, model, known)
    assert {t[2] for t in terms} == {None, *names}


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, lang string")
    areas = spark.createDataFrame([("law", "x")], "subject string, description string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.assign(*subjects.model(documents, areas, labels)).count() == 0
