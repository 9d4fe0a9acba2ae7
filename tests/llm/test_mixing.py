from collections import Counter

from folioforge.llm import mixing

DOCS = "doc_id long, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, total=None):
    used, plan = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), total)
    return used, plan


def test_shares_and_caps(spark):
    docs = [(i, "word " * (5 + i % 7), " Web" if i % 2 else "web") for i in range(200)]
    docs += [(1000 + i, "note " * 20, "Rare ") for i in range(5)] + [(2000, "text", None), (2001, "text", "untargeted")]
    targets = [("web", 0.8, 1), ("rare", 0.2, 4), ("missing", 0.0, 2)]
    used, plan = run(spark, docs, targets)
    rows = used.collect()
    assert len(rows) == len(docs)
    assert max(r["uses"] for r in rows if r["source"] == "web") <= 1
    assert max(r["uses"] for r in rows if r["source"] == "rare") <= 4
    assert all(r["uses"] == 0 for r in rows if r["doc_id"] in (2000, 2001))
    shares = {r["source"]: r for r in mixing.shares(used, plan).collect()}
    assert abs(shares["rare"]["actual_share"] - 0.2) < 0.05
    assert shares["missing"]["tokens_used"] == 0
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9


def test_running_sum_equals_brute_force(spark):
    docs = [(i, "a b c " * (i % 5), "s") for i in range(300)]
    used, _ = run(spark, docs, [("s", 1.0, 3)], total=700)
    rows = used.collect()
    available = sum(r["n_tokens"] for r in rows)
    whole, rest = divmod(min(700, 3 * available), available)
    assert {r["uses"] for r in rows} <= {whole, whole + 1}
    assert sorted(r["offset"] for r in rows)[0] == 0
    extra = [r for r in rows if r["uses"] > whole]
    # the source ends with the document whose end is nearest
    got = sum(r["n_tokens"] for r in extra)
    ends = {0} | {r["offset"] + r["n_tokens"] for r in rows}
    assert abs(got - rest) == min(abs(e - rest) for e in ends)


def test_curriculum_inverts_demand(spark):
    docs = [(i, "one two three four", "a" if i < 40 else "b") for i in range(50)]
    used, _ = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 4)])
    order = mixing.curriculum(used).collect()
    position = [r["position"] for r in order]
    assert position == sorted(position) and 0 <= min(position) and max(position) <= 1
    assert Counter(r["source"] for r in order)["b"] == sum(r["uses"] for r in used.where("source = 'b'").collect())
    # the repeated source moves to the end
    half = len(order) // 2
    assert sum(r["source"] == "b" for r in order[half:]) > sum(r["source"] == "b" for r in order[:half])


def brute_position(points, y):
    """Time at which a schedule has given the share ``y``, in a million steps."""
    import numpy as np

    t = np.linspace(0, 1, 1_000_001)
    w = np.interp(t, [p[0] for p in points], [p[1] for p in points])
    c = np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2)))
    return float(np.interp(y, c / c[-1], t))


def test_schedules_of_several_points(spark):
    docs = [(i, "one two three four", "a" if i < 60 else "b") for i in range(90)]
    used, _ = run(spark, docs, [("a", 0.6, 1), ("b", 0.4, 2)])
    plans = {"a": [(0.0, 0.0), (0.3, 2.0), (0.6, 2.0), (1.0, 0.0)], "b": [(0.5, 1.0)]}
    rows = [(" A", t, w) for t, w in plans["a"]] + [("b", t, w) for t, w in plans["b"]] + [("b", None, 3.0), ("c", 0.0, 0.0), ("a", 0.3, 1.0)]
    order = mixing.curriculum(used, spark.createDataFrame(rows, "source string, t double, weight double")).collect()
    whole = {r["doc_id"]: r for r in used.collect()}
    assert len(order) == sum(r["uses"] for r in whole.values())
    for r in order:
        u = whole[r["doc_id"]]
        y = min(1.0, (r["use_no"] * u["available"] + u["offset"]) / u["demanded"])
        assert abs(r["position"] - brute_position(plans[r["source"]], y)) < 1e-3


def test_empty_tables(spark):
    used, plan = run(spark, [], [("a", 1.0, 2)])
    assert used.count() == 0
    assert mixing.shares(used, plan).collect()[0]["tokens_used"] == 0
    used, plan = run(spark, [(1, None, "a"), (2, "", "a")], [])
    assert [r["uses"] for r in used.collect()] == [0, 0]
