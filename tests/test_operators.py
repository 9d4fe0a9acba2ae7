import itertools
import random

from pyspark.sql import functions as F

from folioforge.operators import graph, perimeter, report, sampling
from folioforge.operators.near_duplicates import near_duplicate_groups
from folioforge.sources.connectors import read_findings, read_html_files, write_findings
from folioforge.streaming import arrivals_by_window, latest_fetches, open_circuits


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (300, 301), (None, 4), (301, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {n: find(n) for n in root}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    df = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["component"] for r in graph.connected_components(df).collect()} == {0}


def test_pagerank_keeps_the_total(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (9, 1)], "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    rank = dict.fromkeys(range(6), 1 / 6)
    out = {0: [1, 1, 2], 1: [2], 2: [0], 3: [2]}
    for _ in range(20):
        new = dict.fromkeys(range(6), 0.15 / 6)
        for n, r in rank.items():
            for t in out.get(n, range(6)):
                new[t] += 0.85 * r / len(out.get(n, range(6)))
        rank = new
    assert all(abs(got[n] - rank[n]) < 1e-9 for n in rank) and abs(sum(got.values()) - 1) < 1e-9


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs, n = [], 0
    for _ in range(15):
        base = [rng.choice(words) for _ in range(40)]
        for k in (0, 0, 1, 8):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(40)] = "edit"
            n += 1
            docs.append((n, " ".join(own)))
    docs += [(900, None), (901, ""), (902, "one two"), (903, "One, two!")]
    sets = {}
    for i, t in docs:
        w = (t or "").lower().replace(",", "").replace("!", "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = {i: 0 for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    rows = near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: r["links"] for r in rows} == links


def test_allocation_and_even_pick(spark):
    sizes = spark.createDataFrame([("a", "x", 50), ("a", "y", 3), ("a", "z", 1), ("b", "q", 2)], "host string, template string, size long")
    got = {(r["host"], r["template"]): r["slots"] for r in sampling.allocate(sizes, "host", "template", "size", 10).collect()}
    assert got["a", "z"] == 1 and got["a", "x"] >= 7 and sum(v for k, v in got.items() if k[0] == "a") <= 10 and got["b", "q"] == 2
    few = {r["template"]: r["slots"] for r in sampling.allocate(sizes.where("host = 'a'"), "host", "template", "size", 2).collect()}
    assert few == {"x": 1, "y": 1, "z": 0}
    rows = spark.range(10).select(F.lit("a").alias("g"), F.col("id").alias("o"), F.lit(4).alias("slots"))
    assert sorted(r["o"] for r in sampling.pick_evenly(rows, ["g"], ["o"], "slots").collect()) == [0, 2, 5, 7]


ROBOTS = "User-agent: GoodBot\nUser-agent: Other\nAllow: /\nDisallow: /private\n\n# note\nUser-agent: *\nDisallow: /\nAllow: /open\nSitemap: x"


def test_robots(spark):
    robots = spark.createDataFrame([("s", "robots", "present", ROBOTS, None), ("t", "robots", "absent", None, None), ("u", "robots", "present", "", None)], "site string, kind string, status string, text string, content_type string")
    paths = spark.createDataFrame([("s", "/"), ("s", "/private/x"), ("s", "/open/y"), ("u", "/")], "site string, path string")
    got = {(r["site"], r["agent"], r["path"]): r["allowed"] for r in perimeter.allowed(robots, ["goodbot", "Fetch"], paths).collect()}
    assert got["s", "goodbot", "/"] and not got["s", "goodbot", "/private/x"]
    assert not got["s", "Fetch", "/"] and got["s", "Fetch", "/open/y"] and got["u", "Fetch", "/"]
    assert not any(k[0] == "t" for k in got)


def test_report(spark):
    rows = [("B-1", "high", "defect", "s", "low", 1, "h", "https://h/1"), ("B-1", "high", "defect", "s", "high", 2, "h", "https://h/2"), ("A-1", "low", "proactive", "s", "high", 1, "h", "https://h/1"), ("C-1", "odd", "defect", "s", "high", 1, "h", "https://h/1")]
    f = spark.createDataFrame(rows, "id string, severity string, track string, skill string, confidence string, page_id long, host string, page_url string")
    merged = {r["id"]: r for r in report.merge(f).collect()}
    assert merged["B-1"]["pages"] == 2 and merged["B-1"]["confidence"] == "low" and not merged["B-1"]["conflict"]
    assert [(r["id"], r["problem"]) for r in report.violations(f).collect()] == [("C-1", "unknown severity")]
    numbers = {r["id"]: r["number"] for r in report.numbered(report.merge(f.where("id <> 'C-1'"))).collect()}
    assert numbers == {"B-1": "F-001", "A-1": "F-002"}
    assert report.merge(f.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>\n<p>y</p>")
    assert read_html_files(spark, str(tmp_path / "a.html")).first()["html"] == "<p>x</p>\n<p>y</p>"
    out = str(tmp_path / "f")
    write_findings(spark.createDataFrame([("A", "low", 3)], "id string, severity string, page_id long"), out)
    with open(next(p for p in (tmp_path / "f").iterdir() if p.name.startswith("part-")), "a") as f:
        f.write("{broken\n")
    for p in (tmp_path / "f").glob(".*.crc"):
        p.unlink()
    assert sorted(r["id"] for r in read_findings(spark, out).collect()) == ["*", "A"]


def test_kept_tables_are_forgotten(spark):
    from folioforge.sources import forget, keep

    kept = keep(spark.range(5), "x")
    assert kept.count() == 5 and forget(spark) >= 1
    assert forget(spark) == 0


def test_streams(spark, tmp_path):
    rows = "page_id long, page_url string, status string, loaded_at timestamp"
    data = spark.sql("select id % 7 as page_id, concat('https://www.a.example/', id) as page_url, 'present' as status, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as loaded_at from range(40)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", latest_fetches(stream), "append"), ("counts", arrivals_by_window(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 7
    assert spark.table("counts").agg(F.sum("fetches")).first()[0] == 40
    assert arrivals_by_window(data).agg(F.sum("fetches")).first()[0] == 40
    spark.sql("select 'h' as host, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, id in (1, 2, 5, 7, 8, 9) as failed from range(12)").coalesce(1).write.parquet(str(tmp_path / "probe"))
    s = spark.readStream.schema("host string, ts timestamp, failed boolean").parquet(str(tmp_path / "probe"))
    q = open_circuits(s).writeStream.format("memory").queryName("open").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("open").count() == 2
