"""Grounding, deduplication, statistics and lineage on literal cases."""

import json
import random

import pytest

from auditloom.operators import catalog, evidence, gates

EV = "evidence_id bigint, run_id string, tool_input string, tool_response string"


def ev(spark, *texts):
    rows = [(i, "r", json.dumps({"query": f"q{i}"}), json.dumps({"query": "https://example.org/invented", "results": [t]})) for i, t in enumerate(texts)]
    return evidence.parsed(spark.createDataFrame(rows, EV))


GROUNDING = [
    ("https://a.com/doc", "url https://a.com/doc", True), ("https://fake.com/x", "url https://a.com/doc", False), ("https://a.com/doc", "url https://a.com/doc/123", False),
    ("https://a.com", "url https://a.com/news/123", False), ("www.idc.com", "…官方网站是 **www.idc.com**。", True), ("https://a.com/doc", "入口 **https://a.com/doc/123** 见上", False),
    ("https://a.com/manual", "url https://a.com/manual.pdf", False), ("https://a.com/doc", "see https://a.com/doc for details", True), ("https://www.example.com/", "官网是 www.example.com。", True),
    ("https://a.com/doc", "url https://a.com/doc?dgcid=1", False), ("https://a.com/doc.pdf", "url https://a.com/doc.pdf#2#1", True), ("https://a.com/page", "url https://a.com/page#top", True),
    ("https://a.com/list", "url https://a.com/list?page=2", False), ("https://example.org/invented", "nothing", False), ("https://a.com/doc", "见 https://a.com/doc 说明", True),
    ("https://a.com/doc", "first\nhttps://a.com/doc", True),
]


@pytest.mark.parametrize("url,text,want", GROUNDING)
def test_grounding(spark, url, text, want):
    c = spark.createDataFrame([(1, "r", url), (2, "r", None)], "store_id int, run_id string, url string")
    got = {r["store_id"]: r["is_grounded"] for r in evidence.grounded(c, ev(spark, text), "store_id").collect()}
    assert got == {1: want, 2: False}


def test_payload_shapes(spark):
    rows = [(1, "r", '{"query":"a"}', '{"results":[{"url":"u1","title":"t"},"text",{"tool_use_id":"x","content":[{"url":"u2"},{"text":"z"}]},5,null]}'), (2, "r", None, None), (3, "r", "{", "[1"), (4, "r", "{}", '{"query":"b","results":{"url":"no"}}')]
    e = evidence.parsed(spark.createDataFrame(rows, EV))
    assert sorted((r["evidence_id"], r["pos"], r["sub"], r["url"]) for r in evidence.result_urls(e).collect()) == [(1, 0, -1, "u1"), (1, 2, 0, "u2")]
    assert {r["evidence_id"]: r["query"] for r in e.collect()} == {1: "a", 2: None, 3: None, 4: "b"}


def greedy(rows):
    seen, out = set(), []
    for seq, name, url in rows:
        if not name or not url:
            continue
        import re

        u = re.sub(r"/$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", re.sub(r"(#\d+)+$", "", url)))
        h = re.split(r"[/?#]", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url))[0].lower()
        if ("u", u) in seen or ("n", h, name) in seen:
            continue
        seen |= {("u", u), ("n", h, name)}
        out.append(seq)
    return out


DEDUP = [
    ([("Same", "https://a.com/page1"), ("Same", "https://a.com/page2")], [0]), ([("Same", "https://a.com/data"), ("Same", "https://mirror.org/data")], [0, 1]), ([("A", "https://a.com/1"), ("B", "https://a.com/2")], [0, 1]),
    ([("康宁 Corning", "https://www.corning.com"), ("康宁 Corning", "www.corning.com")], [0]), ([("康宁官网", "https://www.corning.com"), ("Corning 中国", "www.corning.com/")], [0]),
    ([("A", "https://a.com/doc.pdf#2#1"), ("B", "https://a.com/doc.pdf#3")], [0]), ([("n1", "a.com/1"), ("n1", "a.com/2"), ("n2", "a.com/2")], [0, 2]),
]


@pytest.mark.parametrize("rows,want", DEDUP)
def test_keep_first(spark, rows, want):
    df = spark.createDataFrame([(i, "r", n, u) for i, (n, u) in enumerate(rows)], "store_id int, run_id string, name string, url string")
    assert sorted(r["store_id"] for r in catalog.keep_first(df, "store_id", ["run_id"]).collect()) == want


def test_keep_first_like_one_pass(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", "c", None, ""]), rng.choice([None, "", *[f"https://h{k % 2}.com/{k}" for k in range(6)]])) for i in range(120)]
    df = spark.createDataFrame([(i, "r", n, u) for i, n, u in rows], "store_id int, run_id string, name string, url string").repartition(7)
    assert sorted(r["store_id"] for r in catalog.keep_first(df, "store_id", ["run_id"]).collect()) == greedy(rows)


def test_leaf_and_stats(spark):
    nodes = spark.createDataFrame([("r", n) for n in ("AI训练GPU", "A-B", "B", "空")], "run_id string, node string")
    rows = spark.createDataFrame([(1, "r", "算力服务器-A-B", "文档"), (2, "r", "算力服务器-未知节点", "文档"), (3, "r", None, "数据集"), (4, "r", "A-B", "数据集"), (5, "r", "x-B", "文档")], "store_id int, run_id string, category_path string, source_type string")
    located = catalog.leaf_nodes(rows, nodes, "store_id")
    assert {r["store_id"]: r["leaf"] for r in located.collect()} == {1: "A-B", 2: None, 3: None, 4: "A-B", 5: "B"}
    stats = {r["node"]: (r["n"], r["types"]) for r in catalog.stats_by_node(located, nodes).collect()}
    assert stats == {"AI训练GPU": (0, ""), "A-B": (2, "数据集:1; 文档:1"), "B": (1, "文档:1"), "空": (0, ""), "总计": (3, "文档:2; 数据集:1")}


def test_lineage(spark):
    e = evidence.parsed(spark.createDataFrame([(1, "r", '{"query":"q1"}', json.dumps({"results": [{"url": u} for u in ("https://a.com/doc", "https://b.com/data#2", "https://c.com/other")]}))], EV))
    j = spark.createDataFrame([(1, "r", "增量发现", "N", "q1", 10)], "store_id int, run_id string, phase string, node string, query string, results int")
    s = spark.createDataFrame([(5, "r", "A", "https://a.com/doc", "why"), (6, "r", "B", "https://b.com/data", None)], "store_id int, run_id string, name string, url string, reason string")
    got = sorted((r["url"], r["collected"], r["name"], r["results"]) for r in catalog.lineage(evidence.result_urls(e), j, s).collect())
    assert got == [("https://a.com/doc", "是", "A", 10), ("https://b.com/data", "是", "B", 10), ("https://c.com/other", "否", "", 10)]
    first = {r["store_id"]: r["first_query"] for r in evidence.first_queries(s, e, "store_id").collect()}
    assert first == {5: "q1", 6: "q1"}


def test_quota(spark):
    nodes = spark.createDataFrame([("r", "A"), ("r", "B")], "run_id string, node string")
    rows = [(i, "r", "增量发现", "A", f"a{i}") for i in range(20)] + [(100 + i, "r", "增量发现", "B", f"b{i}") for i in range(8)]
    j = spark.createDataFrame(rows, "store_id int, run_id string, phase string, node string, query string")
    e = spark.createDataFrame([("r", q) for *_, q in rows], "run_id string, query string")
    assert [(r["node"], r["n_evidenced"]) for r in gates.quota(j, nodes, e).collect()] == [("B", 8)]
    assert gates.quota(j, nodes, e.limit(0)).count() == 2


def test_empty_tables(spark):
    s = spark.createDataFrame([], "store_id int, run_id string, name string, url string, category_path string, source_type string, reason string")
    n = spark.createDataFrame([], "run_id string, node string")
    e = evidence.parsed(spark.createDataFrame([], EV))
    assert catalog.keep_first(s, "store_id", ["run_id"]).count() == 0
    assert catalog.stats_by_node(catalog.leaf_nodes(s, n, "store_id"), n).count() == 0
    assert evidence.grounded(s, e, "store_id").count() == 0


def test_nearest_declared_like_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
    told = sorted({(f"r{i % 4}", word()) for i in range(40)}) + [("s", "甲乙"), ("s", "远处的一个名称"), ("t", None)]
    rows = [(i, f"r{i % 4}", word()) for i in range(200)] + [(900, "s", "甲丙"), (901, "t", "x"), (902, "u", "x"), (903, "s", None), (904, "s", "甲乙"), (905, "s", "甲丙")]
    got = gates.nearest_declared(spark.createDataFrame(rows, "store_id int, run_id string, name string"), spark.createDataFrame(told, "run_id string, name string"))
    want = {}
    for i, run, name in rows:
        own = [n for r, n in told if r == run and n is not None]
        if name is not None and name not in own:
            want[i] = min(own, key=lambda n: (distance(name, n), n), default=None)
    assert {r["store_id"]: r["suggestion"] for r in got.collect()} == want and want[900] == "甲乙"


def test_nearest_declared_in_parts(spark, monkeypatch):
    told = [("r", f"名称{i:03}") for i in range(40)] + [("s", "x")]
    rows = [(i, "r", f"名称{i:03}末") for i in range(40)] + [(50, "s", "y"), (51, "s", "y")]
    monkeypatch.setattr(gates, "LISTED", 7)
    monkeypatch.setattr(gates, "ASKED", 3)
    got = gates.nearest_declared(spark.createDataFrame(rows, "store_id int, run_id string, name string"), spark.createDataFrame(told, "run_id string, name string"))
    assert sorted((r["store_id"], r["suggestion"]) for r in got.collect()) == [(i, f"名称{i:03}") for i in range(40)] + [(50, "x"), (51, "x")]


def test_nearest_declared_broadcasts_nothing(spark):
    # the estimated size of names is that of the files, however many of them there are
    name = [("r", "a")]
    df = gates.nearest_declared(spark.createDataFrame([(1, "r", "b")], "store_id int, run_id string, name string"), spark.createDataFrame(name, "run_id string, name string"))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_never_leaves_rows_undecided(spark):
    # a row shares its name with the row before and its page with the row after, or the other way round
    chain = [(i, "r", f"n{i // 2}", f"https://a.com/{(i + 1) // 2}") for i in range(6)]
    rows = spark.createDataFrame(chain, "seq int, run_id string, name string, url string")
    assert sorted(r["seq"] for r in catalog.keep_first(rows, "seq", ["run_id"]).collect()) == [0, 2, 4]
    with pytest.raises(ValueError):
        catalog.keep_first(rows, "seq", ["run_id"], max_rounds=1)


def test_gates_of_a_run(spark):
    """Each gate on rows that violate it and rows that do not."""
    cols = "store_id bigint, run_id string, phase string, node string, query string, results int, extracted int, zero_reason string"
    rows = [
        (1, "r", "增量发现", "n", "q1", 5, 2, ""), (2, "r", "增量发现", "n", "q2", 5, 0, " "), (3, "r", "扩量", "n", "q3", 5, 0, "垃圾域"), (4, "r", "扩量", "n", "q4", 5, 0, "垃圾域"), (5, "r", "扩量", "n", "q5", 5, 0, "已收"), (6, "r", "扩量", "n", "q6", 5, 0, "重复"),
        (7, "r", "验证", "n", "q7", 5, 0, ""), (8, "s", "增量发现", "n", "q8", 5, 3, ""), (9, "t", "验证", "n", "q9", 5, 3, ""), (10, "r", "扩量", "n", "none", 0, 0, "垃圾域"),
    ]
    journal = spark.createDataFrame(rows, cols)
    urls = [("r", "q3", "https://books.google.com/x"), ("r", "q4", "https://a.com/x"), ("r", "q5", "https://a.com/y"), ("r", "q6", "https://z.com/y"), ("r", "q2", "https://patents.google.com/patent/US1")]
    items = spark.createDataFrame([(1, *u) for u in urls], "evidence_id bigint, run_id string, query string, url string")
    kept = spark.createDataFrame([("r", "https://a.com/doc")], "run_id string, url string")
    ids = lambda df: {r["store_id"] for r in df.collect()}
    assert {r["run_id"] for r in gates.sources_missing(journal, kept).collect()} == {"s"}
    assert ids(gates.zero_without_reason(journal)) == {2}
    assert ids(gates.garbage_claims(journal, items)) == {4} and ids(gates.collected_claims(journal, items, kept)) == {6}
    both = {r["store_id"]: (r["garbage_claim"], r["collected_claim"]) for r in gates.claims(journal, items, kept).collect()}
    assert both == {2: (False, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, True)}
    assert ids(gates.single_documents(journal, items)) == {2}
