"""Whole runs from files."""

import csv
import json
from pathlib import Path

import pytest

from auditloom.operators import evidence
from auditloom.plans import pipeline
from auditloom.sources import logs

NOW = "2026-08-13-183045"
NODES = ["AI训练GPU", "图形渲染GPU", "服务器CPU"]
SOURCES = [
    {"name": "A", "category_path": "算力服务器-GPU服务器-AI训练GPU", "source_type": "官方文档", "url": "https://a.com/doc"}, {"name": "B", "category_path": "算力服务器-图形渲染GPU", "source_type": "数据集", "url": "https://b.com/data"},
    {"name": "A", "category_path": "算力服务器-GPU服务器-AI训练GPU", "source_type": "文档", "url": "https://a.com/doc"}, {"name": "C", "category_path": "x", "source_type": "文档"}, {"url": "https://c.com", "source_type": "文档"}, "stray",
]


def write_evidence(path, queries=("q1",)):
    lines = [{"tool_name": "WebSearch", "tool_input": {"query": q}, "tool_response": {"query": q, "results": [{"url": "https://a.com/doc"}, {"content": [{"url": "https://b.com/data"}]}]}} for q in queries]
    path.write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n", encoding="utf-8")
    return str(path)


def read(out, kind):
    return list(csv.reader(open(next(Path(out).rglob(f"*_{kind}.csv")), encoding="utf-8-sig", newline="")))


def test_raw_run(spark, tmp_path):
    raw = tmp_path / "raw.json"
    journal = [{"phase": "增量发现", "node": "AI训练GPU", "query": "q1", "results": 7, "extracted": 1}, "stray"]
    raw.write_text(json.dumps({"domain": "算力服务器", "nodes": NODES, "sources": SOURCES, "knowledge": 5, "journal": journal}), encoding="utf-8")
    got = pipeline.run_pipeline(spark, str(raw), str(tmp_path), NOW, write_evidence(tmp_path / "e.jsonl"))
    want = {"total_found": 3, "removed_duplicates": 1, "ungrounded": 0, "kept": 2, "invalid": 2, "empty_nodes": ["服务器CPU"], "journal_count": 1, "lineage_rows": 2, "list_verified": "0/0"}
    assert {k: got[k] for k in want} == want and got["out_dir"].endswith(f"算力服务器_{NOW}")
    assert read(got["out_dir"], "stats")[1:] == [["AI训练GPU", "1", "文档:1"], ["图形渲染GPU", "1", "数据集:1"], ["服务器CPU", "0", ""], ["总计", "2", "数据集:1; 文档:1"]]
    assert [r[0] for r in read(got["out_dir"], "数据源清单")[1:]] == ["A", "B"] and read(got["out_dir"], "数据源清单")[1][6] == "q1"
    assert read(got["out_dir"], "搜索日志")[1] == ["增量发现", "AI训练GPU", "q1", "7", "1", "否", ""]
    assert [(r[4], r[5]) for r in read(got["out_dir"], "溯源")[1:]] == [("https://a.com/doc", "是"), ("https://b.com/data", "是")]
    # the same run from its logs gives the same deliverables
    run = tmp_path / "run"
    run.mkdir()
    (run / "manifest_input.json").write_text(json.dumps({"domain": "算力服务器", "nodes": NODES}), encoding="utf-8")
    rows = [s | {"type": "source"} for s in SOURCES if isinstance(s, dict)] + [journal[0] | {"type": "search"}]
    (run / "store_input.jsonl").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    again = pipeline.fold(spark, str(run), str(tmp_path), NOW, str(tmp_path / "e.jsonl"), enforce=False)
    assert again["out_dir"] != got["out_dir"]
    assert sorted(p.name for p in (Path(again["out_dir"]) / "intermediate").iterdir() if not p.name.endswith(".csv")) == ["evidence.jsonl", "manifest_input.json", "store_input.jsonl"]
    assert (again["evidence_slice_kept"], again["evidence_slice_skipped"]) == (1, 1) and not list(run.iterdir())
    for kind in ("stats", "数据源清单", "搜索日志", "溯源"):
        assert read(again["out_dir"], kind) == read(got["out_dir"], kind)
    for f, name in (("manifest_input.json", "manifest.json"), ("store_input.jsonl", "store.jsonl")):
        (run / name).write_bytes((Path(again["out_dir"]) / "intermediate" / f).read_bytes())
    with pytest.raises(pipeline.GateError, match="AI训练GPU 1 次（缺 19）"):
        pipeline.fold(spark, str(run), str(tmp_path), NOW, str(tmp_path / "e.jsonl"))
    assert [json.loads(x)["code"] for x in open(run / "rejects.jsonl", encoding="utf-8")] == ["QUOTA_SHORT"]


def test_what_stops_a_run(spark, tmp_path):
    raw = tmp_path / "raw.json"
    raw.write_text(json.dumps({"nodes": NODES, "sources": SOURCES}))
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline(spark, str(raw), str(tmp_path / "o"), NOW)
    raw.write_text(json.dumps({"sources": SOURCES}))
    with pytest.raises(ValueError, match="nodes"):
        pipeline.run_pipeline(spark, str(raw), str(tmp_path / "o"), NOW)
    raw.write_text(json.dumps({"nodes": NODES, "journal": [{"phase": "增量发现", "query": "q1"}]}))
    with pytest.raises(pipeline.GateError):
        pipeline.run_pipeline(spark, str(raw), str(tmp_path / "o"), NOW, write_evidence(tmp_path / "e.jsonl"))
    with pytest.raises(FileNotFoundError):
        pipeline.fold(spark, str(tmp_path / "none"), str(tmp_path / "o"), NOW)
    (tmp_path / "manifest_input.json").write_text(json.dumps({"nodes": NODES, "vendors": [{"name": "V", "node": "服务器CPU"}]}), encoding="utf-8")
    with pytest.raises(pipeline.GateError, match="清单项未核对: V"):
        pipeline.fold(spark, str(tmp_path), str(tmp_path / "o"), NOW)
    assert not (tmp_path / "o").exists()
    assert [json.loads(x)["code"] for x in open(tmp_path / "rejects.jsonl", encoding="utf-8")] == ["CHECKLIST_UNRECORDED"]


def test_empty_run(spark, tmp_path):
    raw = tmp_path / "raw.json"
    raw.write_text(json.dumps({"nodes": NODES}))
    got = pipeline.run_pipeline(spark, str(raw), str(tmp_path), NOW)
    assert got["kept"] == 0 and read(got["out_dir"], "stats")[-1] == ["总计", "0", ""] and "未命名领域" in got["out_dir"]


def test_record_sources(spark, tmp_path):
    cols = "store_id bigint, run_id string, name string, category_path string, source_type string, granularity string, url string, description string, reason string"
    rows = [(1, "run", "A", "x-AI训练GPU", "官方文档", None, "https://a.com/doc", None, None), (2, "run", "B", "x-AI训练GPU", "?", None, "https://a.com/doc", None, None), (3, "run", "C", "x", "文档", None, "https://b.com/data", None, None), (4, "run", "", "x", "文档", None, None, None, None)]
    nodes = spark.createDataFrame([("run", n) for n in NODES], "run_id string, node string")
    ev = pipeline._evidence(spark, write_evidence(tmp_path / "e.jsonl"))
    got = pipeline.record_sources(spark.createDataFrame(rows, cols), nodes, ev, str(tmp_path / "store"), str(tmp_path / "rejects"))
    assert got == {"accepted": 1, "rejected": 2, "skipped": 1}
    row = spark.read.json(str(tmp_path / "store")).first()
    assert (row["source_type"], row["source_type_raw"], row["granularity"]) == ("文档", "官方文档", "合集级")
    assert evidence.tokens(ev).count() > 0
    again = pipeline.record_sources(spark.createDataFrame(rows, cols).where("store_id < 3"), nodes, ev, str(tmp_path / "store"), str(tmp_path / "rejects"))
    assert again == {"accepted": 0, "rejected": 0, "skipped": 2}


def test_record_knowledge_and_search(spark, tmp_path):
    store, rejects = str(tmp_path / "store"), str(tmp_path / "rejects")
    ev = pipeline._evidence(spark, write_evidence(tmp_path / "e.jsonl"))
    cols = "store_id bigint, run_id string, name string, node string, verified boolean, category_path string, source_type string, granularity string, url string, description string, reason string, note string"
    item = lambda i, name, url, verified=True, node="服务器CPU": (i, "run", name, node, verified, "x-服务器CPU", "官方文档", None, url, None, None, "n")
    rows = [item(1, "K 门户", "https://a.com/doc"), item(2, "K 门户库", "https://a.com/doc"), item(3, "K 门户", ""), item(4, "K 门户", "", False), item(5, "K 门户", "https://other.com/x"), item(6, "", "https://a.com/doc"), item(7, "K 门户", "https://x.csdn.net/y"), item(8, "K 门户", "https://a.com/doc", True, None)]
    declared = spark.createDataFrame([("run", "K 门户")], "run_id string, name string")
    assert pipeline.record_knowledge(spark.createDataFrame(rows, cols), declared, ev, store, rejects) == {"accepted": 2, "rejected": 6}
    codes = {(r["code"], (r["detail"] or {}).get("suggestion")) for r in logs.read_rejects(spark, rejects).collect()}
    assert codes == {("NOT_DECLARED", "K 门户"), ("WITHOUT_URL", None), ("UNGROUNDED", None), ("INCOMPLETE", None), ("GARBAGE", None)}
    assert pipeline.record_knowledge(spark.createDataFrame([item(9, "任意", "https://a.com/doc")], cols), None, ev, store, rejects) == {"accepted": 1, "rejected": 0}
    search = spark.createDataFrame([("run", "增量发现", "服务器CPU", "q", 10, 0, None)], "run_id string, phase string, node string, query string, results int, extracted int, zero_reason string")
    assert pipeline.record_search(search, store) == 1
    kept = spark.read.schema(logs.STORE_SCHEMA).json(store).collect()
    assert {(r["type"], r["source_type"], r["source_type_raw"], r["zero_reason"]) for r in kept} == {("knowledge", "文档", "官方文档", None), ("search", None, None, "")} and all(r["ts"] for r in kept)


def test_attestation_report_and_archive(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "manifest.json").write_text(json.dumps({"domain": "域", "nodes": NODES[:1], "model": "m", "knowledge": [{"name": "K1", "node": NODES[0]}]}), encoding="utf-8")
    path = f"a-{NODES[0]}"
    rows = [{"type": "source", "name": "A", "category_path": path, "source_type": "某新词", "url": "https://a.com/doc"}, {"type": "source", "name": "T", "category_path": path, "source_type": "文档", "url": "https://t.com/only"}]
    rows += [{"type": "search", "phase": "增量发现", "node": NODES[0], "query": f"q{i}", "results": 1, "extracted": 0, "zero_reason": "已收"} for i in range(21)]
    rows += [{"type": "knowledge", "name": "K1", "node": NODES[0], "verified": False}]
    (run / "store.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    (run / "rejects.jsonl").write_text('{"code":"GARBAGE_DOMAIN","actor":"model"}\n{"code":"NO_CANDIDATES","actor":"env","detail":{}}\n', encoding="utf-8")
    write_evidence(run / "evidence.jsonl", [f"q{i}" for i in range(20)] + ["漏记"])
    with open(run / "evidence.jsonl", "a", encoding="utf-8") as f:
        f.write(json.dumps({"tool_input": {"query": "q0"}, "tool_response": {"results": ["见 **https://t.com/only** 。"]}}) + "\n")
    got = pipeline.fold(spark, str(run), str(tmp_path / "out"), NOW)
    told = pipeline.read_attestation(got["out_dir"])
    assert told["sources"]["kept"] == got["kept"] == 2 and told["sources"]["unmapped_types"] == {"某新词": 1} and told["model"] == "m" and len(told["script_fingerprint"]) == 12
    assert told["quota"] == {"required_per_node": 20, "per_node": {NODES[0]: 21}, "unevidenced": 1}
    assert told["zero_extraction"]["count"] == 21 and {r["zero_reason"] for r in told["zero_extraction"]["rows"]} == {"已收"}
    assert told["knowledge"] == {"declared": 1, "recorded": 1, "verified": 0, "unverified": 1, "missing": [], "list_verified": "0/1"}
    assert told["reverse_gap"] == {"applicable": True, "evidence_queries": 21, "journal_queries": 21, "unlogged": 1, "unlogged_samples": ["漏记"]}
    assert told["sources"]["reject_events"] == {"total": 2, "by_code": {"GARBAGE_DOMAIN": 1, "NO_CANDIDATES": 1}, "by_actor": {"env": 1, "model": 1}}
    last = read(got["out_dir"], "溯源")[-1]
    assert (last[2], last[4], last[6], last[8]) == ("q0", "https://t.com/only", "T", "摘要文本提取")
    inner = Path(got["out_dir"]) / "intermediate"
    assert {"evidence.jsonl", "manifest_input.json", "store_input.jsonl", "rejects.jsonl"} <= {p.name for p in inner.iterdir()} and not list(run.iterdir())
    (Path(got["out_dir"]) / "草稿.md").write_text("# 题\n\n正文\n", encoding="utf-8")
    report = Path(pipeline.finish_report(got["out_dir"])).read_text(encoding="utf-8")
    assert report.startswith("# 题\n\n## 统计") and f"{NODES[0]}：2" in report and len(list(Path(got["out_dir"]).glob("*.md"))) == 1


def test_messages_say_how_many_more(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"nodes": NODES, "vendors": [{"name": f"V{i:03}", "node": NODES[0]} for i in range(120)]}), encoding="utf-8")
    with pytest.raises(pipeline.GateError, match="V099 等共 120 项"):
        pipeline.fold(spark, str(tmp_path), str(tmp_path / "o"), NOW)
