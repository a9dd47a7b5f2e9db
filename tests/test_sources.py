"""Readers, sinks and streams."""

import csv
import json

from auditloom.sources import logs, sinks
from auditloom.streaming import ingest


def test_store_and_evidence_lines(spark, tmp_path):
    p = tmp_path / "store.jsonl"
    p.write_text('{"type":"source","name":"A"}\nnot json\n{"type":"search","results":3}\n', encoding="utf-8")
    rows = logs.read_store_lines(spark, str(p)).orderBy("seq").collect()
    assert [(r["seq"], r["type"], r["bad_line"]) for r in rows] == [(0, "source", None), (1, None, "not json"), (2, "search", None)]
    q = tmp_path / "evidence.jsonl"
    q.write_bytes(b'{"tool_name":"WebSearch"}\n\xff\xfe broken\n')
    docs = logs.read_evidence_lines(spark, str(q)).orderBy("line_no").collect()
    assert [d["doc"] is None for d in docs] == [False, True]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}.jsonl").write_text("".join(f"{k}-{i} {'x' * (i % 50)}\n" for i in range(3000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = logs.read_transcripts(spark, str(tmp_path / "*.jsonl"))
        assert rows.rdd.getNumPartitions() > 4
        got = {(r["session"], r["line_no"], r["line"].split()[0]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"s{k}.jsonl", i, f"{k}-{i}") for k in range(2) for i in range(3000)}
    assert logs.first_file(spark, str(tmp_path / "s*.jsonl")).endswith("s0.jsonl") and logs.first_file(spark, str(tmp_path / "z*")) is None
    old = spark.createDataFrame([("a", "b")], "`名称` string, `地址` string")
    assert logs.with_columns(old, name=("数据源名称", "名称"), level=("粒度",)).collect() == [("a", None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', "line\nbreak"), (None, "", "z")], "a string, b string, c string")
    path = str(tmp_path / "t.csv")
    assert sinks.write_csv(df.coalesce(1), path, ["甲", "乙", "丙"]) == 2
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    assert list(csv.reader(open(path, encoding="utf-8-sig", newline="")))[1:] == [["a,b", 'say "x"', "line\nbreak"], ["", "", "z"]]
    back = logs.read_csv_table(spark, path)
    assert back.columns == ["甲", "乙", "丙"] and back.count() == 2 and back.first()["丙"] == "line\nbreak"
    assert sinks.write_csv(df.limit(0), str(tmp_path / "no.csv"), ["a"], skip_empty=True) == 0 and not (tmp_path / "no.csv").exists()


def test_append_and_rejects(spark, tmp_path):
    path = str(tmp_path / "rejects")
    assert logs.read_rejects(spark, path).count() == 0
    df = spark.createDataFrame([("t", "GARBAGE_DOMAIN", None, None, None, None, {"k": "v"})], logs.REJECT_SCHEMA)
    assert sinks.append_rows(df.limit(0), path) == 0 and not (tmp_path / "rejects").exists()
    assert sinks.append_rows(df, path) == 1 and sinks.append_rows(df, path) == 1
    assert logs.read_rejects(spark, path).count() == 2


def test_run_directory_and_report(tmp_path):
    a = sinks.run_directory(str(tmp_path), "算 力", "2026-08-13-183045")
    a.mkdir()
    b = sinks.run_directory(str(tmp_path), "算 力", "2026-08-13-183045")
    a.rmdir()
    assert a.name == "算_力_2026-08-13-183045" and b.name == a.name + "_1"
    (tmp_path / "f.json").write_text("{}")
    for d in (a, b):
        assert not d.exists()
    with sinks.delivery(a) as part:
        (part / "x").write_text("1")
        assert not a.exists()
    assert (a / "x").exists() and not list(tmp_path.glob(".*"))
    try:
        with sinks.delivery(tmp_path / "c"):
            raise ValueError
    except ValueError:
        assert not (tmp_path / "c").exists() and not list(tmp_path.glob(".*"))
    sinks.archive(a, [str(tmp_path / "f.json"), str(tmp_path / "missing")])
    assert (a / "intermediate" / "f.json").exists()
    once = sinks.inject_stats("# T\n\ntext\n", [("N", 2, "文档:2")])
    assert once.startswith("# T\n\n## 统计\n\n- N：2 文档:2")
    assert sinks.inject_stats(once, [("N", 3, "")]).count("## 统计") == 1
    assert sinks.STATS_PLACEHOLDER in sinks.inject_stats("x", None)
    assert sinks.write_attestation({"a": 1}, str(tmp_path / "no" / "x.json")) is False
    assert sinks.write_attestation({"a": 1}, str(tmp_path / "x.json")) and json.loads((tmp_path / "x.json").read_text()) == {"a": 1}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"run_id": "r", "name": "A", "url": "https://a.com/1", "type": "source"}, {"run_id": "r", "name": "", "url": "https://a.com/2", "type": "source"}, {"run_id": "r", "name": "C", "url": "www.jd.com", "type": "source"}]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    good, bad = [], []
    s = ingest.read_store_stream(spark, str(src), "run_id string, name string, url string, type string")
    f = ingest.validate_batches(lambda d: good.extend(d.collect()), lambda d: bad.extend(d.collect()))
    q = s.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["name"] for r in good] == ["A"] and sorted(r["code"] for r in bad) == ["GARBAGE_DOMAIN", "INCOMPLETE"]


def test_stream_dedup(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/store.parquet").select("store_id", "run_id", "type", "url", "ingested_at").schema
    raw = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "store.parquet").load(sf)
    one = ingest.new_entries(raw.where("url is not null").selectExpr("*", "cast(ingested_at as timestamp) as at"), "at", "9000 days")
    q = one.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = spark.read.parquet(f"{sf}/store.parquet").where("url is not null").select("run_id", "url").distinct().count()
    assert spark.sql("select * from seen").count() == want


def test_stream_windows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("2026-01-01T10:00:00", "a"), ("2026-01-01T20:00:00", "a"), ("2026-01-02T01:00:00", "b"), ("2026-01-09T00:00:00", "a")]
    (src / "1.json").write_text("\n".join(json.dumps({"at": t, "type": k}) for t, k in rows))
    stream = spark.readStream.schema("at timestamp, type string").json(str(src))
    q = ingest.windowed_counts(stream, "at").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"].day, r["type"], r["n"]) for r in spark.sql("select * from windows").collect()} == {(1, "a", 2), (2, "b", 1), (9, "a", 1)}
