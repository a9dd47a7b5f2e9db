"""Drifting schemas and nested records."""

import json
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.operators import drift, nested

ROWS = "row_id bigint, file_id string, domain_id string, file_kind string, written_at timestamp, record string, field string, tag string"


def files(spark, *records):
    out = []
    for f, rs in enumerate(records):
        out += [(100 * f + i, f"f{f}", "d", "k", datetime(2025, 1, 1 + f), r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False), "x", "y") for i, r in enumerate(rs)]
    return spark.createDataFrame(out, ROWS)


def changes(spark, *records):
    got = drift.changes(files(spark, *records), ["domain_id", "file_kind"], "file_kind", "file_id", "written_at").collect()
    return sorted((r["file_id"], r["change_kind"], r["old_field"], r["new_field"]) for r in got)


def test_changes(spark):
    a = [{"级别": "合集级", "n": 1, "note": None}, {"级别": "单篇级", "n": 2}, {"级别": "合集级", "n": 3}]
    b = [{"﻿粒度 ": "合集级", "n": "1", "更新": "每周"}, {"粒度": "单篇级", "n": "x"}, {"粒度": "合集级", "n": 3}]
    assert changes(spark, a, b) == [("f1", "added", "", "更新"), ("f1", "removed", "note", ""), ("f1", "renamed", "级别", "粒度"), ("f1", "retyped", "n", "n")]
    assert changes(spark, a) == [] and changes(spark, a, a) == []


def test_same_type_other_content_is_no_rename(spark):
    a = [{"keep": 1, "grade": "合集级"}] * 4
    b = [{"keep": 1, "lang": "zh"}, {"keep": 1, "lang": "en"}] * 2
    assert changes(spark, a, b) == [("f1", "added", "", "lang"), ("f1", "removed", "grade", "")]


def test_neighbours_are_no_rename(spark):
    both = [{"ok": True, "checked": False}] * 3
    assert ("f2", "renamed", "ok", "checked") not in changes(spark, both, [{"ok": True}] * 3, [{"checked": True}] * 3)


def test_untidy_rows(spark):
    assert changes(spark, [None, "not json", "[1]", {}], [{"a": 1}, None], ["", {"a": 1.5}, {"a": 2.0}]) == [("f1", "added", "", "a"), ("f2", "retyped", "a", "a")]
    assert drift.changes(files(spark), ["domain_id", "file_kind"], "file_kind", "file_id", "written_at").count() == 0
    assert changes(spark, [{"a": "x" * 300_000}], [{"b": "x" * 300_000}]) == [("f1", "renamed", "a", "b")]


def test_unified(spark):
    rows = files(spark, [{"ok": True, "src": "q"}, {"ok": False, "src": ["p", "z"]}], [{"ok ": "是", "src": {"查询词": "w", "序号": 2}}, {"ok": 0}])
    fields = drift.file_fields(rows, ["file_id"])
    names = {"ok": ["ok"], "src": ["src"]}
    got = drift.unified(rows, ["row_id"], names, {"ok": "boolean", "src": "string"}).orderBy("row_id").collect()
    assert [r["ok"]["canonical"] for r in got] == ["true", "false", "true", "false"] and [r["ok"]["tag"] for r in got] == ["boolean", "boolean", "string", "integer"]
    assert [r["src"] and r["src"]["canonical"] for r in got] == ["q", "p", "w", None]
    assert drift.main_types(fields, names) == {"ok": "boolean", "src": "string"} or drift.main_types(fields, names)["ok"] in drift.TAGS
    alt = drift.alternatives(rows, ["file_kind"], "file_id", "written_at").collect()
    assert {(r["field"], r["tag"], r["first_file"]) for r in alt} >= {("ok", "boolean", "f0"), ("ok", "string", "f1"), ("src", "object", "f1")}


def found(spark, *rows):
    df = spark.createDataFrame([(i, a, b, "extra") for i, (a, b) in enumerate(rows)], "evidence_id bigint, tool_input string, tool_response string, value string")
    return sorted((r["evidence_id"], r["node_path"], r["parent_path"]) for r in nested.nodes(df, "evidence_id", ["tool_input", "tool_response"]).collect())


def test_nodes(spark):
    inner = json.dumps(json.dumps([{"t": 1}]))
    got = found(
        spark,
        ('{"f":[{"a":1},5,{"b":[]}]}', '{"results":["x",{"content":[{"s":{"k":1}},null]},[{"z":1}]]}'),
        (None, '{"results":{"content":{"s":[{"k":2}]}}}'),
        ("{", "﻿ " + json.dumps({"results": [json.dumps({"content": inner})]})),
        ('"text"', "[1"),
        ("", "NaN"),
    )
    assert got == [
        (0, "tool_input.f[0]", ""), (0, "tool_input.f[2]", ""), (0, "tool_response.results[1]", ""), (0, "tool_response.results[1].content[0]", "tool_response.results[1]"),
        (0, "tool_response.results[1].content[0].s[0]", "tool_response.results[1].content[0]"), (0, "tool_response.results[2][0]", ""),
        (1, "tool_response.results[0]", ""), (1, "tool_response.results[0].content[0]", "tool_response.results[0]"), (1, "tool_response.results[0].content[0].s[0]", "tool_response.results[0].content[0]"),
        (2, "tool_response.results[0]", ""), (2, "tool_response.results[0].content[0]", "tool_response.results[0]"),
    ]
    assert found(spark) == []


def test_depth_and_size(spark):
    deep = "[" * 30_000 + '{"a":1}' + "]" * 30_000
    rows = [r for r in nested.walk("c", deep, set()) if r[3] and r[4] is None]
    assert len(rows) == 1 and rows[0][1] == "c" + "[0]" * 30_000
    assert len(found(spark, (None, json.dumps({"r": [{"t": "x" * 1_000_000}] * 3})))) == 3


def test_tables(spark):
    df = spark.createDataFrame([(7, None, '{"results":[{"title":"a","tags":["p","q"]},{"title":"\\ud800"},{}]}')], "evidence_id bigint, tool_input string, tool_response string")
    t = nested.shred(df, "evidence_id", ["tool_response"])
    rows = nested.flat_table(t, "evidence_id", "tool_response.results", ["title", "tags[]"]).orderBy("node_path").collect()
    assert [(r["node_path"], r["title"], r["tags"]) for r in rows] == [("tool_response.results[0]", "a", ["p", "q"]), ("tool_response.results[1]", "?", []), ("tool_response.results[2]", None, [])]


def test_tables_have_the_columns_found(spark):
    df = spark.createDataFrame([(7, '{"query":"q","node_path":"n","list":["x",{"t":1},2],"Query":true}', None), (8, "[]", "7"), (9, None, None)], "evidence_id bigint, a string, b string")
    tables = nested.flat_tables(nested.shred(df, "evidence_id", ["a", "b"]), "evidence_id")
    assert set(tables) == {"a", "a.list"}
    root = {r["evidence_id"]: r.asDict() for r in tables["a"].collect()}
    assert root[7] == {"evidence_id": 7, "node_path": "", "parent_path": "", "Query": "true", "list": ["x", "2"], "node_path_2": "n", "query_3": "q"}
    assert root[8]["list"] == [] and [r["t"] for r in tables["a.list"].collect()] == ["1"]
    assert nested.flat_tables(nested.shred(df.limit(0), "evidence_id", ["a"]), "evidence_id") == {}


def test_records_are_read_as_a_stream(monkeypatch):
    """Triples come from tokens: neither the record nor a part of it is built as an object or array."""

    def scalar(text, at, scan=nested._DECODER.scan_once):
        value, at = scan(text, at)
        assert not isinstance(value, (dict, list))
        return value, at

    def refuse(*_):
        raise AssertionError("the whole text is parsed")

    for name in ("parse", "decoded", "_loads_deep"):
        monkeypatch.setattr(nested, name, refuse)
    monkeypatch.setattr(nested, "_SCALAR", scalar, raising=False)
    text = json.dumps({"a": [{"b": 1}, json.dumps({"c": [2, "x"]}), "{no"], "d": {"e": None}})
    want = [
        ("c", "", "", False, None, None, 0), ("c\x1fa", "c.a[0]", "", True, None, None, 0), ("c\x1fa", "c.a[0]", "", True, "b", 1, 0), ("c\x1fa", "c.a[1]", "", True, None, None, 0),
        ("c\x1fa", "c.a[1]", "", True, "c[]", 2, 0), ("c\x1fa", "c.a[1]", "", True, "c[]", "x", 1), ("c", "", "", False, "a[]", "{no", 2), ("c", "", "", False, "d.e", None, 0),
    ]
    assert list(nested.walk("c", text, set())) == want
    assert list(nested.walk("c", text[:-1], set())) == [] and list(nested.walk("c", text + "]", set())) == []


def test_odd_keys():
    rows = lambda text, arrays=(): [r[1:] for r in nested.walk("c", text, set(arrays))][1:]
    # of repeated keys the last counts, with all that it holds, at the place of the first
    assert rows('{"a":[{"x":1}],"b":2,"a":"t"}') == [("", "", False, "b", 2, 1), ("", "", False, "a", "t", 0)]
    assert rows('["[1,{\\"a\\":1,\\"a\\":2}",3]') == [("", "", False, "[]", '[1,{"a":1,"a":2}', 0), ("", "", False, "[]", 3, 1)]
    # a key that ends like a position makes no listed object
    assert rows('{"k]":{"x":1}}') == [("", "", False, "k].x", 1, 0)]
    assert rows('{"k]":{"x":1}}', ["c\x1fk]"]) == [("c.k][0]", "", True, None, None, 0), ("c.k][0]", "", True, "x", 1, 0)]


def test_report_counts_nodes(spark):
    df = spark.createDataFrame([(7, '{"q":1,"list":["x",{"t":1,"tags":[1,2,3]},{"t":null},2]}'), (8, '{"list":[{}]}'), (9, "{")], "evidence_id bigint, a string")
    triples = nested.shred(df, "evidence_id", ["a"])
    got = {(r["table_name"], r["field"]): r["n"] for r in nested.table_report(triples).collect()}
    assert got == {("a", ""): 2, ("a", "q"): 1, ("a", "list[]"): 1, ("a.list", ""): 3, ("a.list", "t"): 2, ("a.list", "tags[]"): 1}
    rows = {t: [r.asDict() for r in flat.collect()] for t, flat in nested.flat_tables(triples, "evidence_id").items()}
    assert got == {(t, ""): len(rs) for t, rs in rows.items()} | {(t, f): sum(r[f.removesuffix("[]")] not in (None, []) for r in rows[t]) for t, f in got if f}


def test_alternatives_at_any_depth(spark):
    rows = files(spark, [{"a": {"b": [1, "x", {"c": None}]}, " k﻿": 1.5}], [{"a": "t"}])
    got = {(r["field"], r["tag"], r["first_file"], r["n_values"]) for r in drift.alternatives(rows, ["file_kind"], "file_id", "written_at").collect()}
    assert got == {("a", "object", "f0", 1), ("a", "string", "f1", 1), ("a.b", "array", "f0", 1), ("a.b[]", "integer", "f0", 1), ("a.b[]", "string", "f0", 1), ("a.b[]", "object", "f0", 1), ("a.b[].c", "null", "f0", 1), ("k", "number", "f0", 1)}


def test_unified_keeps_every_value(spark):
    rows = files(spark, [{"n": 9007199254740993, "级别": "a", "粒度": "b"}, {"n": "1e300"}, {"n": 123456789012345678901234}, {"n": 1e300}, {"n": "12.5"}])
    got = drift.unified(rows, ["row_id"], {"n": ["n"], "级别": ["级别", "粒度"]}, {"n": "integer", "级别": "string"}).orderBy("row_id").collect()
    assert [r["n"]["canonical"] for r in got][:3] == ["9007199254740993", "1e300", "123456789012345678901234"] and got[4]["n"]["canonical"] == "12.5"
    assert int(got[2]["n"]["as_integer"]) == 123456789012345678901234 and got[3]["n"]["as_number"] == 1e300
    assert (got[0]["级别"]["canonical"], got[0]["级别"]["others"]) == ("a", ['"b"'])


def test_names_that_meet_are_not_united(spark):
    rows = files(spark, [{"a": 1, "c": 2}], [{"b": 1}])
    found = spark.createDataFrame([("f1", "renamed", "a", "b")] * 3 + [("f2", "renamed", "b", "c")], "file_id string, change_kind string, old_field string, new_field string")
    assert sorted(map(sorted, drift.field_names(found, drift.file_fields(rows, ["file_id"])).values())) == [["a", "b"], ["c"]]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text("ab{[\"\\ é", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_deep_reader_agrees(value):
    text = json.dumps(value)
    assert nested._loads_deep(text) == json.loads(text)
    for cut in (text[:-1], text + "x"):
        try:
            want = json.loads(cut)
        except ValueError:
            want = ValueError
        try:
            got = nested._loads_deep(cut)
        except ValueError:
            got = ValueError
        assert got == want or want != want
