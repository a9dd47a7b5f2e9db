"""A whole run from files: ingest, finalisation of a raw document, and folding of a run's logs.

Both ways build the same DataFrames and share one delivery, so equal inputs give
equal deliverables.  Gates raise before anything is delivered, after an event in
the run's reject log; a delivery is written aside and renamed at the end, and only
then are the working files moved into it: a failed run leaves its inputs and can
be repeated.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab
from auditloom.operators import catalog, evidence, gates
from auditloom.session import checkpointed
from auditloom.sources import logs, sinks

RUN = "run"
#: Names that a message tells; it says how many more there are.
TOLD = 100
#: Queries that an attestation shows.
SAMPLES = 5
_SOURCE = ["name", "category_path", "source_type", "granularity", "url", "description", "reason"]
_KNOWLEDGE = ["name", "node", "category_path", "source_type", "granularity", "url", "description", "reason", "note"]
_SEARCH = ["phase", "node", "query", "zero_reason"]


class GateError(ValueError):
    """A run may not be finalised; the message names what is missing."""


def _document(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))


def _objects(doc: DataFrame, field: str) -> DataFrame:
    return doc.select(F.posexplode(F.try_variant_get("d", f"$.{field}", "array<variant>")).alias("pos", "v")).withColumn("_o", F.schema_of_variant("v").startswith("OBJECT"))


def _rows(doc: DataFrame, field: str, texts: list[str], others: dict[str, str] = {}) -> DataFrame:
    """The objects of a list field; anything else in it, or a field of another type, gives no row."""
    x = _objects(doc, field).where("_o")
    get = lambda c, t: F.try_variant_get("v", f"$.{c}", t).alias(c)
    return x.select(F.col("pos").cast("bigint").alias("store_id"), F.lit(RUN).alias("run_id"), *[get(c, "string") for c in texts], *[get(c, t) for c, t in others.items()])


def _nodes(doc: DataFrame) -> DataFrame:
    nodes = doc.select(F.posexplode(F.try_variant_get("d", "$.nodes", "array<string>")).alias("pos", "node")).groupBy("node").agg(F.min("pos").alias("pos")).select(F.lit(RUN).alias("run_id"), "node", "pos")
    if nodes.isEmpty():
        raise ValueError("nodes are required")
    return nodes


def _evidence(spark: SparkSession, path: str | None) -> DataFrame | None:
    if not path or not Path(path).exists():
        return None
    lines = logs.read_evidence_lines(spark, path)
    get = lambda p, t="string": F.try_variant_get("doc", p, t)
    return lines.where("doc is not null").select(F.col("line_no").cast("bigint").alias("evidence_id"), F.lit(RUN).alias("run_id"), F.coalesce(get("$.tool_input.query"), get("$.tool_response.query")).alias("query"), get("$.tool_response", "variant").alias("response"))


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _typed(rows: DataFrame) -> DataFrame:
    kind = vocab.canonical_type(F.col("source_type"), vocab.SOURCE_TYPES, vocab.SOURCE_TYPE_ALIASES)
    return rows.withColumns({"source_type_raw": F.col("source_type"), "source_type": kind, "granularity": vocab.canonical_granularity(F.col("granularity")), "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd-HHmmss")})


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    if logs.first_file(spark, path) is None:
        return None
    return spark.read.schema(logs.STORE_SCHEMA + ", run_id string").json(path).where(F.col("type") == kind)


def record_sources(batch: DataFrame, nodes: DataFrame, ev: DataFrame, store_path: str, rejects_path: str) -> dict[str, int]:
    """Ingest entries (``store_id, run_id`` and the fields of a source): good rows land although others are rejected.

    Entries whose address an earlier entry of the batch or the store has are skipped.
    """
    judged = catalog.ingest_outcomes(batch, nodes, evidence.grounded(batch, ev, "store_id"), "store_id")
    held = _stored(batch.sparkSession, store_path, "source")
    if held is not None:
        mark = held.where("url is not null").select("run_id", "url").distinct().withColumn("_held", F.lit(True))
        judged = judged.join(batch.select("store_id", "url"), "store_id").join(mark, ["run_id", "url"], "left")
        judged = judged.withColumn("outcome", F.when((F.col("outcome") == "accepted") & F.col("_held"), "skipped").otherwise(F.col("outcome")))
    judged = checkpointed(batch.join(judged.select("store_id", "outcome"), "store_id"))
    accepted = sinks.append_rows(_typed(judged.where("outcome = 'accepted'").drop("outcome")).withColumn("type", F.lit("source")), store_path)
    rejected = sinks.append_rows(judged.where("outcome not in ('accepted', 'skipped')").select("run_id", F.upper("outcome").alias("code"), F.lit("model").alias("actor"), "name", "url"), rejects_path)
    return {"accepted": accepted, "rejected": rejected, "skipped": judged.where("outcome = 'skipped'").count()}


def record_knowledge(batch: DataFrame, declared: DataFrame | None, ev: DataFrame, store_path: str, rejects_path: str) -> dict[str, int]:
    """Ingest checked items (``store_id, run_id`` and the fields of an item), each judged alone.

    Without ``declared`` (no manifest yet) names are not checked; rejects of names
    suggest the nearest declared one.
    """
    judged = checkpointed(gates.knowledge_outcomes(evidence.grounded(batch, ev, "store_id"), declared).drop("is_grounded"))
    good = judged.where("outcome in ('accepted', 'unverified')").drop("outcome")
    accepted = sinks.append_rows(_typed(good).withColumn("type", F.lit("knowledge")), store_path)
    bad = judged.where("outcome not in ('accepted', 'unverified')").select("store_id", "run_id", "outcome", "name", "node", "url")
    near = None if declared is None else gates.nearest_declared(bad.where("outcome = 'not_declared'"), declared).select("store_id", "suggestion")
    bad = bad.withColumn("suggestion", F.lit(None).cast("string")) if near is None else bad.join(near, "store_id", "left")
    events = bad.select("run_id", F.upper("outcome").alias("code"), F.lit("model").alias("actor"), "name", "node", "url", F.when(F.col("suggestion").isNotNull(), F.create_map(F.lit("suggestion"), "suggestion")).alias("detail"))
    return {"accepted": accepted, "rejected": sinks.append_rows(events, rejects_path)}


def record_search(batch: DataFrame, store_path: str) -> int:
    """Append searches with their time; a missing reason is ''."""
    rows = batch.withColumns({"type": F.lit("search"), "zero_reason": F.coalesce("zero_reason", F.lit("")), "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd-HHmmss")})
    return sinks.append_rows(rows, store_path)


def _counted(rows: DataFrame, key: str) -> dict[str, int]:
    return {r[key] or "": r["n"] for r in rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).toLocalIterator()}


def _quota(journal: DataFrame, ev: DataFrame) -> tuple[dict[str, int], int]:
    """Logged incremental searches of each node, and how many of all have no evidence."""
    asked = ev.where("query is not null").select("run_id", "query").distinct().withColumn("_in", F.lit(True))
    own = journal.where(vocab.phase_group(F.col("phase")) == "增量").join(asked, ["run_id", "query"], "left")
    rows = own.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("_in").isNull()).alias("u")).orderBy("node").collect()
    return {r["node"]: r["n"] for r in rows}, sum(r["u"] for r in rows)


def _gap(journal: DataFrame, ev: DataFrame, applicable: bool) -> dict:
    """Evidence queries that the journal lacks; evidence that many runs share says nothing about that."""
    if not applicable:
        return {"applicable": False, "evidence_queries": None, "journal_queries": None, "unlogged": None, "unlogged_samples": None}
    asked = ev.where("query is not null").select("query").distinct()
    told = journal.where("query is not null").select("query").distinct()
    left = checkpointed(asked.join(told, "query", "left_anti"))
    return {"applicable": True, "evidence_queries": asked.count(), "journal_queries": told.count(), "unlogged": left.count(), "unlogged_samples": [r["query"] for r in left.orderBy("query").limit(SAMPLES).collect()]}


def _fingerprint() -> str:
    """Twelve characters that tell which code delivered."""
    return hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:12]


def _deliver(spark: SparkSession, doc: DataFrame, nodes: DataFrame, sources: DataFrame, knowledge: DataFrame, journal: DataFrame, ev: DataFrame | None, rejects: DataFrame | None, run_scoped: bool, out_dir: str, now: str) -> dict:
    head = doc.select(F.try_variant_get("d", "$.domain", "string").alias("domain"), F.try_variant_get("d", "$.model", "string").alias("model")).first()
    domain = head["domain"] or ""
    raw = F.coalesce("source_type_raw", "source_type") if "source_type_raw" in sources.columns else F.col("source_type")
    path = F.coalesce(F.nullif("category_path", F.lit("")), "node").alias("category_path")
    merged = knowledge.where("verified").select((F.lit(1 << 40) + F.col("store_id")).alias("store_id"), "run_id", "name", path, "source_type", "granularity", "url", "description", "reason", F.col("source_type").alias("raw"))
    rows = sources.select("store_id", "run_id", *_SOURCE, raw.alias("raw")).unionByName(merged)
    rows = checkpointed(_typed(rows).drop("source_type_raw", "ts"))
    whole = rows.where(_filled("name") & _filled("url"))
    summary = {"total_found": whole.count(), "invalid": rows.count() - whole.count(), "journal_count": journal.count()}
    if ev is None:
        if summary["total_found"] or summary["journal_count"]:
            raise FileNotFoundError("evidence is required where there are candidates or a journal")
        ev = spark.createDataFrame([], "evidence_id bigint, run_id string, query string, response variant")
    if summary["journal_count"] and not summary["total_found"]:
        raise GateError("a journal but no candidates")
    clean = whole.where(~vocab.is_garbage(urls.host(F.col("url")), vocab.REFUSED_HOSTS))  # before grounding: it decides the counter
    grounded = checkpointed(evidence.grounded(clean, ev, "store_id"))
    kept = catalog.keep_first(grounded.where("is_grounded"), "store_id", ["run_id"])
    located = checkpointed(catalog.leaf_nodes(kept.drop("is_grounded"), nodes.select("run_id", "node"), "store_id"))
    summary |= {
        "garbage_filtered": summary["total_found"] - clean.count(), "ungrounded": grounded.where("not is_grounded").count(), "kept": located.count(), "unmatched": located.where("leaf is null").count(),
        "unmapped_types": _counted(rows.where(F.col("source_type") == vocab.OTHER), "raw"),
    }
    summary["removed_duplicates"] = grounded.where("is_grounded").count() - summary["kept"]
    stats = checkpointed(catalog.stats_by_node(located, nodes.select("run_id", "node")).join(nodes.select("node", "pos"), "node", "left"))
    summary["empty_nodes"] = [r["node"] for r in stats.where("n = 0 and node <> '总计'").orderBy("pos").select("node").collect()]
    first = evidence.first_queries(located, ev, "store_id")
    entries = located.join(first, "store_id").orderBy("store_id").select("name", "category_path", "source_type", "granularity", "url", "description", F.coalesce("first_query", F.lit("")))
    # a run without a grounded entry still has its total row
    stat_rows = stats.orderBy(F.col("pos").asc_nulls_last()).select("node", "n", "types")
    if not summary["kept"]:
        stat_rows = stat_rows.unionByName(spark.createDataFrame([("总计", 0, "")], "node string, n bigint, types string"))
    asked = ev.where("query is not null").select("run_id", "query").distinct().withColumn("_in", F.lit(True))
    told = journal.join(asked, ["run_id", "query"], "left").orderBy("store_id").select("phase", "node", "query", "results", "extracted", vocab.yes_no(F.col("_in").isNull()), F.coalesce("zero_reason", F.lit("")))
    lines = catalog.lineage(evidence.result_urls(ev), journal, located).withColumn("note", F.lit(""))
    loose = catalog.text_lineage(located, ev, journal).join(located.select("store_id", "name", "reason"), "store_id")
    loose = loose.select(F.lit(1 << 62).alias("evidence_id"), F.col("store_id").alias("pos"), F.lit(0).alias("sub"), "run_id", "phase", "node", "query", F.lit(None).cast("int").alias("results"), "url", F.lit("是").alias("collected"), "name", "reason", "note")
    lines = lines.withColumn("pos", F.col("pos").cast("bigint")).unionByName(loose).orderBy("evidence_id", "pos", "sub").select("phase", "node", "query", "results", "url", "collected", "name", "reason", "note")
    known = knowledge.agg(F.count("*").alias("n"), F.count_if("verified").alias("v"), F.count_if(F.col("verified") & _filled("name") & _filled("url")).alias("w")).first()
    summary["list_verified"] = f"{known['w']}/{known['n']}"
    zero = journal.where(vocab.phase_group(F.col("phase")).isin("增量", "扩量") & (F.coalesce("extracted", F.lit(0)) == 0)).orderBy("store_id").select("phase", "node", "query", F.coalesce("zero_reason", F.lit("")).alias("zero_reason"))
    zero_rows = [r.asDict() for r in zero.toLocalIterator()]
    per_node, unevidenced = _quota(journal, ev)
    declared = _declared(doc)
    missing = [r["name"] for r in gates.pending(declared, knowledge).select("name").distinct().orderBy("name").toLocalIterator()]
    events = {"total": 0, "by_code": {}, "by_actor": {}}
    if rejects is not None:
        events = {"total": rejects.count(), "by_code": _counted(rejects, "code"), "by_actor": _counted(rejects, "actor")}
    summary |= {"reject_events": events, "sources_broken": _broken(doc), "journal_skipped": _objects(doc, "journal").where("not coalesce(_o, false)").count()}

    out = sinks.run_directory(out_dir, domain, now)
    with sinks.delivery(out) as part:
        inner = part / "intermediate"
        sinks.write_csv(entries, str(part / f"{out.name}_数据源清单.csv"), sinks.CATALOG_HEADER)
        sinks.write_csv(stat_rows, str(inner / f"{out.name}_stats.csv"), sinks.STATS_HEADER)
        sinks.write_csv(told, str(inner / f"{out.name}_搜索日志.csv"), sinks.JOURNAL_HEADER, skip_empty=True)
        summary["lineage_rows"] = sinks.write_csv(lines, str(inner / f"{out.name}_溯源.csv"), sinks.LINEAGE_HEADER, skip_empty=True)
        counters = {k: v for k, v in summary.items() if k not in ("journal_count", "lineage_rows", "list_verified")}
        attestation = {
            "generated_at": now, "domain": domain, "model": head["model"], "script_fingerprint": _fingerprint(), "sources": counters, "journal_count": summary["journal_count"], "lineage_rows": summary["lineage_rows"],
            "quota": {"required_per_node": vocab.MIN_INCREMENTAL, "per_node": per_node, "unevidenced": unevidenced}, "zero_extraction": {"count": len(zero_rows), "rows": zero_rows},
            "knowledge": {"declared": declared.select("name").distinct().count(), "recorded": known["n"], "verified": known["v"], "unverified": known["n"] - known["v"], "missing": missing, "list_verified": summary["list_verified"]},
            "reverse_gap": _gap(journal, ev, run_scoped),
        }
        sinks.write_attestation(attestation, str(part / f"{out.name}_运行验收单.json"))
    return summary | {"out_dir": str(out)}


def _declared(doc: DataFrame) -> DataFrame:
    each = [_rows(doc, c, ["name", "node"]).withColumn("list", F.lit(c)) for c in ("vendors", "knowledge")]
    return each[0].unionByName(each[1]).where("name is not null")


def _broken(doc: DataFrame) -> bool:
    """Whether sources are there but are no list."""
    kind = F.schema_of_variant(F.try_variant_get("d", "$.sources", "variant"))
    return doc.where(kind.isNotNull() & (kind != "VOID") & ~kind.startswith("ARRAY")).count() > 0


def run_pipeline(spark: SparkSession, raw_path: str, out_dir: str, now: str, evidence_path: str | None = None) -> dict:
    """Deliver a raw document (domain, nodes, sources, knowledge, journal); returns the counters."""
    doc = checkpointed(_document(spark, raw_path))
    nodes = _nodes(doc)
    sources = _rows(doc, "sources", _SOURCE)
    knowledge = _rows(doc, "knowledge", _KNOWLEDGE, {"verified": "boolean"})
    journal = _rows(doc, "journal", _SEARCH, {"results": "int", "extracted": "int"})
    return _deliver(spark, doc, nodes, sources, knowledge, journal, _evidence(spark, evidence_path), None, False, out_dir, now)


def _told(names: list[str], n: int) -> str:
    return ", ".join(names) + (f" 等共 {n} 项" if n > len(names) else "")


def _enforce(run_dir: Path, now: str, declared: DataFrame, knowledge: DataFrame, sources: DataFrame, journal: DataFrame, nodes: DataFrame, ev: DataFrame | None) -> None:
    """The gates of a fold; the first that is violated is logged and raised."""

    def stop(code: str, message: str, **detail: object) -> None:
        sinks.append_event(run_dir / "rejects.jsonl", code, "model", now, detail)
        raise GateError(message)

    def some(rows: DataFrame, key: str) -> tuple[list[str], int]:
        rows = checkpointed(rows)
        return [r[key] or "" for r in rows.orderBy(key).limit(TOLD).collect()], rows.count()

    names, n = some(gates.pending(declared, knowledge).select("name").distinct(), "name")
    if n:
        stop("CHECKLIST_UNRECORDED", "清单项未核对: " + _told(names, n), count=n)
    if not gates.sources_missing(journal, sources).isEmpty():
        stop("SOURCES_MISSING", "来源未入库")
    if ev is not None:
        short = checkpointed(gates.quota(journal, nodes.select("run_id", "node"), ev))
        lacking, n = some(short.select(F.concat("node", F.lit(" "), "n_evidenced", F.lit(" 次（缺 "), F.lit(vocab.MIN_INCREMENTAL) - F.col("n_evidenced"), F.lit("）")).alias("t")), "t")
        if n:
            unevidenced = _quota(journal, ev)[1]
            stop("QUOTA_SHORT", _told(lacking, n) + (f"；无留痕的日志行 {unevidenced} 条" if unevidenced else ""), count=n)
        items = evidence.result_urls(ev)
        queries, n = some(gates.garbage_claims(journal, items).join(journal, "store_id").select("query"), "query")
        if n:
            stop("GARBAGE_CLAIM", "理由声称垃圾域: " + _told(queries, n), count=n)
    queries, n = some(gates.zero_without_reason(journal).select("query"), "query")
    if n:
        stop("ZERO_WITHOUT_REASON", "零提取留痕缺失: " + _told(queries, n), count=n)


def _working(run_dir: str, *names: str) -> str:
    """The path of a working file, by the first of its names that is there."""
    return next((p for n in names if Path(p := f"{run_dir}/{n}").exists()), f"{run_dir}/{names[0]}")


def fold(spark: SparkSession, run_dir: str, out_dir: str, now: str, evidence_path: str | None = None, enforce: bool = True) -> dict:
    """Finalise a run's manifest and store; with ``enforce`` the gates raise first.

    Evidence is the run's own file unless a path of shared evidence is given; the
    first is moved into the delivery whole, of the other the lines whose query the
    journal has are copied.
    """
    manifest, store = _working(run_dir, "manifest.json", "manifest_input.json"), _working(run_dir, "store.jsonl", "store_input.jsonl")
    doc = checkpointed(_document(spark, manifest))
    nodes = _nodes(doc)
    if Path(store).exists():
        lines = logs.read_store_lines(spark, store).where("bad_line is null").withColumns({"store_id": F.col("seq").cast("bigint"), "run_id": F.lit(RUN)})
    else:
        lines = spark.createDataFrame([], logs.STORE_SCHEMA + ", store_id bigint, run_id string")
    lines = checkpointed(lines)
    sources = lines.where("type = 'source'")
    knowledge = catalog.latest(lines.where("type = 'knowledge' and name is not null"), ["run_id", "name"], "store_id")
    if knowledge.isEmpty():  # older runs keep their items in the manifest alone
        knowledge = _rows(doc, "knowledge", _KNOWLEDGE, {"verified": "boolean"})
        declared = _declared(doc).where("list = 'vendors'") if not knowledge.where("verified is not null").isEmpty() else _declared(doc)
        knowledge = knowledge.where("verified is not null")
    else:
        declared = _declared(doc)
    journal = checkpointed(catalog.latest(lines.where("type = 'search'"), ["run_id", "phase", "node", "query"], "store_id"))
    own = evidence_path is None
    held = evidence_path or f"{run_dir}/evidence.jsonl"
    ev = _evidence(spark, held)
    if enforce:
        _enforce(Path(run_dir), now, declared, knowledge, sources, journal, nodes, ev)
    events = f"{run_dir}/rejects.jsonl"
    summary = _deliver(spark, doc, nodes, sources, knowledge, journal, ev, logs.read_rejects(spark, events) if Path(events).exists() else None, own, out_dir, now)
    out = Path(summary["out_dir"])
    if own:
        sinks.archive(out, [held])
    elif ev is not None:
        summary |= slice_evidence(spark, held, journal, str(out / "intermediate" / "evidence.jsonl"))
    sinks.archive(out, {manifest: "manifest_input.json", store: "store_input.jsonl", events: "rejects.jsonl"})
    return summary


def slice_evidence(spark: SparkSession, path: str, journal: DataFrame, to: str) -> dict[str, int]:
    """Copy the lines of shared evidence whose query the journal has; returns how many, and how many could not be read."""
    lines = checkpointed(logs.read_evidence_lines(spark, path))
    query = F.coalesce(F.try_variant_get("doc", "$.tool_input.query", "string"), F.try_variant_get("doc", "$.tool_response.query", "string"))
    own = lines.withColumn("query", query).join(journal.select("query").where("query is not null").distinct(), "query", "left_semi").orderBy("line_no")
    n = 0
    with open(to, "w", encoding="utf-8") as f:
        for r in own.select("line").toLocalIterator():
            f.write(r["line"] + "\n")
            n += 1
    return {"evidence_slice_kept": n, "evidence_slice_skipped": lines.where("doc is null").count()}


def finish_report(out_dir: str) -> str | None:
    """Rename the report of a delivery after it and put its statistics in; a delivery without statistics gets a placeholder."""
    import csv

    out = Path(out_dir)
    found = sorted((out / "intermediate").glob("*_stats.csv"))
    stats = None
    if found:
        with open(found[0], encoding="utf-8-sig", newline="") as f:
            stats = [(r[0], int(r[1]), r[2]) for r in list(csv.reader(f))[1:]]
    done = sinks.rename_report(out, stats)
    return str(done) if done else None


def read_attestation(out_dir: str) -> dict:
    return json.loads(next(Path(out_dir).glob("*_运行验收单.json")).read_text(encoding="utf-8"))
