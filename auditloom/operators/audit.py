"""Post-run audits: funnels, hosts, sites, history, zero extractions and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab


def funnel(journal: DataFrame) -> DataFrame:
    zero = F.count_if(F.coalesce("extracted", F.lit(0)) == 0)
    return journal.groupBy("run_id", "phase").agg(F.count("*").alias("n"), F.coalesce(F.sum("extracted"), F.lit(0)).alias("extracted"), zero.alias("n_zero"), F.floor(zero * 100 / F.count("*")).alias("zero_percent"), F.floor(F.coalesce(F.sum("extracted"), F.lit(0)) * 100 / F.count("*")).alias("extracted_per_100"))


def site_entries(catalog: DataFrame, site_type: str) -> DataFrame:
    inner = F.lower(F.regexp_replace(urls.path(F.coalesce("url", F.lit("'"))), r"^/+|/+$", ""))
    org = F.col("name").rlike("(?i)" + vocab.ORGANISATION) | F.col("name").isin(vocab.ORGANISATION_NAMES)
    return catalog.where(F.col("source_type") == site_type).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(inner.rlike(vocab.ENTRY_PATH)).alias("n_entry"), F.count_if(F.coalesce(org, F.lit(False))).alias("n_org"))


def concentration(catalog: DataFrame) -> DataFrame:
    """Distinct hosts, those seen once, and entries of hosts with five or more."""
    hosts = catalog.where("url is not null").groupBy("run_id", urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    big = F.coalesce(F.sum(F.when(F.col("n") >= 5, F.col("n"))), F.lit(0))
    return hosts.groupBy("run_id").agg(F.count("*").alias("n_hosts"), F.count_if(F.col("n") == 1).alias("n_single"), big.alias("n_big"), F.floor(big * 100 / F.sum("n")).alias("big_percent"))


def history(manifest: DataFrame, catalog: DataFrame, journal: DataFrame, last: int = 8) -> DataFrame:
    """The last runs of each domain with at least two delivered ones."""
    c = catalog.groupBy("run_id").agg(F.count("*").alias("delivered"), F.count_if(F.col("source_type") == vocab.OTHER).alias("other"))
    s = journal.groupBy("run_id").agg(F.count("*").alias("searches"))
    own = Window.partitionBy("domain_id")
    rows = manifest.select("domain_id", "run_id").join(c, "run_id").join(s, "run_id", "left")
    rows = rows.withColumns({"_rn": F.row_number().over(own.orderBy(F.desc("run_id"))), "_k": F.count("*").over(own)}).where((F.col("_rn") <= last) & (F.col("_k") >= 2))
    return rows.select("domain_id", "run_id", "delivered", "other", F.floor(F.col("other") * 100 / F.greatest(F.lit(1), "delivered")).alias("other_percent"), F.coalesce("searches", F.lit(0)).alias("searches"), F.floor(F.col("delivered") * 100 / F.greatest(F.lit(1), "searches")).alias("per_100_searches"))


def zero_classes(journal: DataFrame, lineage: DataFrame, catalog: DataFrame) -> DataFrame:
    """``run_id, node, query, class`` of incremental searches without a find that had results.

    Results are looked up by phase and query, reasons by phase, node and query.
    """
    own = journal.where(F.col("phase") == vocab.INCREMENTAL)
    zero = own.where(F.coalesce("extracted", F.lit(0)) == 0).select("run_id", "phase", "node", "query").distinct()
    reason = own.groupBy("run_id", "node", "query").agg(F.max(F.struct("log_id", F.coalesce("zero_reason", F.lit("")).alias("r"))).getField("r").alias("reason"))
    hosts = zero.join(lineage.select("run_id", "phase", "query", urls.host(F.col("url")).alias("host")).distinct(), ["run_id", "phase", "query"]).select("run_id", "node", "query", "host").distinct()
    listed = catalog.where("url is not null").select("run_id", urls.host(F.col("url")).alias("host")).distinct().withColumn("_in", F.lit(True))
    counts = hosts.join(listed, ["run_id", "host"], "left").groupBy("run_id", "node", "query").agg(F.count("*").alias("n"), F.count_if(vocab.is_garbage(F.col("host"))).alias("g"), F.count("_in").alias("d"))
    kind = (
        F.when(F.col("d") == F.col("n"), "已收").when(F.col("g") == F.col("n"), "结果垃圾").when(F.col("g") > 0, "混合")
        .when(F.coalesce("reason", F.lit("")).rlike(vocab.any_of(vocab.EXPLAINED)), "理由已说明").otherwise("疑似漏收")
    )
    return counts.join(reason, ["run_id", "node", "query"], "left").select("run_id", "node", "query", kind.alias("class"))


def transcript_blocks(lines: DataFrame) -> DataFrame:
    """One row for each content block of the transcripts ``session, line_no, line``; unreadable lines are left out.

    ``session, line_no, pos, role, ts, model, kind, id, tool, text, command, args, chars``
    """
    doc = lines.where(F.contains("line", F.lit("{"))).withColumn("d", F.try_parse_json("line")).where("d is not null")
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    rows = doc.select("session", "line_no", get("d", "$.type").alias("role"), F.substring(get("d", "$.timestamp"), 12, 8).alias("ts"), get("d", "$.message.model").alias("model"), F.posexplode_outer(get("d", "$.message.content", "array<variant>")).alias("pos", "b"))
    parts = F.try_variant_get("b", "$.content", "array<variant>")
    listed = F.aggregate(F.transform(parts, lambda x: F.length(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "session", "line_no", "pos", "role", "ts", "model", get("b", "$.type").alias("kind"), F.coalesce(get("b", "$.id"), get("b", "$.tool_use_id")).alias("id"), get("b", "$.name").alias("tool"),
        F.coalesce(get("b", "$.thinking"), F.lit("")).alias("text"), get("b", "$.input.command").alias("command"), F.length(F.to_json(get("b", "$.input", "variant"))).cast("bigint").alias("args"),
        F.when(parts.isNotNull(), listed).otherwise(F.length(F.coalesce(get("b", "$.content"), F.lit("")))).cast("bigint").alias("chars"),
    )


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """``session, id, tool, chars``: results with the latest call before them; each call answers once."""
    calls = blocks.where("kind = 'tool_use'").select("session", "id", "tool", F.struct("line_no", "pos").alias("_c"))
    results = blocks.where("kind = 'tool_result'").select("session", "id", "chars", F.struct("line_no", "pos").alias("_r"))
    met = calls.join(results, ["session", "id"]).where("_c < _r").groupBy("session", "id", "_r").agg(F.max(F.struct("_c", "tool")).alias("_m"), F.first("chars").alias("chars"))
    return met.groupBy("session", "id", "_m").agg(F.min(F.struct("_r", "chars")).getField("chars").alias("chars")).select("session", "id", "_m.tool", "chars")


def thinking_per_search(blocks: DataFrame) -> DataFrame:
    """Gaps and islands within each session: what was thought since the search before belongs to the next one."""
    is_search = ((F.col("kind") == "tool_use") & (F.col("tool") == "WebSearch")).cast("int")
    w = Window.partitionBy("session").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    # only what counts is sorted, and of it only the lengths
    own = blocks.where("role = 'assistant' and kind in ('thinking', 'tool_use')").select("session", "line_no", "pos", F.length("text").alias("n"), is_search.alias("s"))
    own = own.withColumn("search_no", F.coalesce(F.sum("s").over(w), F.lit(0)) + 1)
    return own.groupBy("session", "search_no").agg(F.sum("n").alias("chars"), F.max("s").alias("_s")).where("_s = 1").select("session", "search_no", "chars")


def anomalies(blocks: DataFrame, most: int = 20) -> DataFrame:
    """The first calls of each session of development tools that a run may not make."""
    bad = (F.col("kind") == "tool_use") & F.col("tool").isin("Bash", "Edit", "Grep", "Glob") & ~F.coalesce("command", F.lit("")).rlike(vocab.LEGAL_COMMAND)
    w = Window.partitionBy("session").orderBy("line_no", "pos")
    return blocks.where(bad).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("session", "line_no", "ts", "tool", "command", "args")


def decisions(blocks: DataFrame, most: int = 200) -> DataFrame:
    """The first sentences of each session's thinking that state a decision."""
    s = blocks.where("kind = 'thinking'").select("session", "line_no", "pos", F.posexplode(F.split("text", r"\n+")).alias("i", "sentence"))
    w = Window.partitionBy("session").orderBy("line_no", "pos", "i")
    return s.where(F.col("sentence").rlike(vocab.DECISION) & (F.length("sentence") > 20)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("session", "line_no", "sentence")


def context_chars(blocks: DataFrame) -> DataFrame:
    """Characters of thinking, of what tools returned and of each tool's arguments, with blocks, mean and longest."""
    bucket = F.when(F.col("kind") == "thinking", "思考").when(F.col("kind") == "tool_result", "工具返回").when(F.col("kind") == "tool_use", F.concat(F.lit("参数:"), F.coalesce("tool", F.lit(""))))
    size = F.when(F.col("kind") == "thinking", F.length("text")).when(F.col("kind") == "tool_use", F.coalesce("args", F.lit(2))).otherwise(F.col("chars"))
    rows = blocks.select("session", bucket.alias("bucket"), size.cast("bigint").alias("n")).where("bucket is not null")
    return rows.groupBy("session", "bucket").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("chars"), F.floor(F.avg("n")).alias("mean_chars"), F.max("n").alias("max_chars"))


def models(blocks: DataFrame) -> DataFrame:
    """Lines of each session by the model that wrote them."""
    return blocks.where("model is not null").select("session", "line_no", "model").distinct().groupBy("session", "model").agg(F.count("*").alias("n"))
