"""Operators of the catalog: attribution, deduplication, ingest outcomes, statistics, lineage."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab
from auditloom.operators import evidence
from auditloom.session import checkpointed


def leaf_nodes(rows: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``leaf``, the longest declared node that the path is or ends with after ``-``.

    The ends of a path are exploded and joined by equality; no theta join.
    """
    parts = F.split("category_path", "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    tails = rows.where("category_path is not null").select(id_col, "run_id", F.explode(ends).alias("node"))
    found = tails.join(nodes.select("run_id", "node"), ["run_id", "node"]).groupBy(id_col).agg(F.max(F.struct(F.length("node").alias("n"), "node")).getField("node").alias("leaf"))
    return rows.join(found, id_col, "left")


def keep_first(rows: DataFrame, seq_col: str, group_cols: list[str], max_rounds: int | None = None) -> DataFrame:
    """Greedy keep-first over two keys: a row goes if an earlier kept row has its page or its (host, name).

    The rows that are first under both their keys among the undecided are kept and
    drop the rows that share a key with them; then the next round.  This gives what
    one pass in order gives, without a task that sees a whole host.  Rows without
    address or name are left out.  Each round decides a row at least, so the rounds
    end; a run that needs more than ``max_rounds`` of them is refused.
    """
    url, name = [*group_cols, "_u"], [*group_cols, "_h", "name"]
    todo = rows.where("url is not null and url <> '' and name is not null and name <> ''")
    todo = checkpointed(todo.select(seq_col, *group_cols, "name", urls.canonical(F.col("url")).alias("_u"), urls.host(F.col("url")).alias("_h")))
    kept = None
    for n in itertools.count(1):
        by_url = todo.groupBy(*url).agg(F.min(seq_col).alias("_fu"))
        by_name = todo.groupBy(*name).agg(F.min(seq_col).alias("_fn"))
        seen = checkpointed(todo.join(by_url, url).join(by_name, name).withColumn("_keep", (F.col(seq_col) == F.col("_fu")) & (F.col(seq_col) == F.col("_fn"))).drop("_fu", "_fn"))
        new = seen.where("_keep").drop("_keep")
        kept = new.select(seq_col) if kept is None else kept.unionByName(new.select(seq_col))
        rest = seen.where("not _keep").drop("_keep").join(new.select(*url), url, "left_anti").join(new.select(*name), name, "left_anti")
        todo = checkpointed(rest)
        if todo.isEmpty():
            break
        if n == max_rounds:
            raise ValueError("rows are still undecided after max_rounds rounds")
    return rows.join(kept, seq_col, "left_semi")


def latest(rows: DataFrame, key_cols: list[str], seq_col: str) -> DataFrame:
    """The last row of each key; a maximum, so that a key's rows are combined where they lie."""
    cols = [c for c in rows.columns if c not in key_cols]
    last = F.max_by(F.struct(*cols), F.col(seq_col)).alias("_l")
    return rows.groupBy(*key_cols).agg(last).select(*[c if c in key_cols else F.col(f"_l.`{c}`").alias(c) for c in rows.columns])


def ingest_outcomes(batch: DataFrame, nodes: DataFrame, grounded: DataFrame, id_col: str) -> DataFrame:
    """``id_col, run_id, outcome`` of every entry, each judged alone.

    Order of the checks: name and address, host, node, evidence, repeated address.
    """
    placed = leaf_nodes(batch, nodes, id_col).join(grounded.select(id_col, "is_grounded"), id_col)
    first = batch.where("url is not null").groupBy("run_id", "url").agg(F.min(id_col).alias("_first"))
    placed = placed.join(first, ["run_id", "url"], "left")
    blank = (F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce(F.trim("url"), F.lit("")) == "")
    outcome = (
        F.when(blank, "incomplete")
        .when(vocab.is_garbage(urls.host(F.col("url")), vocab.REFUSED_HOSTS), "garbage")
        .when(F.col("leaf").isNull(), "unknown_node")
        .when(~F.col("is_grounded"), "ungrounded")
        .when(F.col(id_col) != F.col("_first"), "skipped")
        .otherwise("accepted")
    )
    return placed.select(id_col, "run_id", outcome.alias("outcome"))


def type_text(counts: DataFrame, key_cols: list[str], type_col: str, n_col: str) -> DataFrame:
    """``key_cols, n, types``: types rendered ``t:n; t:n``, the most frequent first, then by code point."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col(n_col)).alias("n"), F.col(type_col).alias("t"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["t"], F.lit(":"), (-p["n"]).cast("string"))), "; ")
    return counts.groupBy(*key_cols).agg(F.sum(n_col).alias("n"), text.alias("types"))


def stats_by_node(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``run_id, node, n, types`` of every declared node, empty ones too, and a total for each run.

    Nodes and totals are grouping sets of one aggregate, so the rows are read once.
    """
    own = rows.where("leaf is not null").select("run_id", F.col("leaf").alias("node"), "source_type")
    sets = own.groupingSets([["run_id", "node", "source_type"], ["run_id", "source_type"]], "run_id", "node", "source_type")
    counts = sets.agg(F.count("*").alias("n"), F.grouping("node").alias("_total")).withColumn("node", F.when(F.col("_total") == 1, "总计").otherwise(F.col("node")))
    texts = type_text(counts, ["run_id", "node", "_total"], "source_type", "n")
    each = nodes.select("run_id", "node", F.lit(0).cast("tinyint").alias("_total")).join(texts, ["run_id", "node", "_total"], "full_outer")
    return each.select("run_id", "node", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("types", F.lit("")).alias("types"))


def lineage(items: DataFrame, journal: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each result address of each journal query: phase, node, query, the journal's result count, and the entry it became."""
    last = latest(journal, ["run_id", "query"], "store_id").select("run_id", "query", "phase", "node", "results")
    kept = catalog.where("url is not null").select("run_id", urls.strip_anchors(F.col("url")).alias("url"), "name", "reason", "store_id")
    kept = kept.groupBy("run_id", "url").agg(F.min(F.struct("store_id", "name", "reason")).alias("_e"))
    rows = items.withColumn("url", urls.strip_anchors(F.col("url"))).join(last, ["run_id", "query"]).join(kept, ["run_id", "url"], "left")
    return rows.select(
        "evidence_id", "pos", "sub", "run_id", "phase", "node", "query", "results", "url", vocab.yes_no(F.col("_e").isNotNull()).alias("collected"),
        F.coalesce("_e.name", F.lit("")).alias("name"), F.coalesce("_e.reason", F.lit("")).alias("reason"),
    )


def text_lineage(entries: DataFrame, ev: DataFrame, journal: DataFrame) -> DataFrame:
    """``store_id, run_id, url, query, phase, node, note`` of entries whose address only the text of a result has."""
    found = evidence.text_only(entries, ev, "store_id").join(entries.select("store_id", "run_id"), "store_id")
    last = latest(journal.where("query is not null"), ["run_id", "query"], "store_id").select("run_id", "query", "phase", "node")
    rows = found.join(last, ["run_id", "query"], "left")
    return rows.select("store_id", "run_id", "url", "query", F.coalesce("phase", F.lit("")).alias("phase"), F.coalesce("node", F.lit("")).alias("node"), F.lit("摘要文本提取").alias("note"))
