"""Checks of a run: each gives the rows that violate it, empty if none does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab

#: Declared names in one list, and recorded names that meet a list in one part of a run; neither leaves anything out.
LISTED, ASKED = 500, 2_000


def _blank(c: str):
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def knowledge_outcomes(knowledge: DataFrame, declared: DataFrame | None) -> DataFrame:
    """``knowledge`` (with ``is_grounded``) with ``outcome``; unverified items need no address and no evidence.

    Without ``declared`` names are not checked: the list may not be there yet.
    """
    if declared is None:
        declared = knowledge
    names = declared.select("run_id", "name").distinct().withColumn("_d", F.lit(True))
    outcome = (
        F.when(_blank("name") | _blank("node"), "incomplete")
        .when(F.col("_d").isNull(), "not_declared")
        .when(~F.coalesce("verified", F.lit(False)), "unverified")
        .when(_blank("url"), "without_url")
        .when(vocab.is_garbage(urls.host(F.col("url")), vocab.REFUSED_HOSTS), "garbage")
        .when(~F.col("is_grounded"), "ungrounded")
        .otherwise("accepted")
    )
    return knowledge.join(names, ["run_id", "name"], "left").withColumn("outcome", outcome).drop("_d")


def with_knowledge(sources: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Candidates and verified knowledge; unverified knowledge never enters."""
    whole = knowledge.where("verified and coalesce(name, '') <> '' and coalesce(url, '') <> ''")
    own = whole.select("run_id", "name", F.coalesce(F.nullif("category_path", F.lit("")), "node").alias("category_path"), "url")
    return sources.select("run_id", "name", "category_path", "url").unionByName(own)


def pending(declared: DataFrame, knowledge: DataFrame) -> DataFrame:
    done = knowledge.where("name is not null").select("run_id", "name").distinct()
    return declared.select("run_id", "list", "name").distinct().join(done, ["run_id", "name"], "left_anti").select("run_id", "list", "name")


def sources_missing(searches: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs whose searches extracted something while no entry was stored."""
    own = searches.where(vocab.phase_group(F.col("phase")).isin("增量", "扩量")).groupBy("run_id").agg(F.sum("extracted").alias("extracted"))
    return own.where("extracted > 0").join(sources, "run_id", "left_anti")


def quota(journal: DataFrame, nodes: DataFrame, evidence: DataFrame, least: int = vocab.MIN_INCREMENTAL) -> DataFrame:
    """Nodes with fewer than ``least`` evidenced incremental searches; runs without any are not checked."""
    asked = evidence.where("query is not null").select("run_id", "query").distinct()
    own = journal.where(vocab.phase_group(F.col("phase")) == "增量")
    counts = own.join(asked, ["run_id", "query"], "left_semi").groupBy("run_id", "node").agg(F.count("*").alias("n"))
    spine = nodes.join(own.select("run_id").distinct(), "run_id", "left_semi")
    return spine.join(counts, ["run_id", "node"], "left").select("run_id", "node", F.coalesce("n", F.lit(0)).alias("n_evidenced")).where(F.col("n_evidenced") < least)


def zero_without_reason(journal: DataFrame) -> DataFrame:
    return journal.where(vocab.phase_group(F.col("phase")).isin("增量", "扩量") & (F.coalesce("extracted", F.lit(0)) == 0) & _blank("zero_reason"))


def _result_hosts(result_urls: DataFrame) -> DataFrame:
    return result_urls.select("run_id", "query", urls.host(F.col("url")).alias("host")).distinct()


def garbage_claims(journal: DataFrame, result_urls: DataFrame) -> DataFrame:
    """Zero rows that claim garbage hosts while none of their result hosts is one; rows without results are left out."""
    claim = journal.where((F.coalesce("extracted", F.lit(0)) == 0) & F.contains("zero_reason", F.lit("垃圾域")))
    bad = F.count_if(vocab.is_garbage(F.col("host")))
    return claim.join(_result_hosts(result_urls), ["run_id", "query"]).groupBy("store_id").agg(F.count("*").alias("n_hosts"), bad.alias("_bad")).where("_bad = 0").drop("_bad")


def collected_claims(journal: DataFrame, result_urls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Zero rows that claim collected or repeated results while no result host is in the catalog."""
    claim = journal.where((F.coalesce("extracted", F.lit(0)) == 0) & (F.contains("zero_reason", F.lit("已收")) | F.contains("zero_reason", F.lit("重复"))))
    known = catalog.where("url is not null").select("run_id", urls.host(F.col("url")).alias("host")).distinct().withColumn("_in", F.lit(True))
    rows = claim.join(_result_hosts(result_urls), ["run_id", "query"]).join(known, ["run_id", "host"], "left")
    return rows.groupBy("store_id").agg(F.count("_in").alias("_n")).where("_n = 0").select("store_id")


def claims(journal: DataFrame, result_urls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``store_id, garbage_claim, collected_claim`` of zero rows with results: both checks over one read of the results."""
    zero = journal.where(F.coalesce("extracted", F.lit(0)) == 0)
    known = catalog.where("url is not null").select("run_id", urls.host(F.col("url")).alias("host")).distinct().withColumn("_in", F.lit(True))
    rows = zero.join(_result_hosts(result_urls), ["run_id", "query"]).join(known, ["run_id", "host"], "left")
    counted = rows.groupBy("store_id").agg(F.max("zero_reason").alias("r"), F.count_if(vocab.is_garbage(F.col("host"))).alias("bad"), F.count("_in").alias("kept"))
    garbage = F.contains("r", F.lit("垃圾域")) & (F.col("bad") == 0)
    collected = (F.contains("r", F.lit("已收")) | F.contains("r", F.lit("重复"))) & (F.col("kept") == 0)
    return counted.select("store_id", F.coalesce(garbage, F.lit(False)).alias("garbage_claim"), F.coalesce(collected, F.lit(False)).alias("collected_claim"))


def single_documents(journal: DataFrame, result_urls: DataFrame) -> DataFrame:
    """Zero rows whose results hold the page of a single document."""
    pages = result_urls.where(F.col("url").rlike("|".join(vocab.SINGLE_DOCUMENT))).select("run_id", "query").distinct()
    return journal.where(F.coalesce("extracted", F.lit(0)) == 0).join(pages, ["run_id", "query"], "left_semi").select("store_id").distinct()


def reverse_gap(evidence: DataFrame, journal: DataFrame) -> DataFrame:
    asked = evidence.where("query is not null").select("run_id", "query").distinct()
    told = journal.select("run_id", "query").distinct().withColumn("_in", F.lit(True))
    return asked.join(told, ["run_id", "query"], "left").groupBy("run_id").agg(F.count("*").alias("evidence_queries"), F.count_if(F.col("_in").isNull()).alias("unlogged"))


def coverage(located: DataFrame, searches: DataFrame, nodes: DataFrame) -> DataFrame:
    recorded = located.where("leaf is not null").groupBy("run_id", F.col("leaf").alias("node")).agg(F.count("*").alias("_r"))
    extracted = searches.groupBy("run_id", "node").agg(F.sum("extracted").alias("_x"))
    r, x = F.coalesce("_r", F.lit(0)), F.coalesce("_x", F.lit(0))
    rows = nodes.join(recorded, ["run_id", "node"], "left").join(extracted, ["run_id", "node"], "left")
    return rows.select("run_id", "node", r.alias("recorded"), x.alias("extracted"), F.greatest(F.lit(0), x - r).alias("missing"))


def nearest_declared(knowledge: DataFrame, declared: DataFrame) -> DataFrame:
    """``store_id, name, suggestion``: for recorded names that are not declared the nearest of their run by edit distance.

    Ties go to the first in code point order.  Every name is compared with all that its
    run declares: the nearest is mostly far, so no shared part leaves much out.  The
    comparisons are made inside a row, against lists of at most ``LISTED`` names, and no
    pair becomes a row; a run with more than ``ASKED`` recorded names is spread over
    tasks.  Joins are by sorting: the size of lists is not known from the files, and the
    driver must not take them for small.
    """
    names = declared.where("name is not null").select("run_id", F.col("name").alias("suggestion")).distinct()
    odd = knowledge.where("name is not null").select("store_id", "run_id", "name").join(names.withColumnRenamed("suggestion", "name").hint("merge"), ["run_id", "name"], "left_anti")
    asked = odd.select("run_id", "name").distinct()
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("suggestion"))
    lists = names.withColumn("_l", F.floor((place - 1) / LISTED)).groupBy("run_id", "_l").agg(F.collect_list("suggestion").alias("_names")).drop("_l")
    spread = asked.groupBy("run_id").agg(F.ceil(F.count("*") / ASKED).alias("_k"))
    lists = lists.join(spread.hint("merge"), "run_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    # comparing costs far more than its input's size tells, so it gets as many tasks as shuffles have
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = asked.join(spread.hint("merge"), "run_id").withColumn("_part", F.pmod(F.xxhash64("name"), F.col("_k"))).repartition(tasks, "run_id", "_part")
    near = F.array_min(F.transform("_names", lambda x: F.struct(F.levenshtein("name", x).alias("d"), x.alias("suggestion"))))
    best = parts.join(lists.hint("merge"), ["run_id", "_part"]).select("run_id", "name", near.alias("_b")).groupBy("run_id", "name").agg(F.min("_b").getField("suggestion").alias("suggestion"))
    return odd.join(best.hint("merge"), ["run_id", "name"], "left").select("store_id", "name", "suggestion")
