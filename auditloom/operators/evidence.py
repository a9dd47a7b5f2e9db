"""Evidence of searches: queries, result addresses, texts and address tokens.

Payloads are VARIANT, because results mix objects, lists and strings.  Grounding
is a tokenised equi-join: O(tokens) instead of candidates times texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls

#: A maximal run of characters that an address may have (fixed value).
TOKEN = r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"


def parsed(df: DataFrame) -> DataFrame:
    """``evidence_id, run_id, query, response`` with the response as VARIANT, null if unreadable."""
    given, back = F.try_parse_json("tool_input"), F.try_parse_json("tool_response")
    query = F.coalesce(F.try_variant_get(given, "$.query", "string"), F.try_variant_get(back, "$.query", "string"))
    return df.select("evidence_id", "run_id", query.alias("query"), back.alias("response"))


def result_items(evidence: DataFrame) -> DataFrame:
    """Each result, and each item within a result's content: ``pos, sub, url, title, text``.

    ``sub`` is -1 for the result itself.  A result and its items come from one
    array, so the evidence is read and parsed once.
    """
    results = evidence.select("evidence_id", "run_id", "query", F.posexplode(F.try_variant_get("response", "$.results", "array<variant>")).alias("pos", "r"))
    inner = F.transform(F.coalesce(F.try_variant_get("r", "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda x, i: F.struct(i.alias("sub"), x.alias("item")))
    each = results.select("evidence_id", "run_id", "query", "pos", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("sub"), F.col("r").alias("item"))), inner)).alias("_i"))
    each = each.select("evidence_id", "run_id", "query", "pos", "_i.sub", "_i.item")
    text = F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))
    return each.select(
        "evidence_id", "run_id", "query", "pos", "sub", F.try_variant_get("item", "$.url", "string").alias("url"), F.try_variant_get("item", "$.title", "string").alias("title"),
        F.coalesce(F.try_variant_get("item", "$.text", "string"), text).alias("text"),
    )


def result_urls(evidence: DataFrame) -> DataFrame:
    return result_items(evidence).where("url is not null and url <> ''").select("evidence_id", "run_id", "query", "pos", "sub", "url")


def address_tokens(text: Column) -> Column:
    """The address tokens of a text, without bold marks, and each cut before its ``#`` as well."""

    def forms(raw: Column) -> Column:
        token = F.btrim(raw, F.lit("*"))
        parts = F.split(token, "#")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "#"))
        return F.when(F.contains(token, F.lit("#")), heads).otherwise(F.array(token))

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), forms)), lambda t: t != "")


def held_tokens(evidence: DataFrame) -> DataFrame:
    """``run_id, evidence_id, query, token``: address tokens of everything under a response's results.

    Never of the query or its echo.
    """
    text = F.to_json(F.try_variant_get("response", "$.results", "variant"))
    # escapes of JSON would join a letter to the address that follows
    plain = F.regexp_replace(text, r"\\(u[0-9a-fA-F]{4}|.)", " ")
    return evidence.select("run_id", "evidence_id", "query", F.explode(address_tokens(plain)).alias("token"))


def tokens(evidence: DataFrame) -> DataFrame:
    """The distinct ``run_id, token`` of the evidence."""
    return held_tokens(evidence).select("run_id", "token").distinct()


def grounded(candidates: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """``candidates`` with ``is_grounded``: an accepted form of the address stands in the run's evidence."""
    forms = candidates.where("url is not null").select(id_col, "run_id", F.explode(urls.variants(F.col("url"))).alias("token"))
    hit = forms.join(tokens(evidence), ["run_id", "token"], "left_semi").select(id_col).distinct()
    return candidates.join(hit.withColumn("is_grounded", F.lit(True)), id_col, "left").withColumn("is_grounded", F.coalesce("is_grounded", F.lit(False)))


def first_queries(candidates: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """``id_col, first_query``: the query of the earliest evidence line that holds the address."""
    held = held_tokens(evidence.where("query is not null"))
    # one row for each token of a run before the join: partial aggregation, no row is gathered
    earliest = held.groupBy("run_id", "token").agg(F.min(F.struct("evidence_id", "query")).alias("first"))
    forms = candidates.where("url is not null").select(id_col, "run_id", F.explode(urls.variants(urls.strip_anchors(F.col("url")))).alias("token"))
    found = forms.join(earliest, ["run_id", "token"]).groupBy(id_col).agg(F.min("first").getField("query").alias("first_query"))
    return candidates.select(id_col).join(found, id_col, "left")


def text_only(candidates: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """``id_col, url, evidence_id, query``: candidates whose address no result has, but the text of one.

    Any accepted form counts; the earliest evidence line is told.
    """
    own = candidates.where("url is not null").select(id_col, "run_id", urls.strip_anchors(F.col("url")).alias("url"))
    items = result_items(evidence)
    # one pass: addresses of results, and tokens of texts with their lines
    held = F.concat(
        F.when(F.coalesce("url", F.lit("")) != "", F.array(F.struct(F.lit(True).alias("direct"), urls.strip_anchors(F.col("url")).alias("token")))).otherwise(F.array().cast("array<struct<direct:boolean,token:string>>")),
        F.transform(F.coalesce(address_tokens(F.col("text")), F.array().cast("array<string>")), lambda t: F.struct(F.lit(False).alias("direct"), t.alias("token"))),
    )
    seen = items.select("run_id", "evidence_id", "query", F.explode(held).alias("_h")).groupBy("run_id", "_h.token").agg(
        F.max("_h.direct").alias("direct"), F.min(F.when(~F.col("_h.direct") & F.col("query").isNotNull(), F.struct("evidence_id", "query"))).alias("first")
    )
    forms = own.select(id_col, "run_id", "url", F.explode(urls.variants(F.col("url"))).alias("token"))
    met = forms.join(seen, ["run_id", "token"]).groupBy(id_col, "url").agg(F.max(F.col("direct") & (F.col("token") == F.col("url"))).alias("direct"), F.min("first").alias("first"))
    return met.where("not direct and first is not null").select(id_col, "url", "first.evidence_id", "first.query")
