"""The queries of the text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import canonical, copies, garbled, names, packing, residue, tables, tokens
from auditloom.session import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store").select("name").unionByName(table(spark, sf_dir, "source_catalog").select(F.col("数据源名称").alias("name")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_names(spark, sf_dir), "name", tables.NAMES)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its class and its number of links."""
    return names.variant_classes(_names(spark, sf_dir), "name", tables.NAMES)


def _source_types(spark: SparkSession, sf_dir: str, also: dict[str, list[str]]) -> list[canonical.Entry]:
    """The reference list (fixed); 其他 is an entry only by its own name."""
    rows = table(spark, sf_dir, "source_type_list").orderBy("type_id").select("type_name", "scope_note").collect()
    return [canonical.Entry(r["type_name"], r["scope_note"] or "", tuple(also.get(r["type_name"], ())), r["type_name"] == "其他") for r in rows]


def _mapped(spark: SparkSession, sf_dir: str, also: dict[str, list[str]]) -> DataFrame:
    rows = table(spark, sf_dir, "store").where("type in ('source', 'knowledge')").select("store_id", "source_type_raw", "source_type")
    fallback = F.col("source_type") == "其他"
    return canonical.map_rows(rows, "store_id", "source_type_raw", _source_types(spark, sf_dir, also), "source_type", fallback).withColumnRenamed("entry", "type_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, tables.SOURCE_TYPES)


def p4_unaided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the reference list and the rows alone, without a table of other words."""
    return _mapped(spark, sf_dir, {})


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct free entry with its entry of the list, or '' if it is unmatched, and its score."""
    rows = table(spark, sf_dir, "store").where("type in ('source', 'knowledge')").select("source_type_raw")
    return canonical.map_values(rows, "source_type_raw", _source_types(spark, sf_dir, tables.SOURCE_TYPES)).withColumnRenamed("entry", "type_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf_dir, "evidence_log"), "evidence_id", "tool_response").select("evidence_id", "field_path")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected string with its original text, null where that is lost."""
    return garbled.find_garbled(table(spark, sf_dir, "evidence_log"), "evidence_id", "tool_response")


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "store").select(F.lit("store").alias("table_name"), F.col("store_id").alias("row_id"), "url")
    catalog = table(spark, sf_dir, "source_catalog").select(F.lit("source_catalog").alias("table_name"), F.col("entry_id").alias("row_id"), F.col("访问地址").alias("url"))
    return store.unionByName(catalog)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_rows(_addresses(spark, sf_dir), "row_id", "url", ["table_name"])


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page of each table with its number of copies."""
    pages = copies.collapse_copies(_addresses(spark, sf_dir), "row_id", "url", ["table_name"])
    return pages.groupBy("table_name", "keep_id").agg(F.max("n_copies").alias("n_copies"), F.count("*").alias("n_notations"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pack_spec").select("spec_name", "capacity_tokens").collect()  # three fixed rows
    plans = {r["spec_name"]: [r["capacity_tokens"]] for r in specs} | {"joint": [r["capacity_tokens"] for r in specs]}
    sized = table(spark, sf_dir, "documents").select("doc_id", tokens.token_counts(F.col("text")).alias("n"))
    return packing.pack(sized, "doc_id", "n", plans)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of each capacity, and of all capacities jointly."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.cases(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the classifier with the weak labels on unseen hosts."""
    return residue.validate(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_classes": p2_classes,
        "p4_found": p4_found,
        "p4_unaided": p4_unaided,
        "p4_values": p4_values,
        "p5_found": p5_found,
        "p5_restored": p5_restored,
        "p6_found": p6_found,
        "p6_pages": p6_pages,
        "p7_ids": p7_ids,
        "p8_packed": p8_packed,
        "p8_fill": p8_fill,
        "p9_found": p9_found,
        "p9_validation": p9_validation,
    }


def oracle_sql() -> dict[str, str]:
    return {}
