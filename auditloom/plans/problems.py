"""Queries of the general data problems: drifting schemas and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import drift, nested
from auditloom.session import table

_GROUP = ["domain_id", "file_kind"]
_JSON_COLUMNS = ["tool_input", "tool_response"]
#: The tables of the evidence log that have queries of their own; their columns are found.
_TABLES = ["tool_input", "tool_input.filters", "tool_response", "tool_response.results", "tool_response.results.content", "tool_response.results.content.sitelinks", "tool_response.links"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "run_file_rows"), _GROUP, "file_kind", "file_id", "written_at")


def p1_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alternative type of every field of a kind of file, with the file where it appears."""
    return drift.alternatives(table(spark, sf_dir, "run_file_rows"), ["file_kind"], "file_id", "written_at")


def _unified(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "run_file_rows").where(F.col("file_kind") == kind)
        fields = drift.file_fields(rows, ["file_id"])
        names = drift.field_names(drift.changes(rows, _GROUP, "file_kind", "file_id", "written_at"), fields)
        return drift.unified(rows, ["row_id", "file_id", "run_id", "line_no"], names, drift.main_types(fields, names))

    return query


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nodes(table(spark, sf_dir, "evidence_log"), "evidence_id", _JSON_COLUMNS)


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = nested.shred(table(spark, sf_dir, "evidence_log"), "evidence_id", _JSON_COLUMNS)
        return nested.flat_table(triples, "evidence_id", name)

    return query


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.table_report(nested.shred(table(spark, sf_dir, "evidence_log"), "evidence_id", _JSON_COLUMNS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_alternatives": p1_alternatives,
        "p1_search_log": _unified("搜索日志"),
        "p1_catalog": _unified("数据源清单"),
        "p3_found": p3_found,
        "p3_report": p3_report,
        **{f"p3_{name.rpartition('.')[2]}": _flat(name) for name in _TABLES},
    }

