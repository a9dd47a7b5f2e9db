"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.plans import core, problems


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.stats_by_node(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core.QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
