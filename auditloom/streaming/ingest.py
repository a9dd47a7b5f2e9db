"""The append-only store as a stream: validate each micro-batch, split it, count late rows.

A Spark extra: the logs are stream-shaped, batches and streams share the same
operators.  State is bounded by a watermark on ingest time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab


def read_store_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a JSONL store as they come; bad lines stay in ``_bad``."""
    return spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_trigger).json(path)


def new_entries(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Entries whose exact address of a run has not come within ``delay``.

    The delay bounds the state, and so what a stream can tell: a repeat that comes
    later passes, and is skipped where it is recorded, against the whole store.
    """
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["run_id", "url"])


def windowed_counts(stream: DataFrame, time_col: str, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Entries for each window of ingest time and type; late rows within the delay still count."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def validate_batches(sink_accepted: Callable[[DataFrame], None], sink_rejected: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: good rows of a batch land although others are rejected."""

    def run(batch: DataFrame, epoch: int) -> None:
        blank = (F.trim(F.coalesce("name", F.lit(""))) == "") | (F.trim(F.coalesce("url", F.lit(""))) == "")
        code = F.when(blank, "INCOMPLETE").when(vocab.is_garbage(urls.host(F.col("url")), vocab.REFUSED_HOSTS), "GARBAGE_DOMAIN")
        judged = batch.withColumn("code", code).persist()
        sink_accepted(judged.where("code is null").drop("code"))
        sink_rejected(judged.where("code is not null"))
        judged.unpersist()

    return run
