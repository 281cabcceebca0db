"""Resumable work: batches that skip what is done, and streams that append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators.scoring import pending
from lathe.sources.writers import shared_path

KEYS = ["item_id", "probe_id", "model_id"]


def done(outputs: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Outputs that count as done: with ``retry_failed`` only those that are ok and not blank."""
    if not retry_failed:
        return outputs
    return outputs.where((F.coalesce("run_status", F.lit("ok")) == "ok") & (F.trim(F.coalesce("rewrite", F.lit(""))) != ""))


def resumed(queue: DataFrame, outputs: DataFrame, keys: list[str] = KEYS, retry_failed: bool = True) -> DataFrame:
    """What is left of a queue."""
    return pending(queue, done(outputs, retry_failed), keys)


def stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 8) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def first_seen(rows: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key. State is kept for all keys, or, with a time column, for as long as rows may be late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def windowed_counts(rows: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time; windows close when rows can no longer be late."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append(rows: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Runs ``work`` on each micro-batch and appends its rows, each batch in a folder of its own number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(rows: DataFrame, name: str) -> DataFrame:
    """All rows of a stream over what is there now: appended below the shared folder, waited for without a limit, read back. A failure of the stream is raised."""
    path = shared_path(rows.sparkSession, name)
    query = append(rows, f"{path}/rows", f"{path}/checkpoint")
    query.awaitTermination()
    if fault := query.exception():
        raise fault
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").select(*rows.columns)
