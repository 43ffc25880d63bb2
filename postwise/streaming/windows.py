"""Windowed counts over event streams, kept in a keyed table.

Late rows older than the watermark are dropped here; the batch reports over
the stored tables stay the complete totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.functions.scoring import verdict_label
from postwise.operators.service_metrics import WINDOW_MINUTES, ask_requests
from postwise.sources.tables import day_of, upsert
from postwise.streaming.posts import run_available

LATENESS = "10 minutes"


def daily_posts(stream: DataFrame, ts: str = "created_at", delay: str = LATENESS) -> DataFrame:
    day = F.window(ts, "1 day")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(day)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("window_start"), "count")
    )


def request_windows(
    log: DataFrame, by: dict[str, Column] | None = None, ts: str = "ts", delay: str = LATENESS
) -> DataFrame:
    """Requests and errors per sliding window, optionally split by extra columns."""
    slide = F.window(ts, f"{WINDOW_MINUTES} minutes", "1 minute")
    extra = [column.alias(name) for name, column in (by or {}).items()]
    failed = (F.col("status") >= 500) & (F.col("status") < 600)
    return (
        ask_requests(log)
        .withWatermark(ts, delay)
        .groupBy(slide, *extra)
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors"))
        .select(F.col("window.start").alias("window_start"), *(by or {}), "requests", "errors")
    )


def verdict_windows(log: DataFrame, ts: str = "ts", delay: str = LATENESS) -> DataFrame:
    return request_windows(log, {"verdict": verdict_label(F.col("probability"))}, ts, delay)


def store_windows(path: str, schema: T.StructType) -> Callable[[DataFrame, int], None]:
    """Batch handler: replace the rows of changed windows.

    A window is identified by all columns but the counts. The table is partitioned by the day of
    the window, and only the days of a batch are overwritten; a replayed batch changes nothing.
    """
    counts = {"count", "requests", "errors"}
    names = [field.name for field in schema if field.name not in counts]
    keyed = T.StructType([*schema.fields, T.StructField("window_key", T.StringType())])

    def handle(batch: DataFrame, _: int) -> None:
        key = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
        changed = batch.withColumn("window_key", key)
        upsert(changed, path, "window_key", keyed, day_of("window_start"))

    return handle


def stream_windows(windows: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> None:
    """Keep the table at ``path`` equal to the windows seen so far."""
    run_available(windows, store_windows(path, windows.schema), checkpoint, "update", state_partitions)
