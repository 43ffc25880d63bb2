"""Service metrics from a request log and from host samples.

Windows are five minutes long and start every minute. Rows are first reduced
to one row per minute and series; only those are copied into the five windows
a minute belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwise.constants import (
    ANSWER_LATENCY_BUCKETS,
    BANDS,
    CONTEXT_CHARS_BUCKETS,
    CONTEXT_CHARS_TARGET,
    HTTP_LATENCY_BUCKETS,
)
from postwise.functions.scoring import verdict_label

WINDOW_MINUTES = 5
WINDOW_SECONDS = WINDOW_MINUTES * 60


def ask_requests(log: DataFrame) -> DataFrame:
    return log.filter(F.contains("handler", F.lit("/ask")))


def _window_starts(minute: Column) -> Column:
    step = F.expr("INTERVAL 1 MINUTE")
    first = minute - F.expr(f"INTERVAL {WINDOW_MINUTES - 1} MINUTES")
    return F.explode(F.sequence(first, minute, step))


def sliding(log: DataFrame, by: Sequence[str] = (), ts: str = "ts", **sums: Column) -> DataFrame:
    """Sums per window start and ``by`` columns; each value is summed over the rows."""
    minutes = (
        log.filter(F.col(ts).isNotNull())
        .groupBy(F.date_trunc("minute", ts).alias("_minute"), *by)
        .agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    )
    copied = minutes.withColumn("window_start", _window_starts(F.col("_minute")))
    return copied.groupBy("window_start", *by).agg(*[F.sum(name).alias(name) for name in sums])


def total_requests(log: DataFrame) -> DataFrame:
    return ask_requests(log).agg(F.count(F.lit(1)).alias("requests"))


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per minute, rounded half up to two decimals."""
    counted = sliding(ask_requests(log), n=F.lit(1))
    per_minute = F.col("n") / float(WINDOW_SECONDS) * 60.0
    return counted.select("window_start", (F.floor(per_minute * 100.0 + 0.5) / 100.0).alias("requests_per_minute"))


def error_rate(log: DataFrame) -> DataFrame:
    """Percentage of 5xx answers per window."""
    failed = F.when((F.col("status") >= 500) & (F.col("status") < 600), 1).otherwise(0)
    counted = sliding(ask_requests(log), errors=failed, n=F.lit(1))
    return counted.select("window_start", (F.col("errors") / F.col("n") * 100.0).alias("error_rate"))


def hit_rate(log: DataFrame) -> DataFrame:
    """Percentage of retrievals answered from the index; no retrieval gives null."""
    hits = F.count_if(F.col("retrieval_source") == "rag")
    known = F.nullif(F.count("retrieval_source"), F.lit(0))
    return log.agg((hits / known * 100.0).alias("hit_rate"))


def bucket_quantile(cumulative: Column, bounds: Sequence[float], q: float) -> Column:
    """Quantile from cumulative bucket counts (the last entry is the total).

    The first bucket reaching ``q`` of the total, linear inside it. The lowest
    bucket starts at 0 (or at its bound when that is not positive); beyond the
    last finite bound the answer is that bound.
    """
    total = F.get(cumulative, F.lit(len(bounds)))
    rank = total * q
    value = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below = F.get(cumulative, F.lit(i - 1)) if i else F.lit(0)
        inside = F.get(cumulative, F.lit(i)) - below
        upper = float(bounds[i])
        lower = float(bounds[i - 1]) if i else (0.0 if upper > 0 else upper)
        linear = F.lit(lower) + (upper - lower) * F.try_divide(rank - below, inside)
        if i == 0 and upper <= 0:
            linear = F.lit(upper)
        value = F.when(F.get(cumulative, F.lit(i)) >= rank, linear).otherwise(value)
    return F.when(total > 0, value)


def latency_quantiles(
    log: DataFrame, value: str, bounds: Sequence[float], quantiles: dict[str, float]
) -> DataFrame:
    """Quantiles of ``value`` per window by bucket interpolation."""
    sums = {f"_le{i}": F.when(F.col(value) <= bound, 1).otherwise(0) for i, bound in enumerate(bounds)}
    counted = sliding(log.filter(F.col(value).isNotNull()), **sums, _all=F.lit(1))
    cumulative = counted.withColumn("_cumulative", F.array(*sums, "_all"))
    return cumulative.select(
        "window_start",
        *[bucket_quantile(F.col("_cumulative"), bounds, q).alias(name) for name, q in quantiles.items()],
    )


def verdict_totals(log: DataFrame) -> DataFrame:
    verdicts = log.select(verdict_label(F.col("probability")).alias("verdict"))
    return verdicts.filter("verdict IS NOT NULL").groupBy("verdict").agg(F.count(F.lit(1)).alias("total"))


def verdict_rates(log: DataFrame) -> DataFrame:
    """Verdicts per second by label and window."""
    labelled = log.withColumn("verdict", verdict_label(F.col("probability"))).filter("verdict IS NOT NULL")
    counted = sliding(labelled, ["verdict"], n=F.lit(1))
    return counted.select("window_start", "verdict", (F.col("n") / float(WINDOW_SECONDS)).alias("per_second"))


def retrieval_rates(log: DataFrame) -> DataFrame:
    """Retrievals per second by source and window."""
    counted = sliding(log.filter("retrieval_source IS NOT NULL"), ["retrieval_source"], n=F.lit(1))
    return counted.select("window_start", "retrieval_source", (F.col("n") / float(WINDOW_SECONDS)).alias("per_second"))


def cpu_busy(samples: DataFrame, series: Sequence[str] = ("instance", "cpu")) -> DataFrame:
    """CPU busy percentage per window: 100 minus the mean instant idle rate.

    The instant rate uses the last two samples of a series in the window; a
    counter that went down was reset, so its new value is the increase. The
    last two of a window are among the last two of its minutes, so each minute
    keeps two samples per series before it is copied into windows.
    """
    minute = F.date_trunc("minute", "ts")
    newest = Window.partitionBy("_minute", *series).orderBy(F.desc("ts"), F.desc("idle_seconds"))
    kept = (
        samples.select(*series, "ts", "idle_seconds", minute.alias("_minute"))
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank <= 2")
        .drop("_rank")
    )
    copied = kept.withColumn("window_start", _window_starts(F.col("_minute")))
    pairs = copied.groupBy("window_start", *series).agg(
        F.slice(
            F.sort_array(F.collect_list(F.struct("ts", "idle_seconds")), asc=False), 1, 2
        ).alias("_last")
    )
    last, before = F.get("_last", F.lit(0)), F.get("_last", F.lit(1))
    grown = last["idle_seconds"] - before["idle_seconds"]
    increase = F.when(grown >= 0, grown).otherwise(last["idle_seconds"])
    elapsed = (F.unix_micros(last["ts"]) - F.unix_micros(before["ts"])) / 1e6
    rates = pairs.filter(F.size("_last") == 2).withColumn("_rate", F.try_divide(increase, elapsed))
    busy = rates.groupBy("window_start").agg(F.avg("_rate").alias("_idle"))
    return busy.select("window_start", (100.0 - F.col("_idle") * 100.0).alias("cpu_busy"))


def used_percent(total: Column, free: Column) -> Column:
    return (total - free) / total * 100.0


def usage(samples: DataFrame) -> DataFrame:
    """RAM and disk use of every sample in percent."""
    return samples.withColumn("ram_used", used_percent(F.col("memory_total"), F.col("memory_available"))).withColumn(
        "disk_used", used_percent(F.col("disk_size"), F.col("disk_free"))
    )


def band(value: Column, metric: str) -> Column:
    """Traffic light of a metric: values from the second bound on are red.

    For the hit rate and the context size high is good, so the colours turn.
    """
    first, second = BANDS[metric]
    low, high = ("red", "green") if metric in ("hit_rate", "context_chars") else ("green", "red")
    return F.when(value >= second, high).when(value >= first, "yellow").when(value.isNotNull(), low)
