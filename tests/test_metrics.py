"""Bucket quantiles, instant rates and report edges."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postwise.functions.rounding import fixed, round_exact
from postwise.operators import energy, reports
from postwise.operators import service_metrics as metrics

START = dt.datetime(2024, 1, 1, 12, 0, 0)


def _quantile(values, bounds, q):
    counts = [sum(v <= b for v in values) for b in bounds]
    rank = q * len(values)
    for i, c in enumerate(counts):
        if c >= rank:
            if i == 0 and bounds[0] <= 0:
                return bounds[0]
            low, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
            return low + (bounds[i] - low) * (rank - below) / (c - below)
    return bounds[-1]


@pytest.mark.parametrize("q", [0.5, 0.95, 0.99])
@pytest.mark.parametrize("bounds", [[0.1, 0.5, 1.0], [0.0, 0.3, 0.6, 2.0], [5.0]])
def test_bucket_quantile(spark, q, bounds):
    values = [0.05, 0.2, 0.2, 0.4, 0.7, 0.9, 1.5, 3.0, 0.0]
    log = spark.createDataFrame([(START, "/ask", v) for v in values], "ts timestamp, handler string, latency_s double")
    rows = metrics.latency_quantiles(log, "latency_s", bounds, {"p": q}).collect()
    assert len(rows) == 5
    assert all(abs(r["p"] - _quantile(values, bounds, q)) < 1e-12 for r in rows)


def test_cpu_counter_reset(spark):
    rows = [("h", "0", START, 100.0), ("h", "0", START + dt.timedelta(seconds=60), 130.0),
            ("h", "0", START + dt.timedelta(seconds=120), 24.0), ("h", "1", START, 5.0)]
    samples = spark.createDataFrame(rows, "instance string, cpu string, ts timestamp, idle_seconds double")
    busy = {r["window_start"]: r["cpu_busy"] for r in metrics.cpu_busy(samples).collect()}
    # Windows holding the first two samples only, and those that end with the reset.
    assert busy[START - dt.timedelta(minutes=3)] == pytest.approx(50.0)
    assert busy[START] == pytest.approx(60.0)
    assert START + dt.timedelta(minutes=2) not in busy


def test_rates_and_bands(spark):
    rows = [(START + dt.timedelta(seconds=10 * i), "/ask", 500 if i == 0 else 200) for i in range(12)]
    rows.append((START, "/health", 500))
    log = spark.createDataFrame(rows, "ts timestamp, handler string, status int")
    errors = {r["window_start"]: r["error_rate"] for r in metrics.error_rate(log).collect()}
    assert errors[START] == pytest.approx(100 / 12) and errors[START + dt.timedelta(minutes=1)] == 0.0
    rate = {r["window_start"]: r["requests_per_minute"] for r in metrics.request_rate(log).collect()}
    assert rate[START] == pytest.approx(2.4)
    bands = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (None,)], "v double")
    got = [r[0] for r in bands.select(metrics.band(F.col("v"), "error_rate")).collect()]
    assert got == ["green", "yellow", "red", None]
    assert [r[0] for r in bands.select(metrics.band(F.col("v") * 20, "hit_rate")).collect()] == ["red", "red", "green", None]


def test_reports_skip_null_keys_and_allow_empty_input(spark):
    posts = spark.createDataFrame(
        [("a", "u", "word word", None), (None, "u", "word", None), ("a", None, None, None)],
        "category string, username string, normalized_text string, created_at timestamp",
    )
    assert [tuple(r) for r in reports.top_users_per_category(posts).collect()] == [("a", "u", 1)]
    assert [tuple(r) for r in reports.trending_keywords(posts).collect()] == [("word", 3)]
    assert reports.posts_per_hour(posts).count() == 0
    nothing = posts.limit(0)
    assert reports.trending_keywords_by_category(nothing).columns == ["category", "keyword", "count"]
    assert reports.trending_keywords_by_category(nothing).count() == 0


def test_categories_without_real_posts_come_last(spark):
    rows = [("a", "Fake"), ("b", "Real"), ("b", "Fake"), ("c", "Real")]
    frame = spark.createDataFrame(rows, "category string, label string")
    got = [tuple(r) for r in reports.categories_by_real_share(frame).collect()]
    assert got == [("c", 1.0), ("b", 0.5), ("a", None)]


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(0.0,), (0.0999,), (1.0,), (1.5,), (-0.2,), (None,)], "fake_news_prob double")
    got = [tuple(r) for r in reports.prob_histogram(frame).collect()]
    assert got == [(0.0, 3, "fake"), (0.9, 2, "real")]


def test_breakdown_has_three_rows_per_node(spark):
    node = spark.createDataFrame([("n", 1.0, 2.0, 3.0)], "node_name string, avg_cpu_wh double, avg_ram_wh double, avg_gpu_wh double")
    got = {r["component"]: r["avg_wh"] for r in energy.energy_breakdown(node).collect()}
    assert got == {"CPU": 1.0, "RAM": 2.0, "GPU": 3.0}


def test_rounding_follows_python(spark):
    values = [0.0005, 0.0015, 5e-05, 0.00015, 0.5, 1.5, 2.5, 0.125, 2.675, 1234567.125, 0.0, 1.0, 1e-12, 0.99995, -0.0005]
    values += [i * 5e-4 for i in range(200)] + [i * 5e-5 for i in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3, 4):
        for row in frame.withColumn("s", fixed(F.col("x"), digits)).withColumn("r", round_exact(F.col("x"), digits)).collect():
            assert row["s"] == f"{row['x']:.{digits}f}" and row["r"] == round(row["x"], digits)
