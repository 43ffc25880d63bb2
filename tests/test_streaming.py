"""Streams in several drops equal the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from postwise import schemas
from postwise.functions.text import clean_text, normalize_text
from postwise.sources import tables
from postwise.streaming import posts as post_streams
from postwise.streaming import windows as window_streams


def _drop(spark, path, rows):
    spark.createDataFrame([(*r, None, None, None) for r in rows], schemas.PAYLOAD).coalesce(1).write.mode("append").json(path)


def test_two_drops_with_repeats_and_an_old_post(spark, tmp_path):
    landing, stored, checkpoint = (str(tmp_path / n) for n in ("landing", "posts", "checkpoint"))
    first = [("u1", "a", "Hello there", "2024-03-01T00:00:00Z", "en"), ("u2", "b", "News", "2024-03-01T00:01:00Z", "en")]
    second = [first[0], ("u3", "c", "Old post", "2024-01-10T00:00:00Z", "en"), ("u4", "d", "", "2024-03-01T00:00:00Z", "en")]

    def run():
        stream = post_streams.read_payload_stream(spark, landing)
        post_streams.stream_posts(stream, stored, checkpoint, 4, themes={"Discover": ["hello", "news", "old post"]})

    _drop(spark, landing, first)
    run()
    _drop(spark, landing, second)
    run()
    run()
    got = sorted(r["unique_id"] for r in spark.read.parquet(stored).collect())
    assert got == ["a_2024-03-01T00:00:00Z", "b_2024-03-01T00:01:00Z", "c_2024-01-10T00:00:00Z"]

    # A fresh checkpoint replays everything; the stored keys still add nothing.
    stream = post_streams.read_payload_stream(spark, landing)
    post_streams.stream_posts(stream, stored, str(tmp_path / "other"), 4, themes={"Discover": ["hello", "news", "old post"]})
    assert spark.read.parquet(stored).count() == 3

    cleaned = str(tmp_path / "cleaned")
    raw = spark.readStream.schema(schemas.POSTS).option("maxFilesPerTrigger", 1).parquet(stored)
    post_streams.stream_cleaning(raw, cleaned, str(tmp_path / "clean-checkpoint"))
    got = {r["unique_id"]: (r["normalized_text"], r["style_features"]) for r in spark.read.parquet(cleaned).collect()}
    batch = normalize_text(clean_text(spark.read.parquet(stored)))
    assert got == {r["unique_id"]: (r["normalized_text"], r["style_features"]) for r in batch.collect()}


def test_window_table_follows_late_updates(spark, tmp_path):
    source, table = str(tmp_path / "events"), str(tmp_path / "table")
    schema = "ts timestamp, handler string, status int, probability double"

    def drop(times):
        rows = spark.createDataFrame([(t, "/ask", 500, 0.7) for t in times], "t string, handler string, status int, probability double")
        rows.select(F.col("t").cast("timestamp").alias("ts"), "handler", "status", "probability").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        windows = window_streams.verdict_windows(stream)
        window_streams.stream_windows(windows, table, str(tmp_path / "checkpoint"))
        return windows.schema

    drop(["2024-01-01 00:10:00", "2024-01-01 00:10:30"])
    run()
    drop(["2024-01-01 00:09:00"])
    result_schema = run()
    got = {str(r["window_start"])[11:16]: r["errors"] for r in tables.read_keyed(spark, table, result_schema).collect()}
    assert got == {"00:05": 1, "00:06": 3, "00:07": 3, "00:08": 3, "00:09": 3, "00:10": 2}
