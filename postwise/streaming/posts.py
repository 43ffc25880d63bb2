"""Streams of landed payloads into the post tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwise import schemas
from postwise.functions.handles import unique_id
from postwise.operators.dedup import first_rows
from postwise.operators.incremental import unseen_batch
from postwise.operators.ingest import POST_COLUMNS, complete, themed_rows
from postwise.session import released
from postwise.sources.tables import append, read_table, rejected_lines

REPEAT_WINDOW = "1 day"
REPEAT_LANES = 32


def read_payload_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.PAYLOAD).json(path)


def without_repeats(payloads: DataFrame, delay: str = REPEAT_WINDOW) -> DataFrame:
    """Drop repeats of a key and place that arrive within ``delay`` of each other.

    The watermark is on arrival, not on the post's own time: posts of any age
    are accepted, and the state still stays bounded. Repeats are dropped within
    the lane of their input partition first, so the copies of a hot key do not
    all travel to the one task that owns the key.
    """
    keyed = complete(payloads).withColumn("unique_id", unique_id(F.col("username"), F.col("created_at")))
    # One post found by several searches keeps a row per place; the batch handler takes the best.
    repeat = ["unique_id", "uri", "_place"]
    arrived = keyed.withColumn("ingested_at", F.current_timestamp()).withWatermark("ingested_at", delay)
    lanes = arrived.withColumn("_lane", F.spark_partition_id() % REPEAT_LANES)
    thinned = lanes.dropDuplicatesWithinWatermark([*repeat, "_lane"]).drop("_lane")
    return thinned.dropDuplicatesWithinWatermark(repeat)


def run_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    state_partitions: int | None = None,
) -> None:
    """Process what has arrived, batch by batch, then stop.

    ``state_partitions`` is the number of partitions of the state. A checkpoint fixes it for ever,
    so choose it for the volume the stream will have; without it the session's
    ``spark.sql.shuffle.partitions`` at the first run is taken.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    if state_partitions:
        conf.set(key, str(state_partitions))
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(key, before)


def store_new_posts(posts_path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: append the posts that are not stored yet.

    The best place of a key wins within a batch. The anti-join makes a replayed batch add nothing, and it
    catches repeats older than the watermark.
    """

    def handle(batch: DataFrame, _: int) -> None:
        with released(batch.sparkSession):
            known = read_table(batch.sparkSession, posts_path, schemas.POSTS)
            unique = first_rows(batch, "unique_id", ["_place", "uri"]).select("unique_id", *POST_COLUMNS)
            append(unseen_batch(unique, known), posts_path)

    return handle


def store_cleaned_posts(cleaned_path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: clean the raw posts not cleaned yet and append them."""

    from postwise.plans.jobs import cleaned_rows

    def handle(batch: DataFrame, _: int) -> None:
        with released(batch.sparkSession):
            known = read_table(batch.sparkSession, cleaned_path, schemas.CLEANED)
            unique = first_rows(batch, "unique_id", ["created_at", "text"])
            append(cleaned_rows(unseen_batch(unique, known)), cleaned_path)

    return handle


def stream_posts(
    payloads: DataFrame, posts_path: str, checkpoint: str, state_partitions: int | None = None, **options
) -> None:
    """Landed payloads to the raw post table: themed, labelled and without repeats, as in the batch operators.

    ``options`` are those of ``themed_rows``. Each file is read once; the next run starts behind it.
    """
    themed = themed_rows(payloads, **options)
    run_available(without_repeats(themed), store_new_posts(posts_path), checkpoint, state_partitions=state_partitions)


def stream_rejected(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Landed lines that no post can be made of, to a table of (value, reason, rejected_at); each file is read once."""

    def handle(batch: DataFrame, number: int) -> None:
        # A replayed batch replaces its own rows.
        rejected = rejected_lines(batch).withColumn("rejected_at", F.current_timestamp())
        rejected.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(lines, handle, checkpoint)


def stream_cleaning(posts: DataFrame, cleaned_path: str, checkpoint: str) -> None:
    """Raw posts to the cleaned table."""
    run_available(posts, store_cleaned_posts(cleaned_path), checkpoint)
