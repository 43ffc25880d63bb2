"""Landing files, projected views, appends and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise import schemas
from postwise.functions.scoring import real_fake
from postwise.operators.dedup import first_rows
from postwise.session import exists, folder, released, stored

POSTS_VIEW = ["username", "created_at", "category", "normalized_text"]
CLASSIFIED_VIEW = ["username", "category", "is_real", "fake_news_prob", "classified_at"]
EMOTION_VIEW = ["unique_id", "username", "category", "emotion", "emotion_score", "classified_at"]


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON payloads under the fixed schema (no inference pass)."""
    return spark.read.schema(schemas.PAYLOAD).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The landing folder line by line, as ``value``."""
    return spark.read.text(path)


MALFORMED, INCOMPLETE = "malformed", "incomplete"


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines with their ``payload`` under the fixed schema, all ``fields`` as VARIANT, and the ``reason`` to reject them."""
    fields = F.try_parse_json("value")
    # Other JSON than an object is no payload.
    whole = fields.isNotNull() & (F.schema_of_variant(fields).startswith("OBJECT"))
    payload = F.from_json(F.when(whole, F.col("value")), schemas.PAYLOAD)
    rows = lines.select("value", F.when(whole, fields).alias("fields"), payload.alias("payload"))
    present = (F.length("payload.text") > 0) & (F.length("payload.created_at") > 0)
    reason = F.when(F.col("fields").isNull(), MALFORMED).when(~F.coalesce(present, F.lit(False)), INCOMPLETE)
    return rows.withColumn("reason", reason)


def landed_payloads(lines: DataFrame) -> DataFrame:
    """Payloads of the complete lines, and all their ``fields``, unknown ones too, as VARIANT."""
    return _parsed(lines).filter(F.col("reason").isNull()).select("payload.*", "fields")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(value, reason) of every line that ``landed_payloads`` leaves out: no JSON object, or no text or creation time."""
    return _parsed(lines).filter(F.col("reason").isNotNull()).select("value", "reason")


def parse_instant(c: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; text that is no timestamp gives null."""
    return c.try_cast("timestamp")


def posts_view(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*POSTS_VIEW).withColumn("created_at", parse_instant(F.col("created_at")))


def classified_view(classified: DataFrame) -> DataFrame:
    return classified.select(*CLASSIFIED_VIEW).withColumn("label", real_fake(F.col("is_real")))


def emotion_view(emotions: DataFrame) -> DataFrame:
    return emotions.select(*EMOTION_VIEW)


def newest_first(df: DataFrame, ts: str = "timestamp", ties: Sequence[str] = ("run_id", "node_name")) -> DataFrame:
    """Newest rows first; rows of one instant in the order of the tie columns."""
    return df.orderBy(F.desc(ts), *ties)


def append(df: DataFrame, path: str, loaded_at: str = "utc_saved_at") -> None:
    """Append rows stamped with the load time."""
    df.withColumn(loaded_at, F.current_timestamp()).write.mode("append").parquet(path)


def merge_rows(
    existing: DataFrame, updates: DataFrame, key: str, order: list[Column] | None = None
) -> DataFrame:
    """``existing`` with whole rows replaced or added from ``updates``.

    ``order`` names the winner where the updates repeat a key; without it the
    updates must already hold one row per key. The winners are written down, so the planner
    knows their bytes: the existing rows are only shuffled when there are many.
    """
    winners = first_rows(updates, key, order) if order else updates
    winners = stored(winners.select(*existing.columns), "winners")
    kept = existing.join(winners.select(key), key, "left_anti").select(*existing.columns)
    return kept.unionByName(winners)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Append-only table at ``path``; an empty frame of the schema before the first write."""
    files, place = folder(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# A keyed table is plain Parquet, partitioned by ``part``: key buckets, or the days of a time column.
PART = "part"


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def day_of(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("none"))


def _parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_table(spark, path, T.StructType([*schema.fields, T.StructField(PART, T.StringType())]))


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The keyed table at ``path``; an empty frame of the schema before the first upsert."""
    return _parts(spark, path, schema).select(*schema.names)


def _overwrite_parts(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Put the parts that an upsert has merged in their places; done again, it changes nothing."""
    pending = f"{path}/_pending"
    if not exists(spark, f"{pending}/_SUCCESS"):
        return
    # Rows are dealt by part; adaptive execution cuts a large part into several files.
    rows = _parts(spark, pending, schema).hint("rebalance", PART)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    files, place = folder(spark, pending)
    files.delete(place, True)


def upsert(
    updates: DataFrame, path: str, key: str, schema: T.StructType, part: Column, order: list[Column] | None = None
) -> None:
    """Merge ``updates`` into the keyed table at ``path``, which one job at a time may write.

    ``part`` gives the part of a row from its key columns: rows with one key share a part. Only the
    parts that the updates touch are read and overwritten; the driver holds their names. The merged parts
    are written down before they replace the old ones, and the next upsert finishes a
    replacement that was cut off, so a failed batch can be replayed.
    """
    spark = updates.sparkSession
    _overwrite_parts(spark, path, schema)
    with released(spark):
        winners = first_rows(updates, key, order) if order else updates
        winners = stored(winners.select(*schema.names).withColumn(PART, part), "winners")
        touched = [r[PART] for r in winners.select(PART).distinct().collect()]
        if not touched:
            return
        old = _parts(spark, path, schema).filter(F.col(PART).isin(touched))
        merge_rows(old, winners, key).write.mode("overwrite").parquet(f"{path}/_pending")
    _overwrite_parts(spark, path, schema)
