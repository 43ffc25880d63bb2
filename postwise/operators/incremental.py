"""What is not stored yet: anti-joins between a table and what was derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwise.session import stored


def distinct_keys(df: DataFrame, key: str = "unique_id") -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def unseen(candidates: DataFrame, stored_rows: DataFrame, key: str = "unique_id") -> DataFrame:
    """Rows of ``candidates`` whose key is not in ``stored_rows``.

    Only the two key columns are compared in full, both made distinct first
    (partial aggregation), so a key with many copies costs one row per task.
    The pending keys are written down, so the planner knows their bytes: below the broadcast
    threshold they pick the wide rows without a shuffle, above it they are joined by shuffle, where
    adaptive execution splits hot keys.
    """
    pending = distinct_keys(candidates, key).join(distinct_keys(stored_rows, key), key, "left_anti")
    return candidates.join(stored(pending, "pending"), key, "left_semi")


def unseen_batch(batch: DataFrame, stored_rows: DataFrame, key: str = "unique_id") -> DataFrame:
    """As ``unseen`` for a batch with one row per key that is small beside ``stored_rows``.

    The batch is written down; the stored keys are cut down to those of the batch in one scan,
    without a shuffle when its keys are below the broadcast threshold.
    """
    batch = stored(batch, "batch")
    known = stored(stored_rows.select(key).join(batch.select(key), key, "left_semi").distinct(), "known")
    return batch.join(known, key, "left_anti")


def scorable(cleaned: DataFrame) -> DataFrame:
    """Posts with a non-empty normalised text; null counts as empty."""
    return cleaned.filter(F.col("normalized_text") != "")


def posts_to_clean(posts: DataFrame, cleaned: DataFrame) -> DataFrame:
    return unseen(posts, cleaned)


def posts_to_classify(cleaned: DataFrame, classified: DataFrame) -> DataFrame:
    return unseen(scorable(cleaned), classified)


def posts_for_emotion(cleaned: DataFrame, emotions: DataFrame) -> DataFrame:
    columns = ["unique_id", "username", "category", "normalized_text"]
    return unseen(scorable(cleaned).select(*columns), emotions)
