"""Emotion scores from a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.constants import EMOTIONS, PROBABLE
from postwise.functions.rounding import round_exact, round_scaled

EMOTION_BATCH = 16


def emotion_scores(
    df: DataFrame,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "normalized_text",
    labels: Sequence[str] = tuple(EMOTIONS),
    batch_size: int = EMOTION_BATCH,
) -> DataFrame:
    """Add ``emotions``: (emotion, score) of all labels, strongest first.

    ``load_model`` runs once per Python worker and returns a function from a
    batch of texts to a (texts, labels) matrix. Equal scores fall in label
    order of the model.
    """
    scorer = predict_batch_udf(load_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    entry = [
        F.struct(
            (-F.col("_scores")[i]).alias("order"),
            F.lit(i).alias("place"),
            F.lit(label.lower()).alias("emotion"),
            round_exact(F.col("_scores")[i], 4).alias("score"),
        )
        for i, label in enumerate(labels)
    ]
    ranked = F.array_sort(F.array(*entry))
    plain = F.transform(ranked, lambda e: F.struct(e["emotion"].alias("emotion"), e["score"].alias("score")))
    return df.withColumn("_scores", scorer(F.col(text))).withColumn("emotions", plain).drop("_scores")


def top_emotion(scored: DataFrame) -> DataFrame:
    """Strongest emotion and its score per post."""
    first = F.get("emotions", F.lit(0))
    return scored.withColumn("emotion", first["emotion"]).withColumn("emotion_score", first["score"])


def emotion_percent(score: Column) -> Column:
    return round_scaled(score * 100.0, 1)


def emotion_badges(emotions: Column, shown: int = 4) -> Column:
    """Of the strongest ``shown`` emotions those above the probable threshold."""
    return F.filter(F.slice(emotions, 1, shown), lambda e: e["score"] > PROBABLE)


def badge_text(emotion: Column, score: Column) -> Column:
    return F.concat(F.initcap(emotion), F.lit(" "), F.rint(score * 100.0).cast("long").cast("string"), F.lit("%"))
