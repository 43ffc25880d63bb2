"""Embeddings, feature rows, the labelled set and its split."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.constants import EMBEDDING_SIZE, SEED, STYLE_SIZE
from postwise.functions.text import words

ENCODE_BATCH = 64


def hashed_embeddings(
    df: DataFrame, text: str = "normalized_text", size: int = EMBEDDING_SIZE
) -> DataFrame:
    """Add ``embedding``: hashed word counts of unit length (offline default encoder)."""
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size).transform(
        df.withColumn("_words", words(F.coalesce(text, F.lit(""))))
    )
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_words", "_counts", "_unit")


def encode(
    df: DataFrame,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text: str = "normalized_text",
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """Add ``embedding`` from a user model, scaled to unit length; null where the text is null.

    ``load_model`` runs once per Python worker and returns a function from a
    batch of texts to a matrix. It sees no null text.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            given = np.array([t is not None for t in texts], dtype=bool)
            if not given.any():
                return np.full((len(texts), 1), np.nan)
            matrix = np.asarray(model(texts[given]), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            rows = np.full((len(texts), matrix.shape[1]), np.nan)
            rows[given] = matrix / np.where(norms > 0, norms, 1.0)
            return rows

        return predict

    encoder = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn("embedding", F.when(F.col(text).isNotNull(), encoder(F.col(text))))


def feature_array(embedding: Column, style: Column) -> Column:
    """Embedding followed by the style features (zeros where missing)."""
    zeros = F.array(*[F.lit(0.0)] * STYLE_SIZE)
    return F.concat(embedding.cast("array<double>"), F.coalesce(style, zeros))


def align_embeddings(
    posts: DataFrame,
    embeddings: DataFrame,
    key: str = "unique_id",
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    text: str = "normalized_text",
) -> DataFrame:
    """All posts with their embedding, matched by key and never by position; the posts are read once.

    Posts without a stored vector are encoded by ``encoder``, which adds ``embedding`` from the text column and is shown a null
    text for the others; without an encoder the first such post stops the job.
    """
    row = feature_array(F.col("embedding"), F.col("style_features"))
    vectors = embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    if encoder is None:
        joined = posts.join(vectors, key, "left")
        missing = F.raise_error(F.concat(F.lit("no embedding for "), F.col(key).cast("string")))
        return joined.withColumn("features", F.when(F.col("embedding").isNotNull(), row).otherwise(missing))
    joined = posts.withColumnRenamed(text, "_text").join(vectors.withColumnRenamed("embedding", "_given"), key, "left")
    shown = joined.withColumn(text, F.when(F.col("_given").isNull(), F.coalesce("_text", F.lit(""))))
    encoded = encoder(shown).withColumn("embedding", F.coalesce("_given", F.col("embedding").cast("array<double>")))
    return encoded.withColumn(text, F.col("_text")).drop("_text", "_given").withColumn("features", row)


def labelled_posts(cleaned: DataFrame, drop_conflicts: bool = False) -> DataFrame:
    """Label 1 for reliable sources, 0 for misinformation posts.

    A post that is both appears once under each label unless
    ``drop_conflicts``. One scan: the labels are exploded from the row, and posts without text have none,
    so no filter on the text repeats the cleaning below it.
    """
    reliable = F.col("source_label") == "reliable"
    misinformation = F.col("category") == "Misinformation"
    labels = F.array_compact(F.array(F.when(reliable, 1.0), F.when(misinformation, 0.0)))
    if drop_conflicts:
        labels = F.when(F.size(labels) == 1, labels)
    labels = F.when(F.col("normalized_text") != "", labels)
    return cleaned.filter(reliable | misinformation).withColumn("label", F.explode(labels))


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def require_samples(labelled: DataFrame, min_reliable: int, min_misinformation: int) -> tuple[int, int]:
    """Counts of both classes; raises when one is below its minimum."""
    found = labelled.agg(
        F.count_if(F.col("label") == 1).alias("reliable"),
        F.count_if(F.col("label") == 0).alias("misinformation"),
    ).first()
    if found["reliable"] < min_reliable:
        raise ValueError(f"Not enough reliable posts: {found['reliable']} found, need {min_reliable}.")
    if found["misinformation"] < min_misinformation:
        raise ValueError(
            f"Not enough misinformation posts: {found['misinformation']} found, need {min_misinformation}."
        )
    return found["reliable"], found["misinformation"]


def with_balanced_weights(labelled: DataFrame) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class).

    The joined side has one row per label (two by construction).
    """
    counts = label_counts(labelled)
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    weights = counts.select(
        "label",
        (
            totals.select("rows").scalar() / (totals.select("classes").scalar() * F.col("n").cast("double"))
        ).alias("weight"),
    )
    return labelled.join(F.broadcast(weights), "label")


def _hash_bucket(key: Column, seed: int) -> tuple[Column, Column]:
    digest = F.md5(F.concat(key, F.lit(str(seed))))
    return digest, F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def label_ranks(labelled: DataFrame, key: str = "unique_id", seed: int = SEED) -> DataFrame:
    """Add ``rank`` (1-based, in hash order within the label) and ``n`` (rows of the label).

    Expects one row per (label, key). Ranks are built in two levels so that no
    task sorts a whole label: rows are numbered inside one of 65,536 hash
    buckets and shifted by the rows in the buckets before. The shifts are at
    most 65,536 rows per label, so they are broadcast.
    """
    digest, bucket = _hash_bucket(F.col(key), seed)
    hashed = labelled.withColumn("_digest", digest).withColumn("_bucket", bucket)
    sizes = hashed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "label",
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy("label")).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_digest", key))
    ranked = hashed.withColumn("_inside", inside).join(F.broadcast(shifts), ["label", "_bucket"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_inside")).drop(
        "_digest", "_bucket", "_inside", "_before"
    )


def stratified_split(
    labelled: DataFrame, test_share: float = 0.2, key: str = "unique_id", seed: int = SEED
) -> DataFrame:
    """Add ``split``: ``test`` for the given share of every label, else ``train``."""
    ranked = label_ranks(labelled, key, seed)
    test = F.col("rank") <= F.rint(F.col("n") * F.lit(test_share))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("rank", "n")


def stratified_folds(
    labelled: DataFrame, folds: int = 5, key: str = "unique_id", seed: int = SEED
) -> DataFrame:
    """Add ``fold`` in 0..folds-1 with every label spread evenly."""
    ranked = label_ranks(labelled, key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "n")
