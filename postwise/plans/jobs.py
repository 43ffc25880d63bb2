"""The stages end to end: each reads stored tables, handles what is new, appends.

Rerunning a stage adds nothing: keys already stored are left out first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise import schemas
from postwise.functions.scoring import answer_claims, softmax_score
from postwise.functions.text import clean_text, normalize_text, with_style_features
from postwise.operators import clustering, emotion, features, incremental, ingest, reliability
from postwise.operators.dedup import first_rows
from postwise.session import exists, narrow_batches, released, stored
from postwise.sources import models
from postwise.sources.tables import append, read_table
from postwise.streaming.posts import read_payload_stream, stream_posts, stream_rejected

CLEANED_COLUMNS = [f.name for f in schemas.CLEANED if f.name != "utc_saved_at"]
CLASSIFIED_COLUMNS = [f.name for f in schemas.CLASSIFIED if f.name != "classified_at"]
EMOTION_COLUMNS = [f.name for f in schemas.EMOTION if f.name != "classified_at"]


class Ingested(NamedTuple):
    """Posts stored by a run, and landed lines that it put aside (0 without a folder for them)."""

    stored: int
    rejected: int


def _rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def ingest_stage(
    spark: SparkSession,
    landing: str,
    posts_path: str,
    checkpoint: str | None = None,
    state_partitions: int | None = None,
    rejected_path: str | None = None,
) -> Ingested:
    """Landed payloads that no earlier run has read, to new raw posts.

    The landing folder is read as a file stream, once per file; the checkpoint (beside the posts by
    default) holds what is done. ``ingest.new_posts`` gives the same rows for a frame of payloads. Lines that are
    no JSON object or lack text or creation time go to the table at ``rejected_path``, where that is given.
    """
    checkpoint = checkpoint or f"{posts_path.rstrip('/')}-checkpoint"
    counted = [(posts_path, _rows(spark, posts_path))]
    stream_posts(read_payload_stream(spark, landing), posts_path, checkpoint, state_partitions)
    if rejected_path:
        counted.append((rejected_path, _rows(spark, rejected_path)))
        stream_rejected(spark.readStream.text(landing), rejected_path, f"{checkpoint.rstrip('/')}-rejected")
    return Ingested(*[_rows(spark, path) - before for path, before in counted], *([] if rejected_path else [0]))


def releasing(stage: Callable) -> Callable:
    """The stage, with its scratch tables deleted when it ends."""

    @wraps(stage)
    def run(spark: SparkSession, *args, **options):
        with released(spark):
            return stage(spark, *args, **options)

    return run


def cleaned_rows(posts: DataFrame) -> DataFrame:
    """Cleaned table rows of raw posts."""
    return ingest.with_defaults(normalize_text(clean_text(posts))).select(*CLEANED_COLUMNS)


@releasing
def clean_stage(spark: SparkSession, posts_path: str, cleaned_path: str) -> None:
    """Raw posts not cleaned yet to the cleaned table."""
    posts = read_table(spark, posts_path, schemas.POSTS)
    pending = incremental.posts_to_clean(posts, read_table(spark, cleaned_path, schemas.CLEANED))
    append(cleaned_rows(first_rows(pending, "unique_id", ["created_at", "text"])), cleaned_path)


Encoder = Callable[[DataFrame], DataFrame]


def feature_rows(cleaned: DataFrame, encoder: Encoder = features.hashed_embeddings) -> DataFrame:
    """Cleaned posts with ``features`` = embedding and style numbers."""
    row = features.feature_array(F.col("embedding"), F.col("style_features"))
    return encoder(cleaned).withColumn("features", row).drop("embedding")


@releasing
def classify_stage(
    spark: SparkSession,
    cleaned_path: str,
    classified_path: str,
    model_path: str,
    encoder: Encoder = features.hashed_embeddings,
) -> int:
    """Cluster the unclassified posts, orient the clusters, store scores and model.

    Features are written once to the scratch folder: the fit reads them several
    times and a lost executor must not cost the encoding again. Returns the
    number of posts handled; with none, no model is written.
    """
    cleaned = read_table(spark, cleaned_path, schemas.CLEANED)
    pending = incremental.posts_to_classify(cleaned, read_table(spark, classified_path, schemas.CLASSIFIED))
    rows = stored(feature_rows(pending, encoder), "features")
    handled = rows.count()
    if not handled:
        return 0
    model = clustering.fit_clusters(rows, key="unique_id")
    assigned = clustering.assign_clusters(rows, clustering.centers_of(model)).drop("features")
    clustered = stored(assigned, "clustered")
    fake_cluster = clustering.orient(clustered).first()["fake_cluster"]
    scored = clustering.score_posts(clustered, fake_cluster)
    append(scored.select(*CLASSIFIED_COLUMNS), classified_path, loaded_at="classified_at")
    models.save_clusters(spark, model, fake_cluster, model_path)
    return handled


@releasing
def reliability_stage(
    spark: SparkSession,
    cleaned_path: str,
    model_path: str,
    encoder: Encoder = features.hashed_embeddings,
    min_reliable: int = 1,
    min_misinformation: int = 1,
    folds: int = 5,
    style: str = "real",
) -> DataFrame:
    """Fit and store the supervised model; returns its cross-validated AUC summary.

    ``style="zeros"`` trains on zeroed style features.
    """
    labelled = features.labelled_posts(read_table(spark, cleaned_path, schemas.CLEANED))
    features.require_samples(labelled, min_reliable, min_misinformation)
    if style == "zeros":
        labelled = labelled.withColumn("style_features", F.array(*[F.lit(0.0)] * 5))
    rows = stored(feature_rows(labelled, encoder).select("unique_id", "label", "features"), "training")
    models.save_reliability(reliability.fit_reliability(rows), model_path)
    summary = reliability.summarise_folds(reliability.cross_validate(rows, folds))
    # One row, computed before the scratch tables that it comes from are deleted.
    return spark.createDataFrame(summary.collect(), summary.schema)


def training_set_stage(
    cleaned: DataFrame, path: str, min_reliable: int = 30, min_misinformation: int = 30, test_share: float = 0.2
) -> None:
    """The labelled set of the fine-tuning path, guarded and split, written to ``path``.

    The labelled rows are written once to the scratch folder: the guard, the ranks and the split all read them.
    """
    with released(cleaned.sparkSession):
        labelled = stored(features.labelled_posts(cleaned).select("unique_id", "normalized_text", "label"), "labelled")
        features.require_samples(labelled, min_reliable, min_misinformation)
        split = features.stratified_split(labelled, test_share)
        split.select("unique_id", "normalized_text", "label", "split").write.mode("overwrite").parquet(path)


def evaluation_stage(scored: DataFrame, path: str, score: str = "probability") -> dict[str, float]:
    """Area and accuracy of the scored ``test`` rows of the training set, appended to ``path`` with their number and time."""
    tested = stored(scored.filter(F.col("split") == "test").select("label", score), "tested")
    found = reliability.evaluate(tested, score)
    row = tested.agg(F.count(F.lit(1)).alias("rows"))
    append(row.select("rows", *[F.lit(v).alias(k) for k, v in found.items()]), path, loaded_at="evaluated_at")
    return found


ModelLoader = Callable[[], Callable[[np.ndarray], np.ndarray]]


class ClaimModels(NamedTuple):
    """What answers claims: centres with the fake cluster, coefficients with the intercept, and a loader of a
    fine-tuned model, from texts to the logits of fake and real; null where missing."""

    clusters: tuple[list[list[float]], int] | None
    reliability: tuple[list[float], float] | None
    finetuned: ModelLoader | None = None


def load_claim_models(
    spark: SparkSession, clusters_path: str, reliability_path: str, finetuned: ModelLoader | None = None
) -> ClaimModels:
    """The models that the stages have stored, and a fine-tuned one of the caller's; a missing folder is a missing scorer."""
    clusters = linear = None
    if exists(spark, clusters_path):
        model, fake_cluster = models.load_clusters(spark, clusters_path)
        clusters = (clustering.centers_of(model), fake_cluster)
    if exists(spark, reliability_path):
        fitted = models.load_reliability(reliability_path)
        linear = (list(map(float, fitted.coefficients.toArray())), float(fitted.intercept))
    return ClaimModels(clusters, linear, finetuned)


def answer_texts(claims: DataFrame, stored_models: ClaimModels, encoder: Encoder = features.hashed_embeddings) -> DataFrame:
    """Claims answered from their ``text``: encoded with its style, scored by the stored models, first scorer first.

    The fine-tuned model comes first, then the linear one, then the clusters. As in the service this replaces, the text itself
    is encoded, not its normalised form. A null text counts as empty. A limit on the tokens of a text is the
    model's own: it sees whole texts. Any number of claims, without a pass over them before the answer.
    """
    narrow_batches(claims.sparkSession)
    plain = claims.withColumn("text", F.coalesce("text", F.lit("")))
    rows = feature_rows(with_style_features(plain).withColumn("normalized_text", F.col("text")), encoder)
    nothing = F.lit(None).cast("double")
    rows = rows.withColumn("finetuned", nothing).withColumn("reliability", nothing).withColumn("kmeans", nothing)
    if stored_models.finetuned:
        logits = predict_batch_udf(stored_models.finetuned, return_type=T.ArrayType(T.DoubleType()), batch_size=features.ENCODE_BATCH)
        rows = rows.withColumn("_logits", logits(F.col("text"))).withColumn("finetuned", softmax_score(F.col("_logits"))).drop("_logits")
    if stored_models.reliability:
        rows = rows.withColumn("reliability", reliability.linear_probability(F.col("features"), *stored_models.reliability))
    if stored_models.clusters:
        centers, fake_cluster = stored_models.clusters
        scored = clustering.score_claims(clustering.assign_clusters(rows, centers), fake_cluster)
        rows = scored.withColumn("kmeans", F.col("score")).drop("score", "probability", "verdict", "based_on")
    return answer_claims(rows).drop("features", "distances", "cluster", "normalized_text", "style_features")


@releasing
def emotion_stage(
    spark: SparkSession,
    cleaned_path: str,
    emotion_path: str,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
) -> None:
    """Score the emotions of posts not scored yet."""
    cleaned = read_table(spark, cleaned_path, schemas.CLEANED)
    pending = incremental.posts_for_emotion(cleaned, read_table(spark, emotion_path, schemas.EMOTION))
    scored = emotion.top_emotion(emotion.emotion_scores(pending, load_model))
    append(scored.select(*EMOTION_COLUMNS), emotion_path, loaded_at="classified_at")


def run_stages(
    spark: SparkSession,
    landing: str,
    root: str,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    encoder: Encoder = features.hashed_embeddings,
) -> None:
    """The default chain below ``root``: ingest, clean, classify, emotion."""
    ingest_stage(spark, landing, f"{root}/posts")
    clean_stage(spark, f"{root}/posts", f"{root}/cleaned")
    classify_stage(spark, f"{root}/cleaned", f"{root}/classified", f"{root}/models/kmeans", encoder)
    emotion_stage(spark, f"{root}/cleaned", f"{root}/emotions", load_model)
