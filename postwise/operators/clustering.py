"""KMeans over feature rows, cluster orientation and distance scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwise.constants import CLUSTERS, SEED
from postwise.functions.scoring import margin_score, probability_of, share_score, verdict_text
from postwise.session import stored

# Partitions of a fit by key unless the caller names another number.
FIT_PARTITIONS = 64


def fit_clusters(
    features: DataFrame, k: int = CLUSTERS, seed: int = SEED, key: str | None = None, partitions: int = FIT_PARTITIONS
) -> KMeansModel:
    """Fit KMeans on the array column ``features``.

    With ``key`` the rows are placed by its hash in ``partitions`` and sorted inside
    them first, so the model does not depend on how the input was laid
    out. 389 doubles are about 3 KB a row: 64 partitions suit some ten million
    rows. The frame is not cached here: the fit then keeps its own vectors with their norms (memory, then disk)
    for the iterations, which spares every pass the decoding of cached rows.
    """
    rows = features
    if key:
        rows = rows.repartition(partitions, key).sortWithinPartitions(key)
    vectors = rows.select(array_to_vector("features").alias("vector"))
    return KMeans(k=k, seed=seed, featuresCol="vector", maxIter=300, tol=1e-4).fit(vectors)


def centers_of(model: KMeansModel) -> list[list[float]]:
    return [list(map(float, center)) for center in model.clusterCenters()]


def centroid_distances(features: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Euclidean distance of an array column to every centre, as an array.

    Runs on whole Arrow batches; the centres travel with the function.
    """
    fixed = np.asarray(centers, dtype=np.float64)
    k, width = fixed.shape

    @F.arrow_udf("array<double>")
    def distances(rows: pa.Array) -> pa.Array:
        matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
        result = np.empty((len(rows), k))
        for i in range(k):
            gap = matrix - fixed[i]
            result[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        offsets = pa.array(np.arange(0, len(rows) * k + 1, k), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))

    return distances(features)


def assign_clusters(df: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``distances`` to all centres and ``cluster``, the nearest (lowest on ties)."""
    measured = df.withColumn("distances", centroid_distances(F.col("features"), centers))
    nearest = F.array_position(F.col("distances"), F.array_min("distances")) - 1
    return measured.withColumn("cluster", nearest.cast("int"))


def orient(clustered: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """One row: real cluster, fake cluster and whether any post oriented them.

    A cluster scores its reliable rate minus its misinformation rate; the best
    is real, the lowest number on ties. A cluster without posts scores 0.
    """
    if k != 2:
        raise ValueError("orientation needs exactly two clusters")
    member = [F.col("cluster") == i for i in range(k)]
    scores = []
    for i in range(k):
        reliable = F.avg(F.when(member[i], F.coalesce(F.col("source_label") == "reliable", F.lit(False)).cast("double")))
        misinformation = F.avg(
            F.when(member[i], F.coalesce(F.col("category") == "Misinformation", F.lit(False)).cast("double"))
        )
        scores.append(F.coalesce(reliable - misinformation, F.lit(0.0)).alias(f"score_{i}"))
    best = F.greatest("score_0", "score_1")
    return clustered.agg(*scores).select(
        "score_0",
        "score_1",
        F.when(F.col("score_1") > F.col("score_0"), 1).otherwise(0).alias("real_cluster"),
        F.when(F.col("score_1") > F.col("score_0"), 0).otherwise(1).alias("fake_cluster"),
        (best != 0).alias("orientation_known"),
    )


def score_posts(clustered: DataFrame, fake_cluster: int | Column) -> DataFrame:
    """Add ``fake_news_prob`` (high means real), its alias ``real_score`` and ``is_real``."""
    fake = fake_cluster if isinstance(fake_cluster, Column) else F.lit(fake_cluster)
    to_fake, to_real = F.get("distances", fake), F.get("distances", 1 - fake)
    return (
        clustered.withColumn("fake_news_prob", share_score(to_fake, to_real))
        .withColumn("real_score", F.col("fake_news_prob"))
        .withColumn("is_real", F.col("cluster") != fake)
    )


def score_claims(
    clustered: DataFrame, fake_cluster: int | Column, own_center: bool = False
) -> DataFrame:
    """Interactive score of any number of claims: ``score``, ``probability``, ``verdict``, ``based_on``.

    The verdict text is made from the unrounded score.

    As in the service this replaces, a fake claim counts as close to centre 0
    and a real one to centre 1, whichever cluster is the fake one; with fake
    cluster 1 that turns the score round. ``own_center`` measures from the
    claim's own centre instead; for fake cluster 0 both are the same.
    """
    fake = fake_cluster if isinstance(fake_cluster, Column) else F.lit(fake_cluster)
    is_fake = F.col("cluster") == fake
    near = F.col("cluster") if own_center else F.when(is_fake, 0).otherwise(1)
    score = margin_score(F.get("distances", near), F.get("distances", 1 - near), is_fake)
    scored = clustered.withColumn("score", score)
    return (
        scored.withColumn("probability", probability_of(F.col("score")))
        .withColumn("verdict", verdict_text(F.col("score")))
        .withColumn("based_on", F.lit("kmeans"))
    )


def classify_posts(features: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Nearest centre, orientation and score in one frame; the distances are measured once and stored."""
    clustered = stored(assign_clusters(features, centers).drop("features"), "clustered")
    fake = orient(clustered, len(centers)).first()["fake_cluster"]
    return score_posts(clustered, fake)
