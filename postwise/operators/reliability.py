"""Supervised credibility model: fit, cross-validation, scoring, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from postwise.functions.rounding import round_exact
from postwise.operators.features import label_counts, stratified_folds, with_balanced_weights
from postwise.session import stored

# Ranges of the unit interval into which the scores of a group are cut.
AREA_BUCKETS = 65_536


def fit_reliability(labelled: DataFrame, tol: float = 1e-6) -> LogisticRegressionModel:
    """L2 logistic regression with C = 1 and balanced weights on ``features``.

    The weights sum to the number of rows, so a penalty of 1/rows is the same
    objective as C = 1. Only the two class counts come to the driver; the
    vectors are kept on the executors (memory, then disk) for the iterations.
    """
    counts = {row["label"]: row["n"] for row in label_counts(labelled).collect()}
    rows = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, rows / (len(counts) * n)).otherwise(weight)
    vectors = labelled.select("label", weight.alias("weight"), array_to_vector("features").alias("vector")).persist()
    try:
        return LogisticRegression(
            featuresCol="vector", weightCol="weight", maxIter=1000, tol=tol,
            regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False,
        ).fit(vectors)
    finally:
        vectors.unpersist()


def raw_probability(model: LogisticRegressionModel, df: DataFrame, output: str) -> DataFrame:
    """Add the unrounded probability of class 1."""
    plain = model.copy().setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_class")
    scored = plain.transform(df.withColumn("vector", array_to_vector("features")))
    return scored.withColumn(output, vector_to_array("_probability")[1]).drop(
        "vector", "_raw", "_probability", "_class"
    )


def linear_probability(features: Column, coefficients: Sequence[float], intercept: float) -> Column:
    """Unrounded probability of class 1 by the formula of the model, on whole Arrow batches."""
    weights = np.asarray(coefficients, dtype=np.float64)

    @F.arrow_udf("double")
    def probability(rows: pa.Array) -> pa.Array:
        matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(weights))
        return pa.array(1.0 / (1.0 + np.exp(-(matrix @ weights + intercept))))

    return probability(features)


def penalised_gradient(model: LogisticRegressionModel, labelled: DataFrame) -> np.ndarray:
    """Gradient of the training objective at the model, coefficients first, divided by the rows.

    One vector and one number reach the driver. Near zero where the fit has converged.
    """
    weighted = raw_probability(model, with_balanced_weights(labelled), "_p")
    error = F.col("weight") * (F.col("_p") - F.col("label"))
    cells = weighted.withColumn("_error", error)
    scaled = cells.select("_error", array_to_vector(F.transform("features", lambda x: x * F.col("_error"))).alias("v"))
    found = scaled.agg(Summarizer.mean(F.col("v")).alias("v"), F.avg("_error").alias("e"), F.count("*").alias("n")).first()
    penalty = model.coefficients.toArray() / found["n"]
    return np.append(found["v"].toArray() + penalty, found["e"])


def areas(scored: DataFrame, by: str, score: str = "probability") -> DataFrame:
    """(by, roc_auc) with the exact area under the curve of every group, 0.0 where it has one class; one aggregation.

    The area is a sum over the distinct scores of a group: ones at the score times the zeros below it and half
    of those at it. Scores are cut into ``AREA_BUCKETS`` ranges of the unit interval; zeros are counted inside a range and
    shifted by those of the ranges below, so no task holds a group. Rows without score or label are left out.
    """
    known = scored.filter(F.col(score).isNotNull() & F.col("label").isNotNull())
    bucket = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * (AREA_BUCKETS - 1)).alias("_bucket")
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    steps = known.groupBy(by, bucket, F.col(score).alias("_score")).agg(ones.alias("_ones"), zeros.alias("_zeros"))
    steps = stored(steps, "steps")
    ranges = steps.groupBy(by, "_bucket").agg(F.sum("_zeros").alias("_n"))
    below = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select(by, "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(by, "_bucket").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_zeros").over(inside), F.lit(0)) + F.col("_shift")
    parts = steps.join(shifts, [by, "_bucket"]).withColumn("_part", F.col("_ones") * (before + F.col("_zeros") / 2))
    sums = parts.groupBy(by).agg(F.sum("_part").alias("_area"), F.sum("_ones").alias("_p"), F.sum("_zeros").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return sums.select(by, F.when(pairs > 0, F.col("_area") / pairs).otherwise(0.0).alias("roc_auc"))


def fold_areas(folded: DataFrame, score: str = "probability") -> DataFrame:
    """ROC-AUC of a given score in each fold."""
    return areas(folded, "fold", score).withColumn("fold", F.col("fold").cast("int"))


def score_reliability(model: LogisticRegressionModel, df: DataFrame, output: str = "reliability") -> DataFrame:
    """Add the probability of class 1 with four decimals."""
    return raw_probability(model, df, output).withColumn(output, round_exact(F.col(output), 4))


def _area(scored: DataFrame, score: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label", numBins=0).evaluate(scored)


def roc_auc(scored: DataFrame, score: str = "probability") -> float:
    """Exact area under the curve (every distinct score a threshold); 0.0 for one class."""
    classes = scored.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    return 0.0 if classes["low"] == classes["high"] else _area(scored, score)


def evaluate(scored: DataFrame, score: str = "probability") -> dict[str, float]:
    """ROC-AUC and accuracy at 0.5, four decimals."""
    hit = ((F.col(score) >= 0.5).cast("double") == F.col("label")).cast("double")
    found = scored.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.avg(hit).alias("accuracy")).first()
    auc = 0.0 if found["low"] == found["high"] else _area(scored, score)
    return {"roc_auc": round(auc, 4), "accuracy": round(found["accuracy"] or 0.0, 4)}


def cross_validated_scores(
    labelled: DataFrame, folds: int = 5, key: str = "unique_id", held_out: bool = True
) -> DataFrame:
    """(fold, label, probability) of every row by the model fitted on the other folds.

    With ``held_out=False`` the rows are those that the fold's model was fitted on. The folds are stored once as a column and shared by all fits, which run side by side.
    """
    columns = ["fold", "label", "features"]
    folded = stored(stratified_folds(labelled, folds, key).select(*columns), "folded")

    def fit(fold: int) -> LogisticRegressionModel:
        return fit_reliability(folded.filter(F.col("fold") != fold))

    with ThreadPoolExecutor(folds) as pool:
        fitted = list(pool.map(inheritable_thread_target(fit), range(folds)))
    scored = []
    for i, model in enumerate(fitted):
        rows = folded.filter((F.col("fold") == i) if held_out else (F.col("fold") != i))
        scored.append(raw_probability(model, rows, "probability").withColumn("fold", F.lit(i)))
    return reduce(DataFrame.unionByName, scored).select("fold", "label", "probability")


def cross_validate(labelled: DataFrame, folds: int = 5, key: str = "unique_id") -> DataFrame:
    """ROC-AUC per fold, each model fitted on the other folds; all areas come from one aggregation."""
    found = fold_areas(cross_validated_scores(labelled, folds, key))
    every = labelled.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    return every.join(found, "fold", "left").withColumn("roc_auc", F.coalesce("roc_auc", F.lit(0.0)))


def summarise_folds(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return per_fold.agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"))
