"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import SparkSession


def save_clusters(spark: SparkSession, model: KMeansModel, fake_cluster: int, path: str) -> None:
    """KMeans model with its orientation stored beside it."""
    model.write().overwrite().save(f"{path}/model")
    orientation = spark.createDataFrame([(fake_cluster,)], "fake_cluster int").coalesce(1)
    orientation.write.mode("overwrite").parquet(f"{path}/orientation")


def load_clusters(spark: SparkSession, path: str) -> tuple[KMeansModel, int]:
    fake_cluster = spark.read.parquet(f"{path}/orientation").first()["fake_cluster"]
    return KMeansModel.load(f"{path}/model"), fake_cluster


def save_reliability(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_reliability(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)
