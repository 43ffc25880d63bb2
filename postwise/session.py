"""Session builder, the shared scratch folder and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.maxResultSize": "1g",
}

# Rows of a batch between Spark and Python unless the session names another number: texts and features are wide rows.
BATCH_ROWS = 1000

_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def build_session(app_name: str = "postwise", **conf: str) -> SparkSession:
    """Session with the library's settings; keyword keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def narrow_batches(spark: SparkSession) -> None:
    """Smaller batches for wide rows, where the session has the default number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``, which must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    path = f"{root.rstrip('/')}/postwise/{name}-{uuid.uuid4().hex}"
    if (held := _paths.get()) is not None:
        held.append(path)
    return path


def folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path on it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    files, place = folder(spark, path)
    return files.exists(place)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders made inside; for stages, whose results are written elsewhere."""
    token = _paths.set([])
    try:
        yield
    finally:
        held = _paths.get()
        _paths.reset(token)
        for path in held:
            files, place = folder(spark, path)
            files.delete(place, True)


# Settings of jobs whose results are written down: their shuffle files go when they end, not when the driver collects
# garbage. A task keeps some files open instead of sorting its rows by file. Lists are collected from sorted rows, one at a time.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind; frames must not be kept for later actions."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Later uses neither repeat its work nor lose it with an executor, and the planner knows the
    size of the files when it chooses a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
