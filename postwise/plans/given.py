"""The given tables as the tables of the post pipeline.

Nothing is generated: every row of the results comes from a row of the inputs.
Emotions and classifications are stand-ins computed from columns, not models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwise.constants import EMOTIONS, RELIABLE_ACCOUNTS, THEMES
from postwise.functions.handles import source_label, unique_id
from postwise.functions.scoring import real_fake
from postwise.functions.text import clean_text, normalize_text
from postwise.operators.features import align_embeddings, encode

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Session setting that names the partitions of the text tables; unset, they keep the splits of their files.
TEXT_PARTITIONS = "spark.postwise.textPartitions"


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; a caller with one-file tables may have them spread by TEXT_PARTITIONS."""
    wanted = spark.conf.get(TEXT_PARTITIONS, None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(wanted)) if wanted else rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_times(table(spark, sf_dir, "events"))


def event_times(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _username() -> Column:
    source = F.col("source")
    return (
        F.when(source.isin("src0", "src1"), "reuters.com")
        .when(source.isin("src2", "src3"), "desk.apnews.com")
        .when(source == "src4", "fakereuters.com")
        .otherwise(F.concat(source, F.lit(".example.social")))
    )


def _category() -> Column:
    return (
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "Misinformation")
        .when(F.col("source").isin("src0", "src1", "src2", "src3"), "Reliable")
        .when(F.col("doc_id") % 3 == 0, "Discover")
        .when(F.col("doc_id") % 3 == 1, "Trending")
        .otherwise("Hot Topics")
    )


def _dated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "ts")
    return texts(spark, sf_dir, "documents").join(times, "doc_id")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed posts as delivered: a quarter by the search for a listed word, those of listed accounts
    with an odd number by their feed, the others without a known delivery."""
    words = [w for listed in THEMES.values() for w in listed]
    searched = F.col("doc_id") % 4 == 0
    fed = _username().isin(*RELIABLE_ACCOUNTS) & (F.col("doc_id") % 2 == 1)
    word = F.get(F.array(*[F.lit(w) for w in words]), (F.floor(F.col("doc_id") / 4) % len(words)).cast("int"))
    return _dated_documents(spark, sf_dir).select(
        F.concat(F.lit("post/"), F.col("doc_id").cast("string")).alias("uri"),
        _username().alias("username"),
        "text",
        F.date_format("ts", ISO_FORMAT).alias("created_at"),
        "lang",
        F.when(searched, "search").when(fed, "account").alias("feed"),
        F.when(searched, word).when(fed, _username()).alias("term"),
        F.to_date("ts").alias("arrival_date"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts with their document number and length."""
    labels = table(spark, sf_dir, "labels")
    base = _dated_documents(spark, sf_dir).join(labels, "doc_id", "left")
    return base.select(
        "doc_id",
        "n_chars",
        _username().alias("username"),
        "text",
        F.date_format("ts", ISO_FORMAT).alias("created_at"),
        _category().alias("category"),
    ).select(
        "*",
        unique_id(F.col("username"), F.col("created_at")).alias("unique_id"),
        source_label(F.col("username")).alias("source_label"),
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(posts(spark, sf_dir))


def _cleaned(raw: DataFrame) -> DataFrame:
    return normalize_text(clean_text(raw)).drop("text", "clean_text")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in classification by text length."""
    scored = posts(spark, sf_dir).withColumn("fake_news_prob", (F.col("n_chars") % 997) / F.lit(996.0))
    verdicts = scored.withColumn("is_real", F.col("fake_news_prob") >= 0.5)
    return verdicts.withColumn("label", real_fake(F.col("is_real"))).drop("text", "n_chars")


def emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in emotions by document number and length."""
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    return posts(spark, sf_dir).select(
        "doc_id",
        "unique_id",
        "username",
        "category",
        F.get(names, (F.col("doc_id") % 7).cast("int")).alias("emotion"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("emotion_score"),
    )


def energy_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    pipeline = (
        F.when(kind == "view", "ingest")
        .when(kind == "click", "clean")
        .when(kind == "purchase", "classify")
        .when(kind == "signup", "emotion")
        .otherwise("default")
    )
    return events(spark, sf_dir).select(
        pipeline.alias("pipeline_name"),
        F.concat(kind, F.lit("_node_"), (F.col("user_id") % 3).cast("string")).alias("node_name"),
        F.concat(F.lit("run_"), (F.col("event_id") % 97).cast("string")).alias("run_id"),
        F.col("ts").alias("timestamp"),
        value.alias("duration_s"),
        (value * 0.000001).alias("energy_kwh"),
        (value * 0.0000006).alias("cpu_energy_kwh"),
        (value * 0.0000001).alias("gpu_energy_kwh"),
        (value * 0.0000003).alias("ram_energy_kwh"),
        (value * 0.00000005).alias("co2_kg"),
    )


def as_requests(event_rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "signup", "general_knowledge").when(kind == "error", "error").otherwise("rag")
    return event_rows.select(
        "ts",
        F.lit("/ask").alias("handler"),
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 10).alias("latency_s"),
        source.alias("retrieval_source"),
        ((F.col("user_id") % 101).cast("double") / 100).alias("probability"),
        F.floor(F.col("value") * 20).cast("double").alias("context_chars"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gauges per host; the idle counter restarts every day."""
    second_of_day = (F.unix_micros("ts") % 86_400_000_000) / 1e6
    return events(spark, sf_dir).select(
        F.concat(F.lit("host"), (F.col("user_id") % 2).cast("string")).alias("instance"),
        F.lit("0").alias("cpu"),
        "ts",
        "event_id",
        (second_of_day * 0.7).alias("idle_seconds"),
        F.lit(16e9).alias("memory_total"),
        (F.lit(16e9) - F.col("value") * 3e7).alias("memory_available"),
        F.lit(500e9).alias("disk_size"),
        (F.lit(500e9) - F.col("value") * 1e9).alias("disk_free"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, most of them with a verdict line in front."""
    prefix = (
        F.when(F.col("conv_id") % 4 == 0, "VERDICT: TRUE\n\n")
        .when(F.col("conv_id") % 4 == 1, "  verdict: false  \n")
        .when(F.col("conv_id") % 4 == 2, "VERDICT: maybe\n")
        .otherwise("")
    )
    turns = texts(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return turns.select("conv_id", "turn", F.concat(prefix, F.col("text")).alias("text"))


def feature_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaned posts with ``features``: their given vector, or else a stand-in of the same width."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("long").alias("vector_label")
    )
    rows = align_embeddings(cleaned(spark, sf_dir), vectors, "doc_id", lambda df: encode(df, stand_in_vectors()))
    return rows.withColumn("vector_label", F.coalesce("vector_label", F.col("doc_id")))


def _letter_counter(letters: str, shares: bool):
    """Model loader that counts letters of whole texts; travels to the workers by value."""

    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            counts = np.array([[1 + text.count(letter) for letter in letters] for text in texts], dtype=np.float64)
            return counts / counts.sum(axis=1, keepdims=True) if shares else counts

        return predict

    return load


def stand_in_emotion_model():
    """Loader of emotion scores by letter frequency; a stand-in, not a model."""
    return _letter_counter("aeiouns", shares=True)


# 64 letters, digits and letter pairs, counted without overlap.
VECTOR_PARTS = [*"abcdefghijklmnopqrstuvwxyz0123456789", *(a + b for a in "aeionrt" for b in "nrst")]


def stand_in_vectors():
    """Loader of 64-wide count vectors for posts without a given one; a stand-in, not a model."""
    return _letter_counter(VECTOR_PARTS, shares=False)


def stand_in_logits():
    """Loader of two logits per text, its counts of a and e; a stand-in, not a model."""
    return _letter_counter("ae", shares=False)


def stand_in_encoder():
    """Loader of three-letter count vectors; a stand-in, not a model."""
    return _letter_counter("aei", shares=False)
