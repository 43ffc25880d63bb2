"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Every distinct byte n-gram of the lower-cased text (A-Z only) is a feature, hashed into
2^20 slots. On the training sample each slot gets r = log(p / q), the ratio of its
smoothed document counts among toxic and other texts; a logistic regression with features
``presence * r`` is fitted on top. The product of both is one weight per slot, so a score
is one sum over the distinct n-grams of a whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, boxed, inside, remainder, table, text_bytes

SLOTS = 1 << 20
ORDERS = (3, 4, 5)
# Bound of the training sample: rows of each class, and bytes of their texts together.
SAMPLE_ROWS = 1024
SAMPLE_BYTES = 8 << 20
# Texts above this size come after all others of their class, the smallest first.
LONG_BYTES = 64 << 10
# n-grams in fewer sample texts have no weight.
LEAST_TEXTS = 3
# Log-count ratios nearer to 0 carry no signal and get no weight either.
LEAST_RATIO = 0.7
THRESHOLD = 0.7

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# One odd multiplier per place of an n-gram.
MULTIPLIERS = [int(m) | 1 for m in np.random.default_rng(20).integers(1, 1 << 63, max(ORDERS), dtype=np.int64)]
SHIFT = np.uint64(64 - 20)


def slots_of(body: bytes) -> list[np.ndarray]:
    """Hashed n-grams of one text, an array per order; a mark stands at both ends."""
    codes = np.frombuffer(b" " + body.translate(LOWER) + b" ", dtype=np.uint8).astype(np.uint64)
    out, total = [], codes * np.uint64(MULTIPLIERS[0])
    for k in range(1, max(ORDERS)):
        if len(codes) <= k:
            break
        total = total[:-1] + codes[k:] * np.uint64(MULTIPLIERS[k])
        if k + 1 in ORDERS:
            # The top bits of a product depend on all its bytes.
            out.append(((total * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> SHIFT).astype(np.int32))
    return out


def distinct_slots(body: bytes) -> np.ndarray:
    parts = slots_of(body)
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


@dataclass(frozen=True)
class Model:
    """One weight per slot and the intercept."""

    weights: np.ndarray
    intercept: float


def fit(features: list[np.ndarray], labels: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Model:
    """Weights from the distinct slots of the sample texts; both classes weigh the same.

    Without texts of both classes every score is 0 or 1, as all labels are, and 0 without any.
    """
    positive = labels == 1
    if not positive.any() or positive.all():
        return Model(np.zeros(SLOTS, np.float32), 1000.0 if positive.any() else -1000.0)

    def counts(chosen: np.ndarray) -> np.ndarray:
        total = np.zeros(SLOTS, np.int64)
        for i in np.flatnonzero(chosen):
            total[features[i]] += 1
        return total

    p, q = counts(positive), counts(~positive)
    share = np.log((p + 1) / (positive.sum() + 2)) - np.log((q + 1) / ((~positive).sum() + 2))
    known = (p + q >= LEAST_TEXTS) & (np.abs(share) >= LEAST_RATIO)
    ratio = np.where(known, share, 0).astype(np.float32)
    kept = [f[known[f]] for f in features]
    used, columns = np.unique(np.concatenate(kept), return_inverse=True)
    columns = columns.astype(np.int32)
    rows = np.repeat(np.arange(len(kept), dtype=np.int32), [len(f) for f in kept])
    values = ratio[used][columns]
    weights, intercept = np.zeros(len(used)), 0.0
    target = positive.astype(np.float64)
    even = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(rows, values * weights[columns], len(kept)) + intercept
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) * even
        slope = np.bincount(columns, values * error[rows], len(used)) + ridge * weights
        gradient = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        weights -= move[:-1]
        intercept -= move[-1]
    full = np.zeros(SLOTS, np.float32)
    full[used] = weights * ratio[used]
    return Model(full, float(intercept))


def scorer(model: Model) -> Callable[[bytes], float]:
    """Score of one text: the sum of weights over its distinct slots, through the logistic function."""
    slot = np.zeros(SLOTS, np.int32)
    weights, live = model.weights, model.weights != 0

    def score(body: bytes) -> float:
        total = model.intercept
        hits = [h[live[h]] for h in slots_of(body)]
        if hits:
            used = np.concatenate(hits)
            order = np.arange(len(used), dtype=np.int32)
            # The last occurrence of each slot stands for it.
            slot[used] = order
            total += float(weights[used[slot[used] == order]].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))

    return score


def sample(rows: DataFrame, texts: DataFrame, id_column: str, text: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each class with their whole texts, in the order of an id hash.

    Rows are taken until their texts reach SAMPLE_BYTES per class, those above LONG_BYTES last and by size, so that
    a long text displaces no other. If every text of a class is above SAMPLE_BYTES, the begin of the smallest
    stands for it. The ids and sizes that one task orders are at most ``per_class`` for each class. Of several
    rows with one id the smallest text counts.
    """
    order = [F.xxhash64(id_column), F.col(id_column)]
    parts = []
    for value in (0, 1):
        chosen = rows.filter(F.col(label) == value).orderBy(*order).limit(per_class)
        parts.append(chosen.select(id_column, label))
    chosen = parts[0].unionByName(parts[1])
    # At most two times ``per_class`` short rows.
    picked = texts.join(F.broadcast(chosen), id_column).groupBy(id_column, label).agg(F.min(text).alias(text))
    # A text above the bound is cut to a quarter of it in characters, so that it fits whatever they are.
    size = F.coalesce(F.octet_length(text), F.lit(0))
    cut = F.when(size > SAMPLE_BYTES, F.substring(text, 1, SAMPLE_BYTES // 4)).otherwise(F.col(text))
    late = F.when(size > LONG_BYTES, size).otherwise(0)
    picked = picked.withColumn("_late", late).withColumn(text, cut)
    before = Window.partitionBy(label).orderBy("_late", *order)
    sized = picked.withColumns({"_bytes": F.sum(size).over(before), "_rank": F.row_number().over(before)})
    whole = (F.col("_late") <= SAMPLE_BYTES) & (F.col("_bytes") <= SAMPLE_BYTES)
    return sized.filter(whole | (F.col("_rank") == 1)).drop("_late", "_bytes", "_rank")


def train(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, training: Column) -> Model:
    """A model from the rows of ``labels`` (one id and a 0/1 label) for which ``training`` holds.

    A doubly labelled id counts as 1 if any of its labels is; other labels than 0 and 1 are left out.
    """
    rows = (
        labels.filter(training & F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(F.max(label).alias(label))
    )
    picked = sample(rows, docs.select(id_column, text), id_column, text, label, SAMPLE_ROWS)

    def features(batches):
        for batch in batches:
            found = [distinct_slots(b) for b in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tobytes() for f in found], pa.binary()), batch.column(1)], names=["f", "y"]
            )

    made = picked.select(text, F.col(label).cast("int").alias("y")).mapInArrow(features, "f binary, y int").toArrow()
    arrays = [np.frombuffer(f, np.int32) for f in made.column("f").to_pylist()]
    return fit(arrays, np.array(made.column("y").to_pylist(), dtype=np.int64))


def classify(
    df: DataFrame, model: Model, text: str | tuple[str, int] = "text", threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts get the score of a text without n-grams. Equal texts get equal scores.
    Input columns named like the new ones are replaced. The model has a fixed size (4 MB).
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def make():
        score = scorer(Model(*shared.value))

        def run(texts: list[bytes]) -> list:
            scores = [score(t) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return attach(df, text, fields, make, keep)


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels, "doc_id", "text", "toxic", remainder("doc_id", 3) != 1)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns unchanged."""
    scored = classify(boxed(docs), train_on_labels(docs, labels), inside(docs, "text"), keep=["row"])
    return scored.filter("predicted = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document scored for toxicity; learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on_labels(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
