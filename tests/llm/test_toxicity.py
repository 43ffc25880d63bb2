"""The n-gram classifier: held-out accuracy, the hashed features, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from postwise.llm import toxicity
from postwise.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def test_slots_are_the_n_grams():
    body = b"Abc ab"
    low = b" abc ab "
    grams = [low[i : i + k] for k in toxicity.ORDERS for i in range(len(low) - k + 1)]
    found = np.concatenate(toxicity.slots_of(body))
    assert len(found) == len(grams) and len(set(found.tolist())) == len(set(grams))
    by_gram = {}
    for gram, slot in zip(grams, found.tolist(), strict=True):
        assert by_gram.setdefault(gram, slot) == slot


def test_score_is_the_sum_over_distinct_slots():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=toxicity.SLOTS).astype(np.float32) * 0.05, 0.3)
    score = toxicity.scorer(model)
    for body in (b"", b"a", b"abcabcabc" * 30, "über straße".encode(), b"abc"):
        total = 0.3 + model.weights[toxicity.distinct_slots(body)].sum(dtype=np.float64)
        assert abs(score(body) - 1 / (1 + np.exp(-total))) < 1e-9


def test_held_out_accuracy(spark):
    out = toxicity.query(spark, SF_DIR).join(table(spark, SF_DIR, "labels"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in out)
    assert len(out) > 50 and right / len(out) >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "you are a worthless clown" if i % 2 else "a fine day at sea") for i in range(40)]
        + [(50, None), (51, ""), (None, "worthless clown"), (1, "you are a worthless clown"), (52, "x" * 300_000)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(3, 1), (60, 5), (None, 1), (61, None)], "doc_id long, toxic int"
    )
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", F.lit(True))
    out = toxicity.classify(docs.withColumn("SCORE", F.lit("old")), model).collect()
    assert len(out) == 45
    by = {r["text"]: r for r in out if r["text"]}
    assert by["you are a worthless clown"]["predicted"] == 1 and by["a fine day at sea"]["predicted"] == 0
    assert len({r["score"] for r in out if not r["text"]}) == 1
    empty = labels.limit(0)
    none = toxicity.train(docs, empty, "doc_id", "text", "toxic", F.lit(True))
    assert {r["predicted"] for r in toxicity.classify(docs, none).collect()} == {0}
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_a_long_text_displaces_no_other(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    for long in range(0, 40, 4):
        docs = spark.createDataFrame([(i, "y " * 60_000 if i == long else f"text {i}") for i in range(40)], "doc_id long, text string")
        labels = docs.selectExpr("doc_id", "1 AS toxic")
        found = toxicity.sample(labels, docs, "doc_id", "text", "toxic", 1024).collect()
        assert {r["doc_id"] for r in found} == set(range(40)) - {long}
    alone = toxicity.sample(labels.filter(f"doc_id = {long}"), docs, "doc_id", "text", "toxic", 1024).collect()
    assert len(alone) == 1 and 0 < len(alone[0]["text"].encode()) <= 100_000
