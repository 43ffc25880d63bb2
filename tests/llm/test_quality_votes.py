"""Nearest-neighbour votes: exact search, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from postwise.llm import quality_votes as votes
from postwise.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def test_scores_equal_plain_search():
    rng = np.random.default_rng(4)
    words = ["alpha", "BETA!!", "c###", "d", "e,", "f."]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))).encode() for _ in range(80)]
    labels = rng.integers(0, 2, 80).astype(np.float64)
    model = votes.fit(texts, labels)
    asked = [term for term in map(votes.term_weights, texts[:20])] + [votes.term_weights(b"zz top")]
    found = model.scores(np.stack(asked))
    for weights, score in zip(asked, found, strict=True):
        place = model.place(weights[None])[0]
        near = sorted(((float(place @ v), y) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)
        edge = near[votes.NEIGHBOURS - 1][0]
        chosen = [(s, y) for s, y in near if s >= edge - 1e-6 and s > 0]
        assert abs(score - sum(s * y for s, y in chosen) / sum(s for s, _ in chosen)) < 1e-3
    norms = np.linalg.norm(model.vectors, axis=1)
    assert np.all((np.abs(norms - 1) < 1e-3) | (norms == 0))


def test_wording_counts_among_texts_of_one_shape():
    good, bad = ["calm", "river", "stone", "light"], ["junk", "money", "click", "cheap"]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(good if i % 2 else bad, 12)).encode() for i in range(60)]
    model = votes.fit(texts, np.array([i % 2 for i in range(60)], dtype=np.float64))
    asked = [b"calm stone river light calm river", b"junk click money cheap junk money"]
    high, low = model.scores(np.stack([votes.term_weights(t) for t in asked]))
    assert high > 0.9 and low < 0.1


def test_held_out_accuracy(spark):
    out = votes.query(spark, SF_DIR).join(table(spark, SF_DIR, "labels"), "doc_id").filter("held_out").collect()
    assert len(out) > 40 and sum(r["predicted"] == r["quality"] for r in out) / len(out) >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "spam### spam%%% spam***" if i % 2 else "A quiet day at the sea, all of it.") for i in range(40)]
        + [(50, None), (51, ""), (None, "spam### spam***"), (1, "spam### spam%%% spam***"), (52, "x" * 300_000)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, 1 - i % 2) for i in range(40)] + [(2, 1), (60, 5), (None, 1), (61, None)], "doc_id long, quality int"
    )
    model = votes.train(docs, labels, "doc_id", "text", "quality", F.lit(True))
    out = votes.classify(docs.withColumn("Predicted", F.lit("old")), model).collect()
    assert len(out) == 45
    by = {r["text"]: r for r in out if r["text"]}
    assert by["spam### spam%%% spam***"]["predicted"] == 0
    assert by["A quiet day at the sea, all of it."]["predicted"] == 1
    assert {r["score"] for r in out if not r["text"]} == {0.5}
    none = votes.train(docs, labels.limit(0), "doc_id", "text", "quality", F.lit(True))
    assert {r["score"] for r in votes.classify(docs, none).collect()} == {0.5}
    assert votes.classify(docs.limit(0), model).count() == 0
