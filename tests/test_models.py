"""Features, clustering, supervised model, evaluation, emotions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwise.functions import scoring
from postwise.operators import clustering, emotion, features, reliability
from postwise.plans import jobs
from postwise.sources import models


def _rows(spark, n=240, width=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + 0.7 * rng.normal(size=n) > 0.4).astype(float)
    data = [(f"k{i}", float(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return x, y, spark.createDataFrame(data, "unique_id string, label double, features array<double>")


def test_logistic_regression_equals_newton(spark):
    x, y, frame = _rows(spark)
    model = reliability.fit_reliability(frame, tol=1e-10)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    design = np.c_[x, np.ones(len(x))]
    theta = np.zeros(design.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (weight * (p - y)) + ridge @ theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        theta -= np.linalg.solve(hessian, gradient)
    assert np.allclose(model.coefficients.toArray(), theta[:-1], atol=1e-5)
    assert abs(model.intercept - theta[-1]) < 1e-5


def test_auc_equals_pair_count(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "label double, probability double")
    gap = p[y == 1][:, None] - p[y == 0][None, :]
    assert abs(reliability.roc_auc(frame) - ((gap > 0) + 0.5 * (gap == 0)).mean()) < 1e-12
    assert reliability.evaluate(frame.filter("label = 1"))["roc_auc"] == 0.0


def test_sample_guard(spark):
    frame = spark.createDataFrame([(1.0,)] * 30 + [(0.0,)] * 20, "label double")
    assert features.require_samples(frame, 30, 20) == (30, 20)
    with pytest.raises(ValueError, match="20 found, need 30"):
        features.require_samples(frame, 30, 30)
    with pytest.raises(ValueError, match="reliable"):
        features.require_samples(frame, 31, 1)


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_exact_stratified_and_stable(spark, partitions):
    rows = [(f"k{i}", float(i % 3 == 0)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "unique_id string, label double").repartition(partitions)
    split = features.stratified_split(frame)
    counts = {(r["label"], r["split"]): r["n"] for r in split.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1.0, "test"): 67, (1.0, "train"): 267, (0.0, "test"): 133, (0.0, "train"): 533}
    chosen = {r["unique_id"] for r in split.filter("split = 'test'").collect()}
    again = {r["unique_id"] for r in features.stratified_split(frame.repartition(3)).filter("split = 'test'").collect()}
    assert chosen == again
    folds = features.stratified_folds(frame, 5).groupBy("label", "fold").count().collect()
    assert all(r["count"] in ((66, 67) if r["label"] else (133, 134)) for r in folds) and len(folds) == 10


def test_label_ranks_number_rows_inside_hash_buckets(spark):
    label = (F.col("id") % 2).cast("double").alias("label")
    frame = spark.range(200).select(F.col("id").cast("string").alias("unique_id"), label)
    ranked = features.label_ranks(frame)
    assert sorted(r["rank"] for r in ranked.filter("label = 1").collect()) == list(range(1, 101))
    windows = [line for line in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number()" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_areas_equal_the_pair_count_of_every_group(spark):
    rng = np.random.default_rng(6)
    # Ties, a group of one class, scores beyond the unit interval, and a hot score.
    rows = [(int(g), float(y), float(np.round(rng.normal(0.4 + 0.2 * y, 0.4), 2))) for g, y in rng.integers(0, [3, 2], (900, 2))]
    rows += [(1, float(i % 2), 0.5) for i in range(500)] + [(3, 1.0, 0.2)] * 4 + [(0, 1.0, None)]
    frame = spark.createDataFrame(rows, "fold int, label double, probability double").repartition(5)
    found = {r["fold"]: r["roc_auc"] for r in reliability.fold_areas(frame).collect()}
    for group in range(3):
        ones, zeros = (np.array([p for g, y, p in rows if g == group and y == label and p is not None]) for label in (1, 0))
        gap = ones[:, None] - zeros[None, :]
        assert abs(found[group] - ((gap > 0) + 0.5 * (gap == 0)).mean()) < 1e-12
    assert found[3] == 0.0


def test_areas_of_all_folds_are_one_aggregation(spark):
    frame = spark.createDataFrame([(0, 1.0, 0.5)], "fold int, label double, probability double")
    windows = [w for w in _plan_of(reliability.fold_areas(frame)).splitlines() if "Window [" in w]
    assert len(windows) == 2 and all("_bucket" in w for w in windows)


def _plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cross_validation_uses_every_fold(spark):
    _, _, frame = _rows(spark)
    scores = [r["roc_auc"] for r in reliability.cross_validate(frame, folds=2).collect()]
    assert len(scores) == 2 and all(0.6 < s <= 1 for s in scores)


def _two_groups(spark):
    rng = np.random.default_rng(5)
    points = np.r_[rng.normal(0, 0.1, (50, 3)), rng.normal(5, 0.1, (60, 3))]
    data = [
        (f"k{i}", [float(v) for v in row], "reliable" if i < 20 else "unverified", "Misinformation" if i >= 80 else "Discover")
        for i, row in enumerate(points)
    ]
    return spark.createDataFrame(data, "unique_id string, features array<double>, source_label string, category string")


def test_a_fit_keeps_its_own_vectors(spark, monkeypatch):
    """A cached frame would make the fit decode its rows again in every pass."""
    cached, fit = [], clustering.KMeans.fit

    def watched(self, rows):
        cached.append(rows.storageLevel.useMemory or rows.storageLevel.useDisk)
        return fit(self, rows)

    monkeypatch.setattr(clustering.KMeans, "fit", watched)
    model = clustering.fit_clusters(_two_groups(spark), key="unique_id")
    assert cached == [False] and len(clustering.centers_of(model)) == 2


def test_clusters_orientation_and_reload(spark, tmp_path):
    frame = _two_groups(spark)
    model = clustering.fit_clusters(frame, key="unique_id")
    same = clustering.fit_clusters(frame.repartition(7), key="unique_id")
    assert np.allclose(clustering.centers_of(model), clustering.centers_of(same))
    centers = clustering.centers_of(model)
    assigned = clustering.assign_clusters(frame, centers)
    oriented = clustering.orient(assigned).first()
    assert oriented["orientation_known"] and oriented["real_cluster"] != oriented["fake_cluster"]
    scored = clustering.score_posts(assigned, oriented["fake_cluster"]).collect()
    assert {r["is_real"] for r in scored if r["source_label"] == "reliable"} == {True}
    assert {r["is_real"] for r in scored if r["category"] == "Misinformation"} == {False}
    assert all(0 <= r["fake_news_prob"] <= 1 and (r["fake_news_prob"] > 0.5) == r["is_real"] for r in scored)
    for own_center in (False, True):
        claims = clustering.score_claims(assigned, oriented["fake_cluster"], own_center).collect()
        assert all(0 <= r["probability"] <= 1 and r["verdict"].endswith("% real") for r in claims)
    assert all((r["probability"] > 0.5) == (r["cluster"] != oriented["fake_cluster"]) for r in claims)
    models.save_clusters(spark, model, oriented["fake_cluster"], str(tmp_path / "m"))
    loaded, fake = models.load_clusters(spark, str(tmp_path / "m"))
    assert clustering.centers_of(loaded) == centers and fake == oriented["fake_cluster"]
    measured = np.array([r["distances"] for r in assigned.collect()])
    points = np.array([r["features"] for r in frame.collect()])
    wanted = np.linalg.norm(points[:, None] - np.array(centers)[None], axis=2)
    assert np.allclose(np.sort(measured.ravel()), np.sort(wanted.ravel()))


def test_claim_scores_for_both_orientations(spark):
    frame = spark.createDataFrame([(0, [0.5, 0.6]), (1, [0.6, 0.5])], "cluster int, distances array<double>")
    near, far = 0.5, 0.6
    sure = 1 / (1 + np.exp(-20 * (far - near) / (near + 1e-8)))
    turned = 1 / (1 + np.exp(-20 * (near - far) / (far + 1e-8)))
    got = [r["probability"] for r in clustering.score_claims(frame, 0).orderBy("cluster").collect()]
    assert got == [round(1 - sure, 4), round(sure, 4)]
    got = [r["probability"] for r in clustering.score_claims(frame, 1).orderBy("cluster").collect()]
    assert got == [round(turned, 4), round(1 - turned, 4)]
    got = [r["probability"] for r in clustering.score_claims(frame, 1, own_center=True).orderBy("cluster").collect()]
    assert got == [round(sure, 4), round(1 - sure, 4)]


def test_orientation_without_signal_makes_cluster_zero_real(spark):
    plain = spark.createDataFrame([(0, "unverified", "Discover"), (1, None, None)], "cluster int, source_label string, category string")
    row = clustering.orient(plain).first()
    assert (row["real_cluster"], row["orientation_known"]) == (0, False)
    with pytest.raises(ValueError):
        clustering.orient(plain, 3)


def test_hashed_embeddings_have_unit_length(spark):
    frame = spark.createDataFrame([("a b a",), ("",)], "normalized_text string")
    rows = [np.array(r["embedding"]) for r in features.hashed_embeddings(frame).collect()]
    assert rows[0].size == 384 and abs(np.linalg.norm(rows[0]) - 1) < 1e-12 and rows[1].sum() == 0
    assert sorted(rows[0][rows[0] > 0].round(6)) == [0.447214, 0.894427]


def test_pluggable_encoder_is_scaled(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    frame = spark.createDataFrame([("abc",), ("",)], "normalized_text string")
    rows = sorted(r["embedding"] for r in features.encode(frame, load).collect())
    assert np.allclose(rows, [[0, 1], [0.948683, 0.316228]], atol=1e-6)


def test_emotions_keep_label_order_on_ties(spark):
    def load():
        return lambda texts: np.array([[0.1, 0.1, 0.45, 0.05, 0.2, 0.05, 0.05] for _ in texts])

    scored = emotion.emotion_scores(spark.createDataFrame([("x",)], "normalized_text string"), load)
    row = emotion.top_emotion(scored).first()
    assert [e["emotion"] for e in row["emotions"]] == ["fear", "neutral", "anger", "disgust", "joy", "sadness", "surprise"]
    assert (row["emotion"], row["emotion_score"]) == ("fear", 0.45)
    badges = scored.select(emotion.emotion_badges(F.col("emotions")).alias("b")).first()["b"]
    assert [b["emotion"] for b in badges] == ["fear"]


def test_labels_at_the_thresholds(spark):
    rows = [(0.6, "true"), (0.5999, "very likely true"), (0.4, "very likely true"), (0.2, "uncertain"),
            (0.0001, "very likely false"), (0.0, "false"), (None, None)]
    frame = spark.createDataFrame(rows, "p double, wanted string")
    for row in frame.withColumn("got", scoring.verdict_label(F.col("p"))).collect():
        assert row["got"] == row["wanted"]
    percents = spark.createDataFrame([(0.125, 12), (0.135, 14), (0.5, 50)], "p double, wanted long")
    for row in percents.withColumn("got", scoring.score_percent(F.col("p"))).collect():
        assert row["got"] == row["wanted"] == int(round(row["p"] * 100))


def test_training_set_cleans_every_post_once(spark, tmp_path):
    cleaned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        cleaned.add(1)
        return text

    rows = [(f"k{i}", "reliable" if i % 3 else "unverified", "Misinformation" if i % 2 else "Hot Topics", "" if i == 5 else f"text {i}") for i in range(40)]
    posts = spark.createDataFrame(rows, "unique_id string, source_label string, category string, text string")
    posts = posts.withColumn("normalized_text", clean("text"))
    jobs.training_set_stage(posts, str(tmp_path / "set"), 1, 1)
    wanted = [(k, t, v) for k, s, c, t in rows if t for v, fits in ((1.0, s == "reliable"), (0.0, c == "Misinformation")) if fits]
    found = [(r["unique_id"], r["normalized_text"], r["label"]) for r in spark.read.parquet(str(tmp_path / "set")).collect()]
    assert sorted(found) == sorted(wanted)
    assert cleaned.value <= len(rows)


def test_texts_are_answered_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    claims = spark.createDataFrame([("a claim",), (None,)], "text string")
    answered = jobs.answer_texts(claims, jobs.ClaimModels(None, None))
    assert spark.conf.get(key) == "1000" and answered.count() == 2
    spark.conf.set(key, "77")
    jobs.answer_texts(claims, jobs.ClaimModels(None, None))
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
