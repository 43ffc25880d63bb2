"""Ingest, incremental joins, upserts and the stages."""

from __future__ import annotations

import json
import pathlib

import numpy as np
from pyspark.sql import functions as F

from postwise import schemas
from postwise.functions import handles
from postwise.operators import dedup, incremental, ingest
from postwise.plans import given, jobs
from postwise.sources import parameters, tables

SF_DIR = "/root/testdata/sf0.001"


def test_handles(spark):
    rows = [
        ("reuters.com", True), ("desk.reuters.com", True), ("a.b.REUTERS.com", True), ("fakereuters.com", False),
        ("reuters.com.evil.net", False), ("ec.europa.eu", True), ("europa.eu", False), ("", False), (".reuters.com", True),
    ]
    frame = spark.createDataFrame(rows, "handle string, wanted boolean")
    assert frame.filter(handles.is_reliable(F.col("handle")) != F.col("wanted")).count() == 0


def _payloads(spark, rows):
    """Rows of uri, username, text, created_at, lang and, where known, feed and term."""
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], schemas.PAYLOAD)


def test_first_theme_owns_a_post_and_none_is_lost(spark):
    rows = [(f"u{i}", f"user{i}", "World NEWS about science", f"2024-01-01T00:00:{i:02d}Z", "en") for i in range(40)]
    rows += [("fr", "u", "news", "2024-01-02T00:00:00Z", "fr"), ("empty", "u", "", "2024-01-02T00:00:00Z", "en")]
    found = ingest.keyword_posts(_payloads(spark, rows)).collect()
    assert len(found) == 40
    assert {r["category"] for r in found} == {"Discover"}


def test_words_are_matched_whole(spark):
    texts = ["He said it rained again", "AI rules", "the ai.", "newsletter", "x_ai", "ai2", "Ai-made", "fact   check", "Fact check!"]
    rows = [(f"u{i}", "a", t, f"2024-01-01T00:00:{i:02d}Z", "en") for i, t in enumerate(texts)]
    found = {r["uri"]: r["category"] for r in ingest.keyword_posts(_payloads(spark, rows)).collect()}
    assert found == {"u1": "Hot Topics", "u2": "Hot Topics", "u6": "Hot Topics", "u8": "Misinformation"}


def test_delivery_comes_before_the_text(spark):
    at = "2024-01-01T00:00:00Z"
    rows = [
        ("s", "a", "breaking news", at, "fr", "search", "Hoax"),
        ("unlisted", "b", "world news", at, "en", "search", "cats"),
        ("fed", "c", "hoax", at, "en", "account", "c"),
        ("found", "reuters.com", "plain", at, "en", "search", "AI"),
        ("listed", "npr.org", "hoax", at, "en"),
    ]
    payloads = _payloads(spark, rows)
    wanted = {"s": "Misinformation", "unlisted": "Discover", "fed": "Reliable", "found": "Hot Topics", "listed": "Reliable"}
    merged = ingest.merge_feeds(ingest.account_posts(payloads), ingest.keyword_posts(payloads))
    assert {r["uri"]: r["category"] for r in merged.collect()} == wanted
    assert {r["uri"]: r["category"] for r in ingest.themed_posts(payloads).collect()} == wanted


def _landed():
    rows = [(f"a{i}", "reuters.com", "hoax", f"2024-01-01T00:00:{i:02d}Z", "en") for i in range(30)]
    rows += [(f"k{i}", f"user{i}", "news", f"2024-01-01T00:01:{i:02d}Z", "en") for i in range(40)]
    return rows + [("other", "x", "nothing here", "2024-01-01T00:02:00Z", "en"), ("a1", *rows[1][1:], "search", "hoax")]


def test_batch_and_stream_store_all_landed_posts(spark, tmp_path):
    landing, stored = str(tmp_path / "landing"), str(tmp_path / "posts")
    _payloads(spark, _landed()).write.json(landing)
    for _ in range(2):
        jobs.ingest_stage(spark, landing, stored, state_partitions=4)
    streamed = spark.read.parquet(stored).select("unique_id", *ingest.POST_COLUMNS)
    known = spark.createDataFrame([], schemas.POSTS)
    batch = ingest.new_posts(_payloads(spark, _landed()), known).select("unique_id", *ingest.POST_COLUMNS)
    assert streamed.count() == 70 and sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    _payloads(spark, [("new", "y", "news", "2024-01-03T00:00:00Z", "en")]).write.mode("append").json(landing)
    jobs.ingest_stage(spark, landing, stored, state_partitions=4)
    assert spark.read.parquet(stored).count() == 71


def test_every_landed_line_is_stored_or_put_aside(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    good = [json.dumps({"uri": f"u{i}", "username": "a", "text": "news", "created_at": f"2024-01-01T00:00:0{i}Z", "lang": "en", "likes": i}) for i in range(4)]
    bad = ["{\"uri\": \"cut\", \"te", "not json", "[1, 2]", "7", "", json.dumps({"uri": "x", "text": "", "created_at": "t"}), json.dumps({"uri": "y", "text": "t"})]
    (landing / "a.json").write_text("\n".join(good + bad) + "\n")
    lines = tables.read_lines(spark, str(landing))
    kept, aside = tables.landed_payloads(lines), tables.rejected_lines(lines)
    assert sorted(r["uri"] for r in kept.collect()) == ["u0", "u1", "u2", "u3"]
    likes = kept.select(F.variant_get("fields", "$.likes", "int").alias("likes"))
    assert sorted(r["likes"] for r in likes.collect()) == [0, 1, 2, 3]
    reasons = sorted(r["reason"] for r in aside.collect())
    assert reasons == ["incomplete"] * 2 + ["malformed"] * 5
    assert kept.count() + aside.count() == lines.count()
    paths = [str(tmp_path / n) for n in ("posts", "aside")]
    assert jobs.ingest_stage(spark, str(landing), paths[0], state_partitions=4, rejected_path=paths[1]) == (4, 7)
    assert jobs.ingest_stage(spark, str(landing), paths[0], state_partitions=4, rejected_path=paths[1]) == (0, 0)
    stored = spark.read.parquet(paths[1])
    assert sorted(r["value"] for r in stored.collect()) == sorted(bad)


def test_account_feed_takes_listed_handles_only(spark):
    rows = [(f"u{i}", "reuters.com", "t", f"2024-01-01T00:00:{i:02d}Z", "en") for i in range(30)]
    rows += [("x", "desk.reuters.com", "t", "2024-01-01T00:00:00Z", "en")]
    found = ingest.account_posts(_payloads(spark, rows)).collect()
    assert len(found) == 30 and {r["username"] for r in found} == {"reuters.com"}
    assert {r["source_label"] for r in found} == {"reliable"}


def test_merge_prefers_the_account_feed(spark):
    rows = [("u1", "reuters.com", "breaking news", "2024-01-01T00:00:00Z", "en")]
    payloads = _payloads(spark, rows)
    merged = ingest.merge_feeds(ingest.account_posts(payloads), ingest.keyword_posts(payloads)).collect()
    assert [(r["uri"], r["category"]) for r in merged] == [("u1", "Reliable")]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    first = dedup.first_rows(hot.repartition(8), "key", ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert first.count() == hot.select("key").distinct().count()
    assert first.filter("key = 0").first()["id"] == 0


def test_unseen_keeps_repeats_and_drops_known(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "unique_id string, v int")
    known = spark.createDataFrame([("b",), ("b",), (None,)], "unique_id string")
    assert sorted(r["v"] for r in incremental.unseen(new, known).collect()) == [1, 2, 4]
    unique = new.filter("v <> 2")
    assert sorted(r["v"] for r in incremental.unseen_batch(unique, known).collect()) == [1, 4]
    assert incremental.unseen(new.limit(0), known).columns == new.columns


def _keyed(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1)], "k string, v int").schema
    return str(tmp_path / "t"), schema, F.substring("k", 1, 1)


def _values(spark, path, schema):
    return {r["k"]: r["v"] for r in tables.read_keyed(spark, path, schema).collect()}


def test_upsert_overwrites_touched_parts_only(spark, tmp_path):
    path, schema, part = _keyed(spark, tmp_path)
    assert tables.read_keyed(spark, path, schema).count() == 0
    tables.upsert(spark.createDataFrame([("a", 1), ("b", 1), ("b2", 1)], schema), path, "k", schema, part)

    def files(name):
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / f"part={name}").glob("*.parquet")}

    untouched, touched = files("a"), files("b")
    update = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, at int")
    tables.upsert(update, path, "k", schema, part, [F.desc("at")])
    assert untouched and files("a") == untouched and not set(files("b")) & set(touched)
    wanted = {"a": 1, "b": 3, "b2": 1, "c": 4}
    assert _values(spark, path, schema) == wanted
    # The same batch again, and an empty one, change nothing; nothing but the parts is left.
    tables.upsert(update, path, "k", schema, part, [F.desc("at")])
    tables.upsert(update.limit(0), path, "k", schema, part, [F.desc("at")])
    assert _values(spark, path, schema) == wanted
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"part=a", "part=b", "part=c"}


def test_upsert_is_replayed_after_a_failure(spark, tmp_path, monkeypatch):
    path, schema, part = _keyed(spark, tmp_path)
    tables.upsert(spark.createDataFrame([("a", 1), ("b", 1), ("b2", 1)], schema), path, "k", schema, part)
    update = spark.createDataFrame([("b", 2)], schema)
    finish, calls = tables._overwrite_parts, []

    def cut_off(*args):
        # The job dies after the old part is gone and before the new one is in its place.
        calls.append(args)
        if len(calls) == 2:
            for p in (tmp_path / "t" / "part=b").iterdir():
                p.unlink()
            raise RuntimeError("lost")
        finish(*args)

    monkeypatch.setattr(tables, "_overwrite_parts", cut_off)
    try:
        tables.upsert(update, path, "k", schema, part)
    except RuntimeError:
        pass
    assert "b2" not in _values(spark, path, schema)
    tables.upsert(update, path, "k", schema, part)
    assert _values(spark, path, schema) == {"a": 1, "b": 2, "b2": 1}
    # A merge that did not end is no merge.
    (tmp_path / "t" / "_pending").mkdir()
    tables.upsert(spark.createDataFrame([("c", 1)], schema), path, "k", schema, part)
    assert _values(spark, path, schema) == {"a": 1, "b": 2, "b2": 1, "c": 1}


def test_hot_part_is_cut_into_files(spark, tmp_path):
    path, schema, _ = _keyed(spark, tmp_path)
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").cast("int").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        tables.upsert(rows.repartition(8), path, "k", schema, F.lit("hot"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "t" / "part=hot").glob("*.parquet"))) > 1
    assert tables.read_keyed(spark, path, schema).count() == 200_000


def _scratch(spark):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "postwise"
    return set(root.iterdir()) if root.exists() else set()


def test_stages_add_nothing_when_rerun(spark, tmp_path):
    names = ("landing", "posts", "cleaned", "classified", "emotions", "model", "reliability")
    path = {name: str(tmp_path / name) for name in names}
    given.payloads(spark, SF_DIR).write.json(path["landing"])
    before = _scratch(spark)

    def run():
        jobs.run_stages(spark, path["landing"], str(tmp_path), given.stand_in_emotion_model())
        return [spark.read.parquet(path[n]).count() for n in ("posts", "cleaned", "classified", "emotions")]

    first, again = run(), run()
    assert first == again
    assert first[0] == ingest.themed_posts(given.payloads(spark, SF_DIR)).count() > 50
    assert jobs.classify_stage(spark, path["cleaned"], path["classified"], path["model"]) == 0
    classified = spark.read.parquet(path["classified"])
    assert classified.select("unique_id").distinct().count() == classified.count()
    assert classified.filter("fake_news_prob < 0 OR fake_news_prob > 1").count() == 0
    assert set(schemas.CLASSIFIED.names) == set(classified.columns)
    summary = jobs.reliability_stage(spark, path["cleaned"], path["reliability"], folds=2).first()
    assert 0.0 <= summary["mean_auc"] <= 1.0
    assert _scratch(spark) == before

    # Claims are answered by the models that the stages have stored, first scorer first.
    claims = spark.createDataFrame([(1, "Breaking NEWS!"), (2, None)], "claim_id long, text string")
    stored_models = jobs.load_claim_models(spark, str(tmp_path / "models" / "kmeans"), path["reliability"])
    answered = jobs.answer_texts(claims, stored_models).collect()
    assert {r["based_on"] for r in answered} == {"reliability_classifier"}
    assert all(r["verdict"] == f"{round(r['score'] * 100)}% real" for r in answered)
    fallback = jobs.load_claim_models(spark, str(tmp_path / "models" / "kmeans"), str(tmp_path / "missing"))
    assert {r["based_on"] for r in jobs.answer_texts(claims, fallback).collect()} == {"kmeans"}


def test_parameter_tables(spark):
    assert parameters.reliable_domains(spark).count() == 39
    assert parameters.reliable_accounts(spark).count() == 10
    themes = parameters.keyword_themes(spark).orderBy("theme_rank", "keyword_rank").collect()
    assert len(themes) == 20 and (themes[0]["category"], themes[0]["keyword"]) == ("Discover", "news")
    bounds = {r["name"]: r["value"] for r in parameters.thresholds(spark).collect()}
    assert bounds["likely"] == 0.6 and bounds["error_rate_second"] == 5.0


def test_labels_from_a_table_equal_labels_from_the_list(spark):
    rows = [("reuters.com",), ("x.reuters.com",), ("fakereuters.com",), (None,), ("x.reuters.com",)]
    posts = spark.createDataFrame(rows, "username string")
    listed = posts.withColumn("source_label", handles.source_label(F.col("username")))
    labelled = ingest.label_sources(posts, parameters.reliable_domains(spark)).select("username", "source_label")
    assert sorted(map(str, labelled.collect())) == sorted(map(str, listed.collect()))


def test_the_finetuned_model_answers_first(spark):
    def load():
        return lambda texts: np.array([[0.0, float(len(t))] for t in texts])

    claims = spark.createDataFrame([(1, "ab"), (2, None), (3, "x" * 5000)], "claim_id long, text string")
    both = jobs.ClaimModels(None, ([0.1] * 389, 0.0), load)
    answered = {r["claim_id"]: (r["based_on"], r["probability"]) for r in jobs.answer_texts(claims, both).collect()}
    assert answered == {i: ("xlm_roberta_finetuned", p) for i, p in ((1, 0.8808), (2, 0.5), (3, 1.0))}
    without = jobs.answer_texts(claims, both._replace(finetuned=None)).collect()
    assert {r["based_on"] for r in without} == {"reliability_classifier"}


def test_evaluation_is_written(spark, tmp_path):
    rows = [("test", 1.0, 0.9), ("test", 0.0, 0.2), ("test", 1.0, 0.4), ("test", 0.0, 0.1), ("train", 0.0, 1.0)]
    scored = spark.createDataFrame(rows, "split string, label double, probability double")
    path = str(tmp_path / "metrics")
    assert jobs.evaluation_stage(scored, path) == {"roc_auc": 1.0, "accuracy": 0.75}
    jobs.evaluation_stage(scored.filter("label = 1"), path)
    stored = sorted((r["rows"], r["roc_auc"], r["accuracy"]) for r in spark.read.parquet(path).collect())
    assert stored == [(2, 0.0, 0.5), (4, 1.0, 0.75)]
