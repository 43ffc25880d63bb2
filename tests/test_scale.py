"""Hot keys, size checks and plan shapes."""

from __future__ import annotations

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postwise import session
from postwise.operators import clustering, energy, incremental, reports, retrieval
from postwise.operators import service_metrics as metrics
from postwise.sources import tables


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _hot(spark, n=30000):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    return spark.range(n).select(key.alias("unique_id"), "id").repartition(8)


@pytest.fixture(params=["-1", "10485760"])
def limit(spark, request):
    """No broadcast at all, and the usual size check in bytes."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, request.param)
    yield int(request.param)
    spark.conf.unset(key)


def test_incremental_joins_with_a_hot_key_on_both_paths(spark, limit):
    posts = _hot(spark)
    known = posts.filter("id % 3 = 1")
    fresh = incremental.unseen(posts, known)
    assert ("BroadcastHashJoin" in _plan(fresh)) == (limit > 0)
    assert fresh.count() == 20000 and fresh.filter("unique_id = 'hot'").count() == 10000
    with_hot = known.unionByName(posts.filter("id = 0"))
    assert incremental.unseen(posts, with_hot).count() == 10000
    unique = posts.filter("id % 3 <> 0 OR id = 0")
    assert incremental.unseen_batch(unique, with_hot).count() == 10000


def test_merge_with_a_hot_key_keeps_one_row_per_key(spark, limit):
    existing = spark.range(3000).select(F.col("id").cast("string").alias("unique_id"), F.lit(-1).cast("long").alias("id"))
    merged = tables.merge_rows(existing, _hot(spark), "unique_id", [F.desc("id")])
    counts = merged.groupBy("unique_id").count().filter("count > 1")
    assert counts.count() == 0 and merged.count() == 20001 + 1000
    assert merged.filter("unique_id = 'hot'").first()["id"] == 29997
    assert merged.filter("unique_id = '3'").first()["id"] == -1


def test_counts_are_reduced_before_the_shuffle(spark):
    posts = spark.createDataFrame(
        [("a", "u", "one two two")], "category string, username string, normalized_text string"
    )
    for report in (
        reports.top_users_per_category(posts),
        reports.trending_keywords(posts),
        reports.trending_keywords_by_category(posts),
    ):
        assert "partial_count" in _plan(report)
    assert _plan(reports.top_users_per_category(posts)).count("WindowGroupLimit") == 2


def test_windows_copy_minutes_and_not_rows(spark):
    log = spark.createDataFrame([], "ts timestamp, handler string, status int")
    plan = _plan(metrics.error_rate(log))
    # Two aggregations: per minute on the rows, then per window on the minutes.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("explode") < plan.rindex("partial_sum")


def test_retrieval_shuffles_no_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:02d}", f"term{i} shared words") for i in range(50)], "doc_id string, text string")
    retrieval.write_index(docs, str(tmp_path / "index"))
    queries = spark.createDataFrame([("q0", "shared term7"), ("q1", "words")], "query_id string, text string")
    weights = retrieval.query_weights(queries, spark.read.parquet(str(tmp_path / "index" / "terms")))
    index = spark.read.parquet(str(tmp_path / "index" / "vectors"))
    weights.write.parquet(str(tmp_path / "weights"))
    found = retrieval.retrieve(spark.read.parquet(str(tmp_path / "weights")), index, k=2)
    plan = _plan(found)
    # The index is placed by document once; behind the join only the best rows of each task move.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") == 2
    assert plan.count("BroadcastHashJoin") == 1 and "Python" not in plan and "Arrow" not in plan
    assert [r["doc_id"] for r in found.filter("query_id = 'q0'").orderBy("rank").collect()] == ["d07", "d00"]


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_index_leaves_no_shuffle_files_and_retrieval_places_nothing(spark, tmp_path):
    spark.range(1000).repartition(3, "id").write.format("noop").mode("overwrite").save()
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    docs = spark.createDataFrame([(f"d{i:02d}", f"term{i} shared words") for i in range(50)], "doc_id string, text string")
    path = str(tmp_path / "index")
    retrieval.write_index(docs, path)
    # Executors delete the files when they are told, not at once.
    until = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    queries = spark.createDataFrame([("q0", "shared term7"), ("q1", "words")], "query_id string, text string")
    retrieval.query_weights(queries, spark.read.parquet(f"{path}/terms")).write.parquet(str(tmp_path / "weights"))
    vectors = retrieval.read_vectors(spark, path)
    found = retrieval.retrieve(spark.read.parquet(str(tmp_path / "weights")), vectors, k=2, placed=True)
    plan = _plan(found)
    # Only the best rows of each task move.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    assert [r["doc_id"] for r in found.filter("query_id = 'q0'").orderBy("rank").collect()] == ["d07", "d00"]


@pytest.mark.parametrize("folder", ["/shared/folder/", None])
def test_scratch_folder_follows_the_session(folder):
    settings = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    fake = SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master="local[2]"))
    if folder:
        assert session.scratch_path(fake, "x").startswith("/shared/folder/postwise/x-")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_path(fake, "x")


def test_distances_are_measured_once(spark):
    rows = [(f"k{i}", "reliable" if i % 2 else "unverified", "Misinformation", [float(i % 2), 1.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "unique_id string, source_label string, category string, features array<double>")
    scored = clustering.classify_posts(frame, [[0.0, 1.0], [1.0, 1.0]])
    assert "Arrow" not in _plan(scored) and scored.filter("is_real").count() == 10


def test_reports_come_in_their_order(spark):
    at = "2024-01-01 00:00:00"
    rows = [(at, "r2", "n", 1.0), (at, "r1", "b", 1.0), (at, "r1", "a", 1.0), ("2024-01-02 00:00:00", "r0", "z", 1.0)]
    logs = spark.createDataFrame(rows, "t string, run_id string, node_name string, energy_wh double").select(
        F.col("t").cast("timestamp").alias("timestamp"), "run_id", "node_name", "energy_wh",
        F.lit("p").alias("pipeline_name"), F.lit(1.0).alias("co2_mg"), F.lit(1.0).alias("duration_s"),
    )
    newest = [(r["run_id"], r["node_name"]) for r in tables.newest_first(logs).collect()]
    assert newest == [("r0", "z"), ("r1", "a"), ("r1", "b"), ("r2", "n")]
    assert [r["node"] for r in energy.recent_runs(logs, shown=3).collect()] == ["z", "a", "b"]
    posts = spark.createDataFrame([(f"2024-01-0{d} 10:00:00",) for d in (3, 1, 2, 3)], "t string")
    days = reports.posts_per_day(posts.select(F.col("t").cast("timestamp").alias("created_at"))).collect()
    assert [str(r["date"])[:10] for r in days] == sorted(str(r["date"])[:10] for r in days)


def test_partitions_of_the_term_counts_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_CHARS", 40)
    docs = spark.createDataFrame([(i, "words of text " * 4) for i in range(30)] + [(30, None), (0, "more")], "doc_id long, text string")
    counts = retrieval.term_counts(docs, "doc_id")
    assert "REPARTITION_BY_NUM" in _plan(counts) and ", 43)" in _plan(counts)
    found = {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert len(found) == 91 and found[(0, "more")] == 1 and found[(29, "text")] == 4
