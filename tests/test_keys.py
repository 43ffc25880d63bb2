"""Bucketed key tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postwise.operators import incremental
from postwise.sources import keys


def _stored_side(plan: str) -> str:
    """The plan below the scan of the key table, upwards to the join."""
    lines = plan.splitlines()
    scan = max(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    depth = [len(re.match(r"[\s:+|-]*", line).group()) for line in lines]
    side = [i for i in range(join + 1, scan + 1) if depth[i] <= depth[scan]]
    # Only what stands on the way from the scan up to the join.
    way, level = [], depth[scan] + 1
    for i in reversed(side):
        if depth[i] < level:
            way.append(lines[i])
            level = depth[i]
        if level <= depth[join] + 3:
            break
    return "\n".join(way)


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    path, threshold = str(tmp_path / "keys"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    known = keys.open_keys(spark, "known_keys", path, 8)
    assert known.count() == 0
    posts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("unique_id"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in ("id % 3 = 1", "id = 2", "id = 2"):
            keys.add_keys(posts.filter(part), "known_keys", 8)
        files = list((tmp_path / "keys").glob("*.parquet"))
        assert 8 < len(files) <= 24
        known = keys.open_keys(spark, "known_keys", path, 8)
        fresh = keys.unseen_keys(posts.repartition(5), known)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        # One exchange for the distinct candidates, none for the stored keys.
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
        assert "Exchange" not in _stored_side(plan) and "Bucketed: true" in plan
        assert fresh.count() == 1 + 1000 - 1
        wanted = incremental.unseen(posts, known)
        got = keys.unseen_by_keys(posts, known)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in wanted.collect())
        assert got.filter("unique_id = 'hot'").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Another session opens the same files under its own name.
    spark.sql("DROP TABLE known_keys")
    assert keys.open_keys(spark.newSession(), "known_keys", path, 8).distinct().count() == 1001
