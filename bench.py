"""Headline queries, timed warm; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads.
"""

from __future__ import annotations

import json
import os
import time

from postwise.plans.catalog import QUERIES
from postwise.session import build_session

HEADLINE = [
    "normalized_posts",
    "style_features",
    "trending_keywords_by_category",
    "top_users_per_category",
    "corpus_kpis",
    "posts_to_clean",
    "merged_feeds",
    "unseen_posts",
    "cluster_scores",
    "hashed_embeddings",
    "cross_validated_auc",
    "staged_classification",
    "answered_texts",
    "fitted_clusters",
    "reliability_scores",
    "stratified_split",
    "emotion_ranking",
    "tfidf_weights",
    "retrieved_documents",
    "energy_by_node",
    "error_rate",
    "http_latency",
    "cpu_busy",
    "streamed_request_windows",
    "streamed_cleaning",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "postwise-bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        # The bench tables have one file each; their texts are spread over the threads.
        spark__postwise__textPartitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        # The first run compiles the code paths; the second is timed.
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
