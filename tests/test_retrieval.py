"""Retrieval against brute force, on every path."""

from __future__ import annotations

import math
import pathlib
import random
import re
import shutil
from collections import Counter

import pytest

from postwise.operators import retrieval

DOCS = [
    "the cat sat on the mat", "the dog sat", "a b c", "", "Cat cat CAT dog", "the the the", "élan_x et Straße",
    "the cat sat on the mat", "mat", "one 22 three", "dog mat cat on sat the",
]
QUERIES = ["the cat", "dog dog mat unknown", "zzz", "", "straße 22", "sat on"]


def _weights(texts):
    counts = [Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in texts]
    df = Counter(term for c in counts for term in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    return counts, idf


def _unit(counts, idf):
    raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / norm for t, v in raw.items()}


def _brute_force(k):
    counts, idf = _weights(DOCS)
    docs = [_unit(c, idf) for c in counts]
    wanted = {}
    for q, text in enumerate(QUERIES):
        query = _unit(Counter(re.findall(r"\b\w\w+\b", text.lower())), idf)
        sims = [(-round(sum(w * d.get(t, 0) for t, w in query.items()), 10), i) for i, d in enumerate(docs)]
        for rank, (sim, i) in enumerate(sorted(s for s in sims if s[0] < 0)[:k], 1):
            wanted[(q, rank)] = (i, round(-sim, 8))
    return wanted


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
@pytest.mark.parametrize("frequent", [2, 100_000])
def test_retrieval_equals_brute_force(spark, tmp_path, monkeypatch, threshold, frequent):
    monkeypatch.setattr(retrieval, "FREQUENT_TERMS", frequent)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    path = str(tmp_path / "index")
    retrieval.write_index(docs, path)
    wanted = retrieval.query_weights(queries, spark.read.parquet(f"{path}/terms"))
    found = retrieval.retrieve(wanted, spark.read.parquet(f"{path}/vectors"), k=3)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["similarity"], 8)) for r in found.collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == _brute_force(3)


def test_no_queries(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    path = str(tmp_path / "index")
    retrieval.write_index(docs, path)
    nothing = spark.createDataFrame([], "query_id long, term string, weight double")
    assert retrieval.retrieve(nothing, spark.read.parquet(f"{path}/vectors")).count() == 0


def _corpus(n):
    """Texts of many lengths: frequent words everywhere, rarer ones by chance."""
    rng = random.Random(8)
    rare = [f"rare{i}" for i in range(400)]

    def text():
        return " ".join(rng.choices(["the", "of", "and"], k=rng.choice([2, 5, 20, 60])) + rng.choices(rare, k=rng.choice([0, 1, 3, 10])))

    return [text() for _ in range(n)]


def test_three_appends_equal_one_build(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS + _corpus(60))), "doc_id long, text string")
    once, grown = str(tmp_path / "once"), str(tmp_path / "grown")
    retrieval.write_index(docs, once)
    for i in range(3):
        before = {p: p.stat().st_mtime_ns for p in pathlib.Path(grown).rglob("batch=*/*.parquet")}
        retrieval.append_index(docs.filter(f"doc_id % 3 = {i}"), grown, str(i))
        assert {p: p.stat().st_mtime_ns for p in before} == before
    # The last batch again, and a batch that was cut off before its size was written.
    retrieval.append_index(docs.filter("doc_id % 3 = 2"), grown, "2")
    retrieval.append_index(docs.limit(5), grown, "cut")
    shutil.rmtree(pathlib.Path(grown) / "sizes" / "batch=cut")
    retrieval.refresh_index(spark, grown)

    def weights(path):
        return {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in retrieval.read_postings(spark, path).collect()}

    assert weights(grown) == weights(once)


def _rows(frame):
    return sorted(((r["doc_id"], r["term"], round(r["weight"], 9)) for r in frame.collect()), key=str)


def test_vectors_in_rounds_and_buckets_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BUCKET_POSTINGS", 3)
    monkeypatch.setattr(retrieval, "TASK_CHARS", 4)
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string")
    path = str(tmp_path / "it's an index")
    retrieval.write_index(docs, path)
    assert spark.read.parquet(f"{path}/buckets").first()["n"] == retrieval.SLICES * 2
    assert len({p.parent.name for p in pathlib.Path(path).glob("counts/batch=first/slice=*/*.parquet")}) > 1
    wanted = retrieval.query_weights(queries, spark.read.parquet(f"{path}/terms"))
    found = retrieval.retrieve(wanted, retrieval.read_vectors(spark, path), k=3, placed=True)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["similarity"], 8)) for r in found.collect()}
    assert got == _brute_force(3)


def test_repeated_and_null_keys_are_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BUCKET_POSTINGS", 3)
    texts = [(7, "cat dog"), (7, "cat élan"), (None, "dog"), (None, "mat dog"), (8, "mat"), (9, None), (10, "x")]
    retrieval.write_index(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path))
    whole = {7: Counter(cat=2, dog=1, élan=1), None: Counter(dog=2, mat=1), 8: Counter(mat=1)}
    df = Counter(term for c in whole.values() for term in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    wanted = sorted(((key, t, round(w, 9)) for key, c in whole.items() for t, w in _unit(c, idf).items()), key=str)
    assert _rows(retrieval.read_postings(spark, str(tmp_path))) == wanted
    vectors = retrieval.read_vectors(spark, str(tmp_path))
    assert vectors.count() == 3 and _rows(vectors.selectExpr("doc_id", "inline(entries)")) == wanted


def test_index_without_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    retrieval.write_index(spark.createDataFrame([("a", ""), ("b", None), ("c", "x y")], "doc_id string, text string"), path)
    assert retrieval.read_postings(spark, path).count() == 0 and retrieval.read_vectors(spark, path).count() == 0
    retrieval.append_index(spark.createDataFrame([("d", "two words")], "doc_id string, text string"), path, "second")
    retrieval.refresh_index(spark, path)
    assert [r["doc_id"] for r in retrieval.read_vectors(spark, path).collect()] == ["d"]
