"""Exact dedup by content sort against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from postwise.llm import content_sort


def plain(rows, keep):
    """(keep_id, size) per normalised text."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    pick = min if keep == "smallest" else max
    return {t: (pick([i for i in g if i is not None], default=None), len(g)) for t, g in groups.items()}


def check(out, rows, keep):
    wanted = plain(rows, keep)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in wanted}
    kept = {}
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == wanted[text]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[text] = kept.get(text, 0) + 1
    assert kept == dict.fromkeys(wanted, 1)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("pieces", [4, 64, 1024])
def test_equals_plain_groups(spark, monkeypatch, keep, pieces):
    # Few pieces: no text is hot. Many pieces: the copies spread over lanes.
    monkeypatch.setattr(content_sort, "LEAST_PIECES", pieces)
    monkeypatch.setattr(content_sort, "PIECES_PER_PARTITION", 0)
    rng = random.Random(pieces)
    head = "the same beginning of many different texts "
    texts = [head + str(rng.randrange(80)) for _ in range(300)] + ["Hot Copy"] * 200 + ["hot copy"] * 100
    texts += ["É", "é", "İ", "i", "", None, " ", "a\nb", "A\nB", head, head + "\x00"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(content_sort.exact_duplicates(df, keep=keep).collect(), rows, keep)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    # With one hash and one head for all texts, the bytes alone decide, inside lanes and across them.
    real = content_sort.F.xxhash64
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *c: content_sort.F.lit(7).cast("long") if len(c) == 1 else real(*c))
    rng = random.Random(3)
    rows = [(i, "x" * 30 + rng.choice("abcABCd")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(content_sort.exact_duplicates(df, keep="largest").collect(), rows, "largest")


def test_odd_rows(spark):
    schema = "doc_id long, text string, Kept string, row int, body int, hash int, lane int, tags map<string,int>"
    empty = content_sort.exact_duplicates(spark.createDataFrame([], schema))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "row", "body", "hash", "lane", "tags", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [
        (None, None, "a", 1, 1, 1, 1, {"a": 1}),
        (None, "", "b", 2, 2, 2, 2, None),
        (3, "Z" * 300_000, None, None, None, None, None, None),
        (3, "z" * 300_000, None, None, None, None, None, None),
        (3, "z" * 300_000, None, None, None, None, None, None),
        (5, "Z" * 300_000 + "!", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    check(content_sort.exact_duplicates(df).collect(), [r[:2] for r in rows], "smallest")
    whole = content_sort.keep_one(df, keep="largest")
    assert whole.columns == df.columns
    assert sorted(len(r["text"] or "") for r in whole.collect()) == [0, 300_000, 300_001]


def test_plan_shuffles_texts_once_and_stays_in_the_jvm(spark, capsys):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    real = content_sort.stored
    content_sort.stored = lambda d, name, *a: (seen.append((name, d._jdf.queryExecution().executedPlan().toString())), real(d, name, *a))[1]
    try:
        content_sort.exact_duplicates(df).collect()
    finally:
        content_sort.stored = real
    plan = dict(seen)["runs"]
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert not any(word in p for _, p in seen for word in ("Python", "Arrow", "Pandas"))
