"""Phrase lookup against a regex per phrase."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from postwise.functions.phrases import found_phrases, tokens_of
from postwise.operators import ingest, phrases
from postwise.plans import given


def plain(text, listed):
    """Python's word class has the same letters and digits for these texts."""
    low = (text or "").lower()
    return sorted({p.lower() for p in listed if p and re.search(rf"(?<!\w){re.escape(p.lower())}(?!\w)", low)})


LISTED = ["News", "world news", "world  news", "c++", "#tag", "a", "a-b", "a b c", "b c", "it's", "été", "日本", "x_1", "q\\E", "fact check now"]
TEXTS = [
    "World NEWS, world  news", "newsworld", "c++ and C++!", "xc++", "#tag a#tag #tags", "a-b a b c", "a  b c", "It's ÉTÉ", "日本 日本語",
    "x_1 x_12", "q\\E", "fact check now", "fact check\nnow", "fact check", "", None, " ", "!!", "a", "'a'", "news" * 3, "news " * 5000,
]


def test_tokens():
    assert tokens_of("fact check!") == ["fact", " ", "check", "!"]
    assert tokens_of("") == []


def test_found_phrases_equal_single_searches(spark):
    rng = random.Random(1)
    pieces = ["news", "world", " ", "  ", "a", "b", "c", "-", "+", "#tag", "x_1", "été", "日本", "'s", "\n", "fact", "check", "now"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=12)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: sorted(r["found"]) for r in df.select("id", found_phrases("text", LISTED).alias("found")).collect()}
    assert got == {i: plain(t, LISTED) for i, t in enumerate(texts)}
    assert df.select(found_phrases("text", []).alias("f")).filter(F.size("f") > 0).count() == 0


def test_ten_thousand_phrases_in_one_pass(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    listed = sorted({" ".join(rng.choices(vocabulary, k=rng.randrange(1, 4))) for _ in range(10_000)})
    texts = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    held = df.select("id", found_phrases("text", listed).alias("found"))
    plan = held._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") == 1 and "rlike" not in plan and plan.count("insets") + plan.count("inset") >= 1
    known = set(listed)
    wanted = {}
    for i, t in enumerate(texts):
        words = t.split()
        runs = {" ".join(words[a : a + n]) for n in (1, 2, 3) for a in range(len(words) - n + 1)}
        wanted[i] = sorted(runs & known)
    assert {r["id"]: sorted(r["found"]) for r in held.collect()} == wanted
    by_table = phrases.phrase_table(spark.createDataFrame([(p,) for p in listed], "phrase string"))
    hits = phrases.phrase_hits(df, by_table, "id").collect()
    assert sorted((r["id"], r["phrase"]) for r in hits) == sorted((i, p) for i, ps in wanted.items() for p in ps)


def test_phrase_table_drops_what_it_cannot_find(spark):
    rows = [("News",), ("news",), ("c++",), ("",), (None,), ("a b",)]
    table = phrases.phrase_table(spark.createDataFrame(rows, "phrase string"))
    assert sorted(map(tuple, table.collect())) == [("a b", "a", 3), ("news", "news", 1)]
    empty = phrases.phrase_hits(spark.createDataFrame([], "id int, text string"), table, "id")
    assert empty.columns == ["id", "phrase"] and empty.count() == 0


def test_texts_are_searched_once_per_use(spark):
    rows = ingest.themed_rows(given.payloads(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") == 1 and "rlike" not in plan
