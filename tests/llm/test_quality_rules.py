"""Quality rules: counts against plain Python, sketches, thresholds, odd rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from postwise.llm import quality_rules as rules


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(covered)


def test_repeated_words_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 60))]
        assert rules.repeated_words(words) == plain_repeats(words)


def test_measures():
    text = "Ab ab ab #x é\n\nAb ab ab #x é\n \x0b\nlast"
    words = text.split()
    assert rules.measures(text.encode()) == (11, sum(map(len, words)), 2, 1, 10, 3, 2, 2)
    assert rules.measures(b"") == (0,) * 8


def test_bins_bound_their_values(spark):
    values = [*range(300), 1023, 1024, 1025, 10**6, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    out = rows.select("v", rules.sketch_bin(F.col("v")).alias("b")).withColumn("t", rules.bin_top(F.col("b")))
    found = out.orderBy("v").collect()
    assert all(r["v"] <= r["t"] <= r["v"] * 17 / 16 for r in found if r["v"])
    assert all(a["b"] <= b["b"] and (a["t"] < b["v"]) == (a["b"] < b["b"]) for a, b in zip(found, found[1:], strict=False))


def test_thresholds_follow_the_source(spark):
    clean = "the quick brown fox number {} jumps over all of the lazy dogs here"
    rows = [(i, clean.format(i), "en", "a") for i in range(80)]
    rows += [(100 + i, "$1 & " + clean.format(i) + " # $2", "en", "prices") for i in range(80)]
    rows += [(200, "### ".join(clean.split()), "en", "a"), (201, "### ".join(clean.split()), "fr", None)]
    rows += [(202, clean.format(5), None, None), (203, None, "en", "a"), (204, "", None, "a")]
    rows += [(205, "w " * 100_000, "en", "a"), (0, clean.format(0), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = rules.judged(docs, ["doc_id"]).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80)) and kept[202]
    assert not any(kept[i] for i in (200, 201, 203, 204, 205))


def test_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, _LANG int, symbol_rate string, kept int"
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1, "x", 2)], schema)
    assert rules.judged(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]).count() == 1
    assert rules.judged(docs.limit(0), ["doc_id"]).count() == 0
