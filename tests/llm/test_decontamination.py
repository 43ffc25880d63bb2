"""Decontamination: planted passages, recall and precision against exact search, odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from postwise.llm import decontamination as deco

SF_DIR = "/root/testdata/sf0.001"


def plain_edits(item, words):
    previous = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(words, 1):
            row.append(min(previous[j - 1] + (x != y), previous[j] + 1, row[-1] + 1))
        previous = row
    return min(previous)


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(999)}")
        else:
            del words[at]
    return words


@pytest.mark.parametrize("size", [5, 12, 20, 45])
def test_recall_and_exactness(size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    items = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(30)]
    search = deco.Search([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    most = deco.allowed_edits(size, 0.8)
    texts, planted = [], []
    for _ in range(150):
        i = rng.randrange(30)
        around = [rng.choice(vocabulary) for _ in range(60)]
        at = rng.randrange(60)
        texts.append(around[:at] + changed(rng, items[i], rng.randrange(most + 1)) + around[at:])
        planted.append(i)
    found = search.find([" ".join(t).encode() for t in texts])
    hits = sum(any(leak[0] == i for leak in leaks) for i, leaks in zip(planted, found, strict=True))
    assert hits >= 0.98 * len(texts)
    for text, leaks in zip(texts, found, strict=True):
        for item, begin, end, edits in leaks:
            assert edits == plain_edits(items[item], text[max(0, begin - most) : end + most]) <= most
            assert edits == plain_edits(items[item], text[begin:end])


@pytest.mark.parametrize("size", [20, 45, 100, 200, 300])
@pytest.mark.parametrize("way", ["even", "random"])
def test_recall_among_foreign_words(size, way):
    rng = random.Random(size)
    items = [[f"w{rng.randrange(3000)}" for _ in range(size)] for _ in range(20)]
    search = deco.Search([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    most = deco.allowed_edits(size, 0.8)
    for edits in sorted({1, most // 4, most // 2, 3 * most // 4, most}):
        texts = []
        for n in range(100):
            words = list(items[n % 20])
            places = rng.sample(range(size), edits) if way == "random" else [(j * size + size // 2) // edits for j in range(edits)]
            for at in places:
                words[at] = f"new{rng.randrange(10**6)}"
            around = [f"far{rng.randrange(10**6)}" for _ in range(30)]
            texts.append(" ".join(around[:15] + words + around[15:]).encode())
        found = search.find(texts)
        assert sum(any(leak[0] == n % 20 for leak in leaks) for n, leaks in enumerate(found)) >= 98, edits


def test_items_of_one_word():
    search = deco.Search([(i, b"item%d" % i) for i in range(40)])
    assert all(search.find([b"far item%d away" % i])[0] == [(i, 1, 2, 0)] for i in range(40))


def test_least_edits_equals_table():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert deco._least_edits(masks, len(item), text)[0] == plain_edits(item, text)


def test_query_equals_exact_search(spark):
    found = {(r["doc_id"], r["item_id"]): r for r in deco.query(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    items = [
        (r["item_id"], deco.words_of(r["text"].encode())) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    ]
    wanted = {}
    for doc_id, text in docs:
        words = deco.words_of(text.encode())
        for item_id, item in items:
            # Passages far from any shared word cannot be near.
            if len(set(item) & set(words)) >= len(set(item)) - deco.allowed_edits(len(item), 0.8):
                edits = plain_edits(item, words)
                if edits <= deco.allowed_edits(len(item), 0.8):
                    wanted[doc_id, item_id] = edits
    assert {k: r["edits"] for k, r in found.items()} == wanted and wanted


def test_odd_rows(spark):
    schema = "doc_id long, text string, ROW int, body string, leak_items string"
    items = spark.createDataFrame([(1, "One two three, four five!"), (2, None), (3, ""), (4, "one two three four five")],
                                  "item_id long, text string")
    rows = [(1, None, 1, "", ""), (2, "", 1, "", ""), (3, "x " * 50_000 + "ONE two, three four five", 1, "", ""),
            (3, "one two three four", 1, "", ""), (4, "one two three four five", 1, None, None),
            (4, "one two three four five", 1, None, None), (None, "zero one two three four five six", 1, "", "")]
    docs = spark.createDataFrame(rows, schema)
    found = deco.leaks(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in found) == sorted(
        [(3, 1, 0), (3, 4, 0), (3, 1, 1), (3, 4, 1)] + [(4, 1, 0), (4, 4, 0)] * 2 + [(0, 1, 0), (0, 4, 0)]
    )
    kept = deco.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert deco.leaks(docs.limit(0), items).count() == 0
    assert deco.leaks(docs, items.filter(F.lit(False))).count() == 0
    assert deco.decontaminate(docs, items.limit(0)).count() == len(rows)
