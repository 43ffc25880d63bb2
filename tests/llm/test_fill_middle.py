"""Boundary sets and the fill-in-middle transformation against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postwise.llm import fill_middle
from postwise.llm.fill_middle import CHUNK, ArrayContainer, BitmapContainer, BoundarySet, RunContainer

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sets():
    rng = np.random.default_rng(5)
    yield "array", ArrayContainer, np.sort(rng.choice(CHUNK, 1000, replace=False))
    yield "bitmap", BitmapContainer, np.sort(rng.choice(CHUNK, 30_000, replace=False))
    yield "runs", RunContainer, np.concatenate([np.arange(10, 9000), np.arange(20_000, 60_000)])
    yield "full", RunContainer, np.arange(CHUNK)
    yield "odd", BitmapContainer, np.arange(1, CHUNK, 2)


@pytest.mark.parametrize("name,kind,values", list(sets()), ids=lambda v: v if isinstance(v, str) else "")
def test_containers_select(name, kind, values):
    found = BoundarySet(values + 3 * CHUNK)
    assert [type(c) for c in found.containers] == [kind]
    picks = [0, 1, len(values) // 2, len(values) - 2, len(values) - 1, *range(7, len(values), 911)]
    assert [found.select(k) for k in picks] == [int(values[k]) + 3 * CHUNK for k in picks]


def test_select_over_chunks_of_all_kinds():
    places = np.concatenate([v + i * 2 * CHUNK for i, (_, _, v) in enumerate(sets())])
    found = BoundarySet(places)
    assert len(found) == len(places) and len({type(c) for c in found.containers}) == 3
    for k in random.Random(1).sample(range(len(places)), 3000):
        assert found.select(k) == places[k]
    for k in (-1, len(places)):
        with pytest.raises(IndexError):
            found.select(k)
    assert len(BoundarySet(np.zeros(0, dtype=np.int64))) == 0


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ <PSM>\n1é"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers())
def test_one_text(text, doc_id):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    n, form, a, m, output = fill_middle.transform(text.encode(), digest)
    assert (n, form, a, m, output.decode()) == plain(doc_id, text)


def test_rows_equal_plain_and_come_back(spark):
    rng = random.Random(2)
    words = ["alpha", "Ω", "é", "\n", "1", "<", "<P", "S>", ">", "M", "日本", "\U0001f600", " ", "<S", "P>"]
    texts = [None, "", "a", "<P>", "x<M>y", "a" * 200_000, "é" * 150_000, "ab1 " * 60_000, "日" * 70_000 + "word " * 9000]
    texts += ["".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(600)]
    rows = [(i * 7919, t, i, "c") for i, t in enumerate(texts)] + [(None, "null id", 1, "c"), (7919, "again", 1, "c"), (7919, "again", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Output int, work string")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "work", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_in_middle(df).count() == 0
