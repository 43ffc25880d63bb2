"""The corpus pipeline: each stage against a plain version on its own input, odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postwise.llm import bpe, decontamination, quality_rules, toxicity
from postwise.llm.common import stored, table
from test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def keys(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = stored(STAGES["toxicity"](spark, docs, SF_DIR), "t")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.query(spark, SF_DIR).collect()}
    assert out.columns == docs.columns and keys(out) == sorted((i, t) for i, t in rows.items() if not scores[i])

    docs, rows = out, {r["doc_id"]: r["text"] for r in out.collect()}
    out = stored(STAGES["quality rules"](spark, docs, SF_DIR), "q")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, ["doc_id"]).collect()}
    assert out.columns == docs.columns and keys(out) == sorted((i, t) for i, t in rows.items() if kept[i])

    docs, rows = out, {r["doc_id"]: r["text"] for r in out.collect()}
    out = stored(STAGES["near duplicates"](spark, docs, SF_DIR), "n")
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    roots = plain_components(prints.values(), 3)
    first = {}
    for i in sorted(rows):
        first.setdefault(roots[prints[i]], i)
    assert out.columns == docs.columns and keys(out) == sorted((i, rows[i]) for i in first.values())

    docs, rows = out, {r["doc_id"]: r["text"] for r in out.collect()}
    out = stored(STAGES["decontamination"](spark, docs, SF_DIR), "d")
    leaked = {r["doc_id"] for r in decontamination.leaks(docs, table(spark, SF_DIR, "benchmark")).collect()}
    assert out.columns == docs.columns and keys(out) == sorted((i, t) for i, t in rows.items() if i not in leaked)

    docs, rows = out, {r["doc_id"]: r["text"] for r in out.collect()}
    last = STAGES["tokens"](spark, docs, SF_DIR).collect()
    tokens = bpe.Tokenizer(open(bpe.default_tokenizer(), encoding="utf-8").read())
    assert {r["doc_id"]: bytes(r["ids"]) for r in last} == {i: tokens.encode(t) for i, t in rows.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    text = "It was a quiet day at the sea and nobody had much to say about all of it then"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x " * 50_000, "en", None), (None, text, "en", "a")]
    rows += [(5, text, "en", "a"), (5, text, "en", "a"), (6, text + " again", None, "a"), (7, "one word", "en", "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("row", "Body", "score", "kept", "fp", "_mark", "n", "root", "ids", "N_WORDS", "_lang", "leak_items"):
        docs = docs.withColumn(extra, F.lit(extra))
    out = STAGES[name](spark, docs, SF_DIR)
    found = out.collect()
    if name == "tokens":
        assert len(found) == len(rows) and {r["n_tokens"] for r in found if r["doc_id"] in (1, 2)} == {0}
    else:
        assert out.columns == docs.columns
    if name == "near duplicates":
        assert sum(r["text"] == text for r in found) == 1 and sum(not r["text"] for r in found) == 1
        assert next(r["doc_id"] for r in found if r["text"] == text) == 5
    if name == "quality rules":
        assert {r["doc_id"] for r in found} == {None, 5, 6}
    if name in ("toxicity", "decontamination"):
        assert len(found) == len(rows)
    assert STAGES[name](spark, docs.limit(0), SF_DIR).count() == 0
