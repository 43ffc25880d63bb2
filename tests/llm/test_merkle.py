"""Merkle manifests and proofs against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postwise.llm import merkle

NAMES = ["doc_id", "source", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests, fanout):
    """Root, and the (left, right) siblings from the leaf up, of every leaf."""
    paths, owners, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, kept = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for j in range(len(run)):
                for leaf in owners[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            kept.append([x for o in owners[at : at + fanout] for x in o])
        nodes, owners = up, kept
    return nodes[0], paths


def plain(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, path) of all rows."""
    groups = {}
    for doc_id, source, text in rows:
        leaf = h(field(doc_id), field(source), field(text))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in names:
        groups[s].sort(key=lambda g: g[:3])
        low[s] = tree([g[2] for g in groups[s]], fanout)
    root, tops = tree([low[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for g, path in zip(groups[s], low[s][1], strict=True):
            out.append((str(g[3]), g[2], low[s][0], root, path + top))
    return sorted(out)


def got(frame):
    return sorted(
        (str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], [(s["left"].hex(), s["right"].hex()) for s in r["path"]])
        for r in frame.collect()
    )


SCHEMA = "doc_id long, source string, text string"
SHAPES = {
    "one row": {"a": 1},
    "one source": {"a": 10},
    "single rows": dict.fromkeys("abcdefgh", 1),
    "hot source": {"hot": 244, "": 1, None: 5, "é": 3, "z": 27, "Z": 28, "hot2": 2},
    "two rows": {"a": 1, "b": 1},
}


@pytest.mark.parametrize("fanout", [2, 3])
@pytest.mark.parametrize("shape", list(SHAPES))
def test_proofs_equal_plain_trees(spark, shape, fanout):
    rng = random.Random(shape)
    ids = rng.sample(range(-500, 500), sum(SHAPES[shape].values()))
    rows = [(ids.pop(), s, f"text {rng.random()}\n") for s, n in SHAPES[shape].items() for _ in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = merkle.manifest(df, NAMES, "source", "doc_id", carry=["doc_id"], fanout=fanout)
    assert got(out) == plain(rows, fanout)
    checks = out.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("same")).distinct().collect()
    assert [r["same"] for r in checks] == [True]


def test_changed_leaf_does_not_fold_to_the_root(spark):
    rows = [(i, "s", "text") for i in range(5)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), NAMES, "source", "doc_id")
    other = merkle.folded(merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.lit("Text")]), F.col("path"))
    assert out.filter(other == F.col("root")).count() == 0


def test_odd_rows(spark):
    schema = SCHEMA + ", Leaf int, tree string, index int, row string, at int, digest int"
    empty = merkle.manifest(spark.createDataFrame([], schema), NAMES, "source", "doc_id")
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "source", "text", "tree", "index", "row", "at", "digest", "leaf", "subroot", "root", "path"]
    rows = [
        (None, None, None),
        (None, "a", ""),
        (4, "a", None),
        (4, "a", "x" * 400_000),
        (4, "a", "same"),
        (4, "a", "same"),
        (-3, "a", "1:a"),
        (2, "-", "-"),
        (9, None, "n"),
    ]
    df = spark.createDataFrame([(*r, 1, "t", 2, "r", 3, 4) for r in rows], schema)
    out = merkle.manifest(df, NAMES, "source", "doc_id")
    assert got(out) == plain(rows, 3)
    assert {(r["tree"], r["index"], r["row"], r["at"], r["digest"]) for r in out.collect()} == {("t", 2, "r", 3, 4)}


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    real = merkle._jump
    monkeypatch.setattr(merkle, "_jump", lambda state, distance: (rounds.append(distance), real(state, distance))[1])
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    out = merkle.manifest(df, NAMES, "source", "doc_id")
    assert out.filter(F.size("path") == 7).count() == 1500
    assert rounds == [1, 2, 4, 8]
