"""Near-duplicates: fingerprints, the lower bound, links and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postwise.llm import simhash

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, most):
    points = sorted(set(points))
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= most and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    counts = [[bin(int(x) >> s & 3).count("1") for s in range(0, 64, 2)] for x in (a[0], b[0])]
    unary = simhash.unary_counts(np.array([a[0], b[0]]))
    assert int(unary[0] ^ unary[1]).bit_count() == sum(abs(x - y) for x, y in zip(*counts, strict=True))
    lower = np.bitwise_count(simhash.unary_counts(a) ^ simhash.unary_counts(b))
    assert (lower <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("tile", [4, 1024])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    points = {0, (1 << 64) - 1}
    for _ in range(25):
        walk = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            points.add(walk)
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                walk ^= 1 << bit
    points = sorted(points)
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    mine, wanted = {}, {}
    for p, r in plain_components(points, simhash.MOST_BITS).items():
        wanted.setdefault(r, set()).add(p)
        mine.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_documents_equal_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = given + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "One TWO"), (10_004, "one two")]
    rows += [(10_005, "a b c d " * 20_000), rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("FP", F.lit("x"))
    out = simhash.near_duplicates(frame).collect()
    assert len(out) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components(prints.values(), simhash.MOST_BITS)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    for r in out:
        assert r["fp"] == signed(prints[r["doc_id"]])
        assert r["component"] == least[roots[prints[r["doc_id"]]]]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_rows_of_near_duplicates(spark):
    """Null ids and texts, very long texts, repeated rows, and columns named like those of the result."""
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [
        (7, None), (3, ""), (None, " "), (None, "alone here with no id at all"), (9, long), (4, long + " w1"), (4, long + " w1"),
        (12, "x" * 300_000), (11, "X" * 300_000), (20, "one two three four five"), (20, "one two three four five"), (21, "entirely other words stand here"),
    ]
    frame = spark.createDataFrame([(*r, 1, "c", 2, 3, 4) for r in rows], "doc_id long, text string, FP int, component string, _id int, root int, least int")
    out = simhash.near_duplicates(frame).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "fp", "component"}
    points = sorted({r["fp"] for r in out})
    groups = {}
    for r in out:
        groups.setdefault(r["component"], []).append(r["doc_id"])
    # Texts without words are linked like any other, the smallest id names them; copies share a component.
    assert sorted(groups[3], key=str) == [3, 7, None] and groups[4].count(4) == 2 and 9 in groups[4]
    assert sorted(groups[11]) == [11, 12] and groups[20] == [20, 20] and groups[21] == [21]
    # A component of null ids alone has no name.
    assert groups[None] == [None]
    assert [r["fp"] for r in out if r["doc_id"] in (3, 7)] == [0, 0] and len(points) >= 5
