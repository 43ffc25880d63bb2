"""Minimax sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from postwise.llm import sharding


def best_capacity(sizes, shards):
    best = {(0, 0): 0}
    n = len(sizes)
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    table = [[float("inf")] * (n + 1) for _ in range(shards + 1)]
    table[0][0] = 0
    for k in range(1, shards + 1):
        for i in range(n + 1):
            table[k][i] = min(max(table[k - 1][j], prefix[i] - prefix[j]) for j in range(i + 1))
    del best
    return table[shards][n]


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_smallest(spark, seed):
    rng = random.Random(seed)
    texts = ["w" * rng.choice([0, 1, 5, 30, 200]) + str(rng.randrange(60)) for _ in range(150)]
    texts += ["hot copy"] * rng.choice([0, 120])
    rows = [(i, t) for i, t in enumerate(texts)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    groups = {}
    for t in texts:
        key = hashlib.sha256(t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len(t.encode()) + 1
    wanted = best_capacity([groups[k] for k in sorted(groups)], 5)
    load, slots, shard_of = {}, {}, {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1
        assert r["text_crc32"] == zlib.crc32(text.encode())
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
    assert max(load.values()) == wanted
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) <= set(range(5))


def test_refines_below_the_first_prefix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1)
    rng = random.Random(9)
    sizes = [rng.randrange(1, 50) for _ in range(400)]
    digests = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(400))
    groups = spark.createDataFrame(list(zip(digests, sizes, strict=True)), "digest string, size long")
    cuts = sharding.minimax_cuts(groups, 6)
    loads, k = [0] * 7, 0
    for digest, size in zip(digests, sizes, strict=True):
        while k < len(cuts) and digest >= cuts[k]:
            k += 1
        loads[k] += size
    assert len(cuts) == 5 and max(loads) == best_capacity(sizes, 6)


def test_odd_rows(spark):
    schema = "doc_id long, text string, Shard string, slot int, _x int"
    empty = sharding.shard_documents(spark.createDataFrame([], schema), 3)
    assert empty.count() == 0 and "_x" in empty.columns
    rows = [(1, None, "a", 1, 1), (1, None, "a", 1, 1), (None, "", "b", 2, 2), (4, "x" * 200_000, None, None, None)]
    out = sharding.shard_documents(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 200_001]
    # Null and empty texts are one group and get slots of their own.
    small = [r for r in out if r["size"] == 1]
    assert len({r["shard"] for r in small}) == 1 and sorted(r["slot"] for r in small) == [0, 1, 2]
