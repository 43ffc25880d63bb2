"""Context mixing: base scores by brute force, proper codes, learning, odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postwise.llm import mixing
from postwise.llm.common import remainder

SF_DIR = "/root/testdata/sf0.001"


def plain_base(rows):
    """(id, text) rows: tokens, known tokens, training tokens and base score of each."""
    tokens = {i: (t or "").encode().translate(mixing.LOWER).split() + [None] for i, t in rows}
    counts = Counter()
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        for i, ts in tokens.items()
    }


def check(rows, found):
    wanted = plain_base(rows)
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0 and r["spelling_score"] <= 0
        assert abs(r["score"] - r["token_score"] - r["spelling_score"]) < 1e-9
        assert (r["bits_per_byte"] is None) or r["bits_per_byte"] > 0


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = mixing.query(spark, SF_DIR).collect()
    check(rows, found)
    held_out = [r for r in found if r["held_out"]]
    # The same events: the base has no letters of unknown words.
    assert sum(r["token_score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_score_of_the_whole_text_beats_the_base(spark):
    """With the letters of unknown words, which the base does not have."""
    found = mixing.query(spark, "/root/testdata/sf0.01").filter("held_out")
    total = found.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert total["score"] > total["base"]


def test_huffman_is_a_prefix_code():
    nodes, bits, depth = mixing.huffman(np.array([5.0, 1, 1, 1, 9, 0.5, 3]))
    paths = {tuple(bits[i, : depth[i]]) for i in range(7)}
    assert len(paths) == 7 and abs(sum(0.5 ** len(p) for p in paths) - 1) < 1e-12
    assert not any(a != b and a == b[: len(a)] for a in paths for b in paths)
    assert depth[4] == min(depth)


def test_probabilities_sum_to_one():
    """All tokens after one context: the products of their decisions sum to 1."""
    rng = np.random.default_rng(3)
    coder = mixing.Coder(rng.random(mixing.CLASSES) + 0.01, 16)
    slots = (mixing.CONTEXTS, 1 << 16)
    odds, confidence = rng.normal(size=slots).astype(np.float32), rng.integers(0, 4, slots).astype(np.uint8)
    weights = rng.normal(size=(mixing.KINDS, mixing.CONTEXTS + 1, mixing.GATES)).astype(np.float32)
    refined = rng.normal(size=(mixing.KINDS, mixing.CELLS)).astype(np.float32)
    model = mixing.Model(np.ones(4), mixing.packed(odds, confidence), weights, refined)
    last = np.concatenate([np.arange(mixing.HEAD), np.arange(mixing.BAND, mixing.BAND + mixing.BANDS * mixing.GROUPS)])
    last = np.append(last, [mixing.UNKNOWN, mixing.END]).astype(np.uint16)
    codes = np.stack([np.full(len(last), 7, np.uint16), last], axis=1).ravel()
    starts = np.arange(0, len(codes), 2)
    nothing = np.empty(0, np.int64)
    both = mixing.log_probability(model, coder.decisions(codes, starts, nothing, nothing), len(last))[0]
    alone = mixing.log_probability(model, coder.decisions(np.full(1, 7, np.uint16), np.zeros(1, int), nothing, nothing), 1)[0]
    assert len(set(mixing.class_of(last).tolist())) == mixing.CLASSES
    assert abs(np.exp(both - alone).sum() - 1) < 1e-3


def test_odd_rows(spark):
    rows = [(i, f"the cat number {i} sat on the mat") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x " * 60_000), (104, "Ünïcode ÀÀ " + "q" * 50_000), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("CODES", F.lit("x"))
    learn = remainder("doc_id", 10) != 0
    check(rows, mixing.score(frame, learn).collect())
    assert mixing.score(frame.limit(0), learn).count() == 0
    untrained = mixing.score(frame, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and {r["base_score"] for r in untrained} == {0.0}
    assert {r["held_out"] for r in untrained} == {True}


def test_weights_come_from_all_training_rows(spark, monkeypatch):
    rows = [(i, f"the cat number {i} sat on the mat and then ran away") for i in range(2500)] + [(9000, "long " * 40_000)]
    frame, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    kept = mixing._refinement
    monkeypatch.setattr(mixing, "_refinement", lambda hits, tries: seen.append((hits, tries)) or kept(hits, tries))
    assert mixing.score(frame, F.lit(True)).count() == len(rows)
    # Every token, the end of a text included, takes at least one decision; words take further ones.
    assert len(seen) == 1 and seen[0][1].sum() >= 2500 * 12 + 40_001 and (seen[0][0] <= seen[0][1]).all()


def test_fit_and_score_equal_a_plain_computation(spark, monkeypatch):
    """Counts by dictionary, then every decision mixed by itself."""
    words = "the cat sat on a mat and ran away with some other animals".split()
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(words, 12)) + f" w{i % 37} only{i}") for i in range(80)]
    kept, fitted = mixing._fit, []

    def fit(coded, corpus):
        fitted.append((kept(coded, corpus), coded.select("_learn", "_id", "codes", "unknown", "rare").toArrow()))
        return fitted[0][0]

    monkeypatch.setattr(mixing, "_fit", fit)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r["doc_id"]: r for r in mixing.score(frame, remainder("doc_id", 10) != 0).collect()}
    model, coded = fitted[0]
    coder, counts = model.coder(), Counter()

    def decisions(learning, row):
        batch = coded.slice(row, 1).select(["codes", "unknown", "rare"]).combine_chunks().to_batches()[0]
        for slots, bits, kind, _ in coder.decisions(*mixing._texts(batch, learning)):
            yield from ((*(int(s[i]) for s in slots), int(bits[i]), kind) for i in range(len(bits)))

    learn, ids = coded["_learn"].to_pylist(), coded["_id"].to_pylist()
    for row in np.flatnonzero(learn):
        for *slots, bit, _ in decisions(True, int(row)):
            counts.update((k, s, bit) for k, s in enumerate(slots))
    for row, doc in enumerate(ids):
        logs = [0.0, 0.0]
        for *slots, bit, kind in decisions(False, row):
            found = [(counts[k, s, 0], counts[k, s, 1]) for k, s in enumerate(slots)]
            sure = [sum(sum(c) >= least for least in (1, 4, 32)) for c in found]
            gate = sure[1] * 16 + sure[2] * 4 + sure[3]
            weights = model.weights[kind, :, gate]
            odds = [math.log((ones + 0.4) / (zeros + 0.4)) for zeros, ones in found]
            mixed = min(max(sum(w * x for w, x in zip(weights, [*odds, 0.3], strict=True)), -16), 16)
            cell = min(max(int((mixed + 8) * mixing.CELLS / 16), 0), mixing.CELLS - 1)
            final = (mixed + float(model.refined[kind, cell])) / 2
            logs[kind == 2] -= math.log1p(math.exp(-final if bit else final))
        band = scores[doc]["token_score"] - logs[0] / math.log(10)
        # The steps of the packed log odds may move a mixture into the next cell of the refinement.
        assert abs(logs[1] / math.log(10) - scores[doc]["spelling_score"]) < 0.02 * abs(logs[1]) + 0.01
        shares = 0.0
        for code in np.frombuffer(coded["codes"][row].as_py(), "<u2") & 0x7FFF:
            shares += mixing.BAND <= code < mixing.UNKNOWN
        assert band <= 0.02 * abs(logs[0]) + 0.01 and (shares or abs(band) <= 0.02 * abs(logs[0]) + 0.01)


def test_steps_come_from_tables():
    """Hashed nodes and bits are looked up: a coder hashes no node while it cuts texts into decisions, and words come by code."""
    coder = mixing.Coder(np.arange(1.0, mixing.CLASSES + 1), 16)
    codes = np.array([0, 5, mixing.HEAD - 1, mixing.BAND + 37, mixing.UNKNOWN, mixing.END], np.uint16)
    letters = np.frombuffer(b"ab ", np.uint8)
    kept, hashed = mixing._node_hash, []
    mixing._node_hash = lambda nodes: hashed.append(len(nodes)) or kept(nodes)
    try:
        found = list(coder.decisions(codes, np.zeros(1, int), letters, np.zeros(3, int)))
    finally:
        mixing._node_hash = kept
    assert not hashed
    taken = [sum(len(bits) for _, bits, kind, _ in found if kind == k) for k in range(mixing.KINDS)]
    # The places of ranks 6 and 2,047 in their groups, the group of the band, eight bits of every letter.
    assert taken == [int(coder.depth[mixing.class_of(codes)].sum()), 2 + 10 + mixing.GROUP_BITS, 24]
    spelled = [bits.tolist() for _, bits, kind, _ in found if kind == 2]
    assert [int("".join(map(str, b)), 2) for b in zip(*spelled, strict=True)] == list(b"ab ")


def test_frequent_words_come_first_in_a_block(spark, monkeypatch):
    kept = mixing._coder

    def coder(*given):
        run = kept(*given)

        def watched(batches):
            def passed():
                last = None
                for b in batches:
                    for now in zip(*[b.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                        if last and last[:2] == now[:2] and last[2] < now[2]:
                            raise AssertionError("a rarer word came first")
                        last = now
                    yield b

            return run(passed())

        return watched

    monkeypatch.setattr(mixing, "_coder", coder)
    # In the order of the bytes the rarest word would come first.
    rows = [(i, " ".join(f"w{9 - k}" for k in range(1 + i % 9))) for i in range(200)]
    assert mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).count() == 200


def test_words_are_cut_as_python_splits_them():
    rng = np.random.default_rng(7)
    letters = np.frombuffer(b"aAbZ\xc3\x9f \t\n\x0b\x0c\r\x1c\x00", np.uint8)
    for _ in range(500):
        bodies = [rng.choice(letters, rng.integers(12)).tobytes() for _ in range(rng.integers(1, 6))]
        words, places, sizes = mixing.cut(bodies)
        plain = mixing.listed(words, behind=1)
        wanted = [b.translate(mixing.LOWER).split() for b in bodies]
        assert [plain[k] for k in places] == [w for ws in wanted for w in ws] and sizes.tolist() == [len(ws) for ws in wanted]
        assert mixing.listed(words) == words.to_pylist() and len(set(plain)) == len(plain)
        assert mixing.listed(words.slice(1), behind=1) == plain[1:]
        assert mixing.groups_of(words, behind=1).tolist() == [mixing.group_of(w) for w in plain]


def test_groups_are_worked_out_once_for_each_ending(monkeypatch):
    """The words of a block share few endings; the group of a word is not worked out word by word."""
    kept, asked = mixing.group_of, []
    monkeypatch.setattr(mixing, "group_of", lambda word: asked.append(word) or kept(word))
    words = [f"w{i}ing".encode() for i in range(1000)]
    rows = [(0, 0, w, 5, None, None) for w in words] + [(0, 1, b" ".join(words) + b" Unseen1ed unseen2ed", 0, False, 7)]
    names = ["_block", "_kind", "_body", "_count", "_learn", "_id"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    code = mixing._coder({}, np.full((mixing.BANDS, mixing.GROUPS), 5000), 1, 6)
    (found,) = code(iter([pa.RecordBatch.from_arrays(arrays, names=names)]))
    assert len(asked) <= 4
    band = mixing.BAND + 2 * mixing.GROUPS + kept(b"ng")
    codes = np.frombuffer(found.column("codes")[0].as_py(), "<u2")
    assert codes.tolist() == [band] * 1000 + [mixing.UNKNOWN] * 2 + [mixing.END]
    assert found.column("unknown").to_pylist() == [b"unseen1ed unseen2ed "] and found.column("rare").to_pylist() == [b""]


def test_equal_decisions_are_counted_together(monkeypatch):
    """Slots are worked out for distinct pairs of a context and a token or byte; the counts are those of all decisions."""
    rng = np.random.default_rng(5)
    texts = [rng.choice([3, 70, 700, mixing.BAND + 37, mixing.UNKNOWN], 20) for _ in range(300)]
    packed = [np.append(t, mixing.END).astype("<u2").tobytes() for t in texts]
    spelled = [b"only once " * int(rng.integers(3)) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (packed, spelled, spelled)], names=["codes", "unknown", "rare"])
    coder = mixing.Coder(np.arange(1.0, mixing.CLASSES + 1), 16)
    wanted, decisions = np.zeros((mixing.CONTEXTS, 2 << 16), np.int64), 0
    for slots, bits, _, _ in coder.decisions(*mixing._texts(batch, learning=True)):
        decisions += len(bits) * mixing.CONTEXTS
        for mine, s in zip(wanted, slots, strict=True):
            np.add.at(mine, 2 * s + bits, 1)
    kept, made = mixing._slots, []
    monkeypatch.setattr(mixing, "_slots", lambda c, rows, node, bits: made.append(len(c) * len(node)) or kept(c, rows, node, bits))
    found = np.zeros_like(wanted).reshape(-1, 2 * mixing.CHUNK)
    for part in mixing._counting(coder)(iter([batch])):
        for chunk, *rest in zip(*[c.to_pylist() for c in part.columns], strict=True):
            found[chunk] += mixing._unpack(*rest)
    assert (found.reshape(wanted.shape) == wanted).all()
    assert sum(made) < decisions / 2
