"""The tokenization automaton against the tokenizers library and against plain merging."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from postwise.llm import bpe

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    "",
    "   \n",
    None,
    "<|startoftext|> Hello's I'LL <|endoftext|>x<|startoftext|",
    "ΑΣΣ ΣΑΣ İstanbul ẞ ﬁ",
    "a\x1cb\x85c d e　f᠎g",
    "aaaaaaaaaaaa!!!!!!! 1234 ½ ²",
    "é ẛ̣ 한글 中文 🙂🙂👍🏽",
    "don't we're they've I'm 's'S",
    "the" * 3000,
    "\x00\x01 a​b �",
]


def merged(symbols, ranks):
    """Plain BPE: the earliest merge first, leftmost pair first."""
    parts = list(symbols)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not pairs:
            return parts
        rank = min(pairs)[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_merging(seed):
    """Merges learned by counting pairs in random words, as for a real vocabulary."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    parts, merges = [list(w) for w in words], []
    for _ in range(25):
        counts = {}
        for w in parts:
            for p in zip(w, w[1:], strict=False):
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        merges.append(max(sorted(counts), key=counts.get))
        ranks = {m: i for i, m in enumerate(merges)}
        parts = [merged(w, ranks) for w in words]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", "c", *(a + b for a, b in merges)]))}
    automaton, names = bpe.Automaton(vocabulary, merges), {i: t for t, i in vocabulary.items()}
    for word in words + ["a" * n for n in range(1, 20)]:
        assert [names[i] for i in automaton.encode(word)] == merged(word, ranks)


def test_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    library = tokenizers.Tokenizer.from_file(path)
    given = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    rows = list(enumerate(ODD + given))
    out = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert len(out) == len(rows)
    for row in out:
        text = rows[row["doc_id"]][1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_clashing_columns_and_empty_table(spark):
    schema = "doc_id long, text string, N_Tokens string, ids int"
    path = bpe.default_tokenizer()
    empty = bpe.encode(spark.createDataFrame([], schema), path)
    assert empty.columns == ["doc_id", "text", "n_tokens", "ids"] and empty.count() == 0
    out = bpe.encode(spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3)], schema), path).collect()
    assert [r["n_tokens"] for r in out] == [2, 2]
