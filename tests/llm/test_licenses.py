"""License scans: the containment join against counting every pair, and odd rows."""

from __future__ import annotations

import random
import textwrap

from postwise.llm import licenses


def test_matches_equal_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = {f"t{k}": " ".join(rng.sample(vocabulary, rng.randrange(1, 14))) for k in range(12)}
    counts = {w.encode(): rng.randrange(50) for w in vocabulary}
    for threshold in (0.3, 0.5, 0.8, 1.0):
        matcher = licenses.Matcher(templates, threshold, counts)
        for _ in range(400):
            words = [w.encode() for w in rng.choices([*vocabulary, "x", "y"], k=rng.randrange(0, 25))]
            wanted = []
            for label, template in sorted(templates.items()):
                t = set(licenses.words_of(template.encode()))
                shared = len(t & set(words))
                if shared >= licenses.needed(len(t), threshold):
                    wanted.append((label, shared / len(t)))
            assert matcher.matches(words) == wanted


def test_needed_has_no_rounding_error():
    assert [licenses.needed(n, 0.8) for n in (0, 1, 5, 6, 10, 15, 20)] == [1, 1, 4, 5, 8, 12, 16]
    assert licenses.needed(10, 0.7) == 7


def test_odd_rows(spark):
    schema = "doc_id long, text string, N_WORDS string"
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, "x\nReleased under the MIT License.\nMIT-LICENSE, mit license" + " z" * 50_000, None),
        (3, "CC BY cc by", None),
        (4, "Licénsed under nothing", None),
    ]
    out = licenses.scan(spark.createDataFrame(rows, schema), keep=["doc_id"]).collect()
    assert [tuple(r)[:4] for r in out[:2]] == [(1, 0, 0, None), (2, 0, 0, None)]
    assert (out[2]["n_base"], out[2]["first_word"], out[2]["last_word"]) == (3, 4, 8)
    assert out[2]["phrase_labels"] == ["mit"] and out[2]["match_labels"] == ["mit-notice"]
    assert out[2]["match_lines"] == [1] and out[2]["match_containment"] == [1.0]
    assert (out[3]["n_words"], out[3]["n_base"]) == (4, 2)
    assert out[4]["match_labels"] == []


def test_wrapped_notices():
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD, {})
    for label, template in licenses.TEMPLATES.items():
        words = template.split()
        for width in (2, 3, 5, 8, 12):
            lines = ["zig zag", *(" ".join(words[at : at + width]) for at in range(0, len(words), width)), "zig zag"]
            tokens = [licenses.words_of(line.encode()) for line in lines]
            single = {(name, n) for n, line in enumerate(tokens) for name, _ in matcher.matches(line)}
            found = [(name, n, share) for name, n, share in matcher.wrapped(tokens, single) if name == label]
            assert found == [(label, 1, 1.0)] or any(name == label for name, _ in single)


def test_wrapped_notices_in_a_scan(spark):
    text = "\n".join(["x", *(textwrap.fill(t, 40) + "\nzig zag " * 40 for t in licenses.TEMPLATES.values())])
    row = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert set(row["match_labels"]) == set(licenses.TEMPLATES)
