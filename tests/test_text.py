"""Text functions against plain Python on hand-written rows."""

from __future__ import annotations

import re
import string
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from postwise.functions import text, verdicts

EDGES = [
    "Hé @élan_x #Été! http://a.b/c?d WWW.x.y 😀 🇫🇷 don't",
    "", "   ", "a b c", "a b c", "x\x1cy z", "Ⅰ É A a", "™…½ﬁ！ß", "İstanbul ẞ", "WHY?? NOW!!!",
    "https://only.a/link", "@@a #@b @#c #", "@😀abc #😀", "http://x@y www", "line\r\none two\x85three",
    "中文 텍스트 ελληνικά ﷺ ㎏", "a" * 400 + "!", "@http://x y", "é ̧c", "tab\tend \x1f",
]


def python_clean(value: str) -> str:
    value = re.sub(r"http\S+|www\S+", "", value.lower())
    value = re.sub(r"#\w+", "", re.sub(r"@\w+", "", value))
    value = "".join(
        c for c in value
        if not any(a <= ord(c) <= b for a, b in
                   ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF)))
    )
    return "".join(c for c in value if c not in string.punctuation)


def python_normal(value: str) -> str:
    ascii_form = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return re.sub(r"\s+", " ", ascii_form).strip()


def python_style(value: str) -> list[float]:
    tokens = value.split()
    n = max(1, len(tokens))
    return [
        len([c for c in value if c.isupper()]) / max(1, len(value)),
        min(1.0, value.count("!") / n),
        min(1.0, value.count("?") / n),
        len(set(tokens)) / n,
        min(1.0, sum(map(len, tokens)) / n / 10.0),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "id int, text string")


def test_clean_and_normalize(edges):
    rows = text.normalize_text(text.clean_text(edges)).collect()
    for row in rows:
        assert row["clean_text"] == python_clean(row["text"]), row["text"]
        assert row["normalized_text"] == python_normal(python_clean(row["text"])), row["text"]


def test_single_steps_equal_fused_clean(edges):
    c = F.lower("text")
    for step in (text.strip_urls, text.strip_mentions, text.strip_hashtags, text.strip_emojis, text.strip_punctuation):
        c = step(c)
    both = edges.select(c.alias("steps"), text.clean(F.col("text")).alias("fused")).collect()
    assert all(r["steps"] == r["fused"] for r in both)


def test_style_features(edges):
    for row in text.with_style_features(edges).collect():
        assert row["style_features"] == python_style(row["text"]), row["text"]


def test_nulls_stay_null(spark):
    one = spark.createDataFrame([(None,)], "text string")
    row = text.normalize_text(text.clean_text(one)).first()
    assert row["style_features"] is None and row["normalized_text"] is None


def test_nfkd_of_every_code_point(spark):
    points = spark.range(1, sys.maxunicode + 1).filter("id < 55296 OR id > 57343")
    chars = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    framed = chars.select("id", text.nfkd_ascii(F.concat(F.lit("a"), "c", F.lit("b"), "c")).alias("r"))
    expected = {}
    for point in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= point <= 0xDFFF:
            form = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
            if form:
                expected[point] = f"a{form}b{form}"
    got = {r["id"]: r["r"] for r in framed.filter("id >= 128 AND r <> 'ab'").collect()}
    assert got == expected


def test_normalize_needs_clean_text(edges):
    with pytest.raises(ValueError, match="clean_text"):
        text.normalize_text(edges)


@pytest.mark.parametrize(
    ("answer", "verdict", "reasoning"),
    [
        ("VERDICT: TRUE\n\nBecause.\nReally.", "TRUE", "Because. Really."),
        ("\x1b[1mverdict: false\x1b[0m\r\nNo.", "FALSE", "No."),
        ("Intro\nVERDICT: maybe\nWell.", "UNCERTAIN", "Well."),
        ("VERDICT: UNCERTAIN", "UNCERTAIN", "VERDICT: UNCERTAIN"),
        ("No verdict here\nat all", "UNCERTAIN", "No verdict here\nat all"),
        ("VERDICT: TRUE\nVERDICT: FALSE", "TRUE", "VERDICT: FALSE"),
        ("VERDICT: TRUE next  \n   \n last", "TRUE", "next    last"),
        ("", "UNCERTAIN", ""),
    ],
)
def test_verdict_parsing(spark, answer, verdict, reasoning):
    row = verdicts.parse_verdicts(spark.createDataFrame([(answer,)], "text string")).first()
    assert (row["verdict"], row["reasoning"]) == (verdict, reasoning)


def test_blanks_are_collapsed_without_a_replacement(spark):
    texts = ["", " ", "a", " a  b ", "a\t\tb\x0b\x1c c\r\n", "\x1d\x1f", None, "a \x85 b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.collapse_spaces(F.col("t")).alias("c"))
    wanted = {t: None if t is None else re.sub(r"[ \t-\r\x1c-\x1f]+", " ", t).strip(" ") for t in texts}
    assert {r["t"]: r["c"] for r in frame.collect()} == wanted
    assert "regexp_replace" not in frame._jdf.queryExecution().optimizedPlan().toString()
