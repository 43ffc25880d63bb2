"""Text cleaning, normalising and style features as column expressions.

The word and whitespace classes are spelled out because the JVM's ``\\w`` and
``\\s`` are ASCII-only while posts are multilingual.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"

STYLE_COLUMNS = [
    "caps_ratio",
    "exclamation_density",
    "question_density",
    "lexical_diversity",
    "avg_word_length",
]


def strip_urls(c: Column) -> Column:
    """Drop ``http…`` and ``www…`` runs; expects lowercase text."""
    stripped = F.regexp_replace(c, rf"(?:http|www)[^{SPACE}]+", "")
    # The substring tests spare the pattern on the many texts without a link.
    return F.when(F.contains(c, F.lit("http")) | F.contains(c, F.lit("www")), stripped).otherwise(c)


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, rf"@[{WORD}]+", "")


def strip_hashtags(c: Column) -> Column:
    return F.regexp_replace(c, rf"#[{WORD}]+", "")


def strip_emojis(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{EMOJI}]+", "")


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, string.punctuation, "")


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """ASCII forms of single code points under NFKD.

    Decomposition acts per code point once non-ASCII marks are dropped, so one
    table covers every text: (sources, targets) of the one-to-one cases and a
    mapping of those that become several characters.
    """
    sources, targets, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        ascii_form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(ascii_form) == 1:
            sources.append(char)
            targets.append(ascii_form)
        elif ascii_form:
            longer[char] = ascii_form
    return "".join(sources), "".join(targets), longer


def _class_of(chars: str) -> str:
    """Regex class of non-ASCII characters, neighbours joined into ranges.

    The intersection lets the matcher pass over ASCII without trying the ranges.
    """
    points = sorted(map(ord, chars))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))
    return rf"[[^\x00-\x7F]&&[{ranges}]]"


def nfkd_ascii(c: Column) -> Column:
    """NFKD decomposition with everything outside ASCII dropped.

    Most texts are plain ASCII and pass through. Of the others only the
    non-ASCII part is searched for characters that expand, and only texts with
    such a character are cut into pieces and looked up.
    """
    sources, targets, longer = _decompositions()
    table = F.create_map(*[F.lit(v) for pair in longer.items() for v in pair])
    expanding = _class_of("".join(longer))
    # The mark is a non-character, which is dropped with the rest beyond ASCII.
    marked = F.regexp_replace(c, f"({expanding})", "\ufdd0$1\ufdd0")
    pieces = F.split(marked, "\ufdd0")
    expanded = F.array_join(F.transform(pieces, lambda p: F.coalesce(table[p], p)), "")
    beyond_ascii = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    expanded = F.when(F.rlike(beyond_ascii, F.lit(expanding)), expanded).otherwise(c)
    ascii_only = F.regexp_replace(F.translate(expanded, sources, targets), r"[^\x00-\x7F]+", "")
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), ascii_only).otherwise(c)


def collapse_spaces(c: Column) -> Column:
    """One blank per whitespace run, none at the ends; expects ASCII text.

    Cut and joined: behind the ASCII folding that takes a fraction of the time of a replacement.
    """
    return F.array_join(F.array_remove(F.split(c, r"[\s\x1c-\x1f]+"), ""), " ")


def clean(c: Column) -> Column:
    """Lowercase, then drop links, mentions, hashtags, emojis and punctuation.

    All but the links go in one pass: what follows a dropped mention is never a
    word character, so the order cannot change the result. Single ``@`` and
    ``#`` are matched alone, because a mention may start right after them.
    """
    others = "".join(rf"\x{ord(p):02x}" for p in string.punctuation if p not in "@#")
    marks = rf"[@#][{WORD}]++|[{others}]++|[@#]|[{EMOJI}]++"
    return F.regexp_replace(strip_urls(F.lower(c)), marks, "")


def normalize(c: Column) -> Column:
    """ASCII form of cleaned text with single blanks."""
    return collapse_spaces(nfkd_ascii(c))


def words(c: Column) -> Column:
    """Whitespace-separated words; no empty strings.

    The intersection lets the matcher pass over printing ASCII without trying the classes.
    """
    return F.array_remove(F.split(c, f"[[^!-~]&&[{SPACE}]]+"), "")


def with_style_features(df: DataFrame, text: str = "text", output: str = "style_features") -> DataFrame:
    """Add the five style numbers of the raw text, in ``STYLE_COLUMNS`` order.

    A null text keeps null features.
    """
    t = F.col(text)
    w = words(t)
    parts = df.select(
        "*",
        F.length(t).alias("_chars"),
        F.length(F.regexp_replace(t, r"\P{IsUppercase}+", "")).alias("_caps"),
        (F.length(t) - F.length(F.replace(t, F.lit("!")))).alias("_bangs"),
        (F.length(t) - F.length(F.replace(t, F.lit("?")))).alias("_asks"),
        F.length(F.array_join(w, "")).alias("_inked"),
        F.size(w).alias("_words"),
        F.size(F.array_distinct(w)).alias("_distinct"),
    )
    n = F.greatest(F.col("_words"), F.lit(1))
    features = F.array(
        F.col("_caps") / F.greatest(F.col("_chars"), F.lit(1)),
        F.least(F.col("_bangs") / n, F.lit(1.0)),
        F.least(F.col("_asks") / n, F.lit(1.0)),
        F.col("_distinct") / n,
        F.least(F.col("_inked") / n / 10.0, F.lit(1.0)),
    )
    return parts.withColumn(output, F.when(t.isNotNull(), features)).drop(
        "_chars", "_caps", "_bangs", "_asks", "_inked", "_words", "_distinct"
    )


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``style_features`` of the raw text and ``clean_text``."""
    return with_style_features(df, text).withColumn("clean_text", clean(F.col(text)))


def normalize_text(df: DataFrame) -> DataFrame:
    """Add ``normalized_text``; the cleaned text must be there."""
    if "clean_text" not in df.columns:
        raise ValueError("Column 'clean_text' missing")
    return df.withColumn("normalized_text", normalize(F.col("clean_text")))
