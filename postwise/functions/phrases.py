"""Many phrases looked up in one pass over a text.

A text is cut once into its words and the gaps between them. Where a word begins some
phrase, the runs of as many words as phrases have are looked up whole, so the work per text
does not grow with the number of phrases.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.functions.text import WORD

TOKENS = f"[{WORD}]+|[^{WORD}]+"


def is_word_character(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def tokens_of(phrase: str) -> list[str]:
    """Words and gaps of a phrase, in turn."""
    tokens: list[str] = []
    for c in phrase:
        if tokens and is_word_character(tokens[-1][-1]) == is_word_character(c):
            tokens[-1] += c
        else:
            tokens.append(c)
    return tokens


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(name: str, values: Iterable[str]) -> str:
    """SQL test of membership; Spark looks longer lists up in a hash set."""
    listed = ", ".join(quoted(v) for v in sorted(values))
    return f"{name} IN ({listed})" if listed else "false"


def found_phrases(text: str, phrases: Iterable[str]) -> Column:
    """The distinct phrases that stand in the text column with no letter, digit or underscore beside them.

    Case is ignored; the gaps between the words of a phrase must be those of the text. Phrases come in lower case.
    Phrases that begin or end with another character are searched one by one. A null text has none.
    """
    wanted = {p.lower() for p in phrases if p}
    cut = {p: tokens_of(p) for p in wanted}
    whole = {p for p in wanted if is_word_character(p[0]) and is_word_character(p[-1])}
    lower = f"lower(coalesce(`{text}`, ''))"
    runs = ", ".join(
        "element_at(t, i)" if n == 1 else f"array_join(slice(t, i, {n}), '')" for n in sorted({len(cut[p]) for p in whole})
    )
    parts = []
    if whole:
        begins = f"array_remove(transform(t, (w, i) -> if({one_of('w', {cut[p][0] for p in whole})}, i + 1, 0)), 0)"
        found = f"flatten(transform({begins}, i -> filter(array({runs}), g -> {one_of('g', whole)})))"
        # The text is bound to t, so it is cut once, wherever the plan puts this expression.
        parts.append(f"flatten(transform(array(regexp_extract_all({lower}, {quoted(TOKENS)}, 0)), t -> {found}))")
    for p in sorted(wanted - whole):
        before, after = (f"(?<![{WORD}])", f"(?![{WORD}])")
        pattern = quoted(before + "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" + after)
        parts.append(f"if(rlike({lower}, {pattern}), array({quoted(p)}), array())")
    return F.expr(f"array_distinct(concat({', '.join(parts)}))") if parts else F.array().cast("array<string>")


def looked_up(keys: Column, table: Mapping[str, list[tuple]], kind: T.StructType) -> Column:
    """All entries of the keys in a constant table, as an array of structs; each key must be in the table."""
    names = kind.names
    text = json.dumps({k: [dict(zip(names, v, strict=True)) for v in rows] for k, rows in table.items()})
    constant = F.from_json(F.lit(text), T.MapType(T.StringType(), T.ArrayType(kind)))
    return F.flatten(F.transform(keys, lambda k: F.element_at(constant, k)))
