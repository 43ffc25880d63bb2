"""License scans: phrase places, and an exact containment join of text blocks with templates.

A block is a line; or, for notices that are wrapped, a window of as many words as the template has, over
line ends. A block matches a template when it holds at least ``threshold`` of the template's
distinct words. The words of all templates are ordered by their frequency in the whole
corpus, rarest first. A match must share at least ``need = ceil(threshold * size)`` words, so:

* prefix filter: one of the template's first ``size - need + 1`` words is in the block;
* length filter: the block has at least ``need`` template words;
* positional filter: after the shared words so far and the places left behind the last of
  them in both orders, ``need`` can still be reached.

Blocks that pass are counted out exactly. The order changes the work, never the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, table, text_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licenses, by the label a matching block gets.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-terms": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-terms": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"
    ),
}
THRESHOLD = 0.8

# Lower case for A-Z; every ASCII byte but digits and letters becomes a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def needed(size: int, threshold: float) -> int:
    """Least number of shared words; computed without the rounding error of the product."""
    return max(1, math.ceil(round(threshold * size, 9)))


def word_counts(df: DataFrame, text: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Occurrences of the given words in all texts; one number per word reaches the driver."""
    known = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for body in text_bytes(batch.column(0)):
                total.update(filter(known.__contains__, words_of(body)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counts = df.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


class Matcher:
    """Templates indexed by their prefix words in the global order."""

    def __init__(self, templates: dict[str, str], threshold: float, counts: dict[bytes, int]) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        sets = {label: set(words_of(t.encode())) for label, t in templates.items()}
        ranked = sorted(set().union(*sets.values()), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(ranked)}
        self.size, self.need, self.place = {}, {}, {}
        self.length = {label: len(words_of(t.encode())) for label, t in templates.items()}
        self.index: dict[int, list[tuple[str, int]]] = {}
        for label, words in sorted(sets.items()):
            order = sorted(self.rank[w] for w in words)
            if not order:
                continue
            self.size[label], self.need[label] = len(order), needed(len(order), threshold)
            self.place[label] = {r: i for i, r in enumerate(order)}
            for i, r in enumerate(order[: len(order) - self.need[label] + 1]):
                self.index.setdefault(r, []).append((label, i))
        self.prefix_words = frozenset(w for w, r in self.rank.items() if r in self.index)

    def wrapped(self, lines: list[list[bytes]], found: set[tuple[str, int]]) -> list[tuple[str, int, float]]:
        """(template, first line, containment) of windows over line ends, the best of each template and group.

        Windows that touch a line in ``found``, where the template stands already, are left out.
        """
        ranks = [self.rank.get(w, -1) for line in lines for w in line]
        line_of = [number for number, line in enumerate(lines) for _ in line]
        where: dict[int, list[int]] = {}
        for at, r in enumerate(ranks):
            if r in self.index:
                where.setdefault(r, []).append(at)
        out = []
        for label, place in self.place.items():
            width, need = self.length[label], self.need[label]
            # Prefix filter: a window holds one of the template's prefix words.
            prefix = [r for r in place if r in where and place[r] <= len(place) - need]
            near = sorted({at for r in prefix for at in where[r]})
            taken = {number for name, number in found if name == label}
            group, low = [], 0
            for k, at in enumerate(near):
                # Places whose windows meet are counted in one run.
                if k + 1 < len(near) and near[k + 1] - at < width:
                    continue
                group = range(max(0, near[low] - width + 1), min(len(ranks), at + width))
                low = k + 1
                best, held = None, Counter()
                for end in group:
                    if ranks[end] in place:
                        held[ranks[end]] += 1
                    begin = end - width + 1
                    if begin - 1 >= group[0] and ranks[begin - 1] in place:
                        held[ranks[begin - 1]] -= 1
                        if not held[ranks[begin - 1]]:
                            del held[ranks[begin - 1]]
                    first = max(begin, group[0])
                    if len(held) >= need and (best is None or len(held) > best[0]):
                        if line_of[first] < line_of[end] and taken.isdisjoint(range(line_of[first], line_of[end] + 1)):
                            inside = next(i for i in range(first, end + 1) if ranks[i] in place)
                            best = len(held), line_of[inside]
                if best is not None:
                    out.append((label, best[1], best[0] / len(place)))
        return out

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Templates that the block of these words holds, with their containment."""
        block = sorted({self.rank[w] for w in words if w in self.rank})
        live: dict[str, int] = {}
        for j, r in enumerate(block):
            for label, i in self.index.get(r, ()):
                shared = live.get(label, 0)
                reach = shared + 1 + min(self.size[label] - i, len(block) - j) - 1
                if shared < 0 or len(block) < self.need[label] or reach < self.need[label]:
                    live[label] = -1
                else:
                    live[label] = shared + 1
        out = []
        for label in sorted(k for k, shared in live.items() if shared > 0):
            shared = sum(r in self.place[label] for r in block)
            if shared >= self.need[label]:
                out.append((label, shared / self.size[label]))
        return out


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("phrase_labels", T.ArrayType(T.StringType())),
    T.StructField("match_labels", T.ArrayType(T.StringType())),
    T.StructField("match_lines", T.ArrayType(T.LongType())),
    T.StructField("match_containment", T.ArrayType(T.DoubleType())),
]


def scan(
    df: DataFrame,
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with word count, phrase places and one entry per matching line, or first line of a wrapped notice, and template.

    ``first_word`` and ``last_word`` are the smallest and largest start of a phrase place
    (words from 0), null without one; lines count from 0. Null and empty texts have no words and no
    matches. Templates and phrases are parameters and stay small; input columns
    named like the new ones are replaced.
    """
    vocabulary = sorted({w for t in [*templates.values(), *phrases] for w in words_of(t.encode())})
    counts = word_counts(df, text, vocabulary)
    matcher = Matcher(templates, threshold, counts)
    # Each phrase is looked up by its rarest word.
    lists = [(words_of(p.encode()), label) for p, label in phrases.items()]
    keys = frozenset(min(p, key=lambda w: (counts.get(w, 0), w)) for p, _ in lists if p) | matcher.prefix_words

    def one(body: bytes) -> tuple:
        words = words_of(body)
        if keys.isdisjoint(words):
            return len(words), 0, None, None, [], [], [], []
        places, labels = [], []
        for phrase, label in lists:
            k, at = len(phrase), -1
            starts = []
            while phrase:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + k] == phrase:
                    starts.append(at)
            places += starts
            if starts:
                labels.append(label)
        found = []
        lines = [words_of(line) for line in body.split(b"\n")]
        for number, tokens in enumerate(lines):
            if not matcher.prefix_words.isdisjoint(tokens):
                found += [(label, number, share) for label, share in matcher.matches(tokens)]
        if len(lines) > 1:
            found += matcher.wrapped(lines, {(label, number) for label, number, _ in found})
            found.sort(key=lambda x: (x[1], x[0]))
        first, last = (min(places), max(places)) if places else (None, None)
        by = [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return len(words), len(places), first, last, sorted(set(labels)), *by

    def make():
        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)]

    return attach(df, text, FIELDS, make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: phrase places and license labels of every document."""
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    labels = F.array_sort(F.array_union("phrase_labels", "match_labels"))
    best = F.coalesce(F.array_max("match_containment"), F.lit(0.0))
    return docs.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("phrase_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
    )


def oracle_sql() -> str:
    """The same rows by plain list functions, without any filter."""

    def words(text: str) -> str:
        lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all({lower}, '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"

    def literal(tokens: list[bytes]) -> str:
        return "[" + ", ".join(f"'{t.decode()}'" for t in tokens) + "]"

    places = []
    for phrase in PHRASES:
        p = words_of(phrase.encode())
        places.append(f"list_filter(range(len(w)), lambda i: w[i + 1:i + {len(p)}] = {literal(p)})")
    best, labels = [], []
    for label, template in TEMPLATES.items():
        tokens = sorted(set(words_of(template.encode())))
        need = needed(len(tokens), THRESHOLD)
        most = f"list_max(list_transform(lines, lambda x: len(list_intersect(x, {literal(tokens)}))))"
        best.append(f"CASE WHEN {most} >= {need} THEN {most}::DOUBLE / {len(tokens)} ELSE 0 END")
        labels.append(f"CASE WHEN {most} >= {need} THEN '{label}' END")
    base = [f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values())]
    joined = "list_concat(" * (len(places) - 1) + "p0" + "".join(f", p{i})" for i in range(1, len(places)))

    def names(cases: list[str]) -> str:
        return f"array_to_string(list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)), ',')"

    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, {words("text")} AS w,
      list_transform(string_split(text, chr(10)), lambda l: {words("l")}) AS lines FROM t),
    p AS (SELECT *, {", ".join(f"{x} AS p{i}" for i, x in enumerate(places))} FROM w),
    a AS (SELECT *, {joined} AS places FROM p)
    SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) AS first_word,
      list_max(places) AS last_word, {names(base)} AS base_labels, {names(base + labels)} AS labels,
      CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE greatest({", ".join(best)})::DOUBLE END AS score
    FROM a"""
