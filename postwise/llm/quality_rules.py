"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each rate of a document (an integer per mille) falls into a bin of a log-linear sketch:
values below 32 have a bin each, larger ones 16 bins per power of two, so a bin edge is
within 1/16 of its values. A sketch is its counts per bin; sketches of sources merge to that of a
language, and those of languages to that of the corpus, by adding counts. They are summed before the
shuffle, so neither a hot source nor more rows make them larger.

The threshold of a rate in a source is its upper quartile plus three times the
interquartile range, but at least a tolerance above the median; the sketch of the language stands in for a
source with few rows, and that of the corpus for a language with few. The rows meet their
thresholds in a join on language and source.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, boxed, inside, stored, table

# Rates in per mille with the tolerance: a rate within it of the median is never an outlier.
RATES = {
    "symbol_rate": 60,
    "upper_rate": 150,
    "dup_line_rate": 500,
    "repeat_rate": 250,
    "echo_rate": 100,
    "long_rate": 6000,
}
QUANTILES = {"low": (1, 4), "middle": (1, 2), "high": (3, 4)}
FENCE = 3
# Groups with fewer rows take the sketch of the next larger group.
LEAST_ROWS = 50
# The base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20

FIELDS = [
    T.StructField(n, T.LongType())
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes")
]
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


def _all_but(kept: bytes) -> bytes:
    return bytes(b for b in range(256) if b not in kept)


NOT_SYMBOLS = _all_but(SYMBOLS)
NOT_UPPER = _all_but(bytes(range(0x41, 0x5B)))
# White space and the continuation bytes of UTF-8: what is left counts the code points in words.
NOT_STARTS = WHITE + bytes(range(0x80, 0xC0))
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, total = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + WINDOW - max(covered, i)
            covered = i + WINDOW
    return total


def measures(body: bytes) -> tuple[int, ...]:
    words = body.split()
    lines = [line for line in body.split(b"\n") if line.strip(WHITE)]
    return (
        len(words),
        len(body.translate(None, NOT_STARTS)),
        len(body.translate(None, NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(body.translate(None, NOT_UPPER)),
        sum(map(eq, words, words[1:])),
    )


def measure(df: DataFrame, text: str | tuple[str, int] = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with word, symbol, line and repeat counts of the whole text; null has none of them.

    Upper-case letters are A-Z; an echo is a word equal to the one before it. Input columns named like the new ones are replaced.
    """

    def make():
        return lambda texts: [list(c) for c in zip(*map(measures, texts), strict=True)]

    return attach(df, text, FIELDS, make, keep)


def _rate(part: str, whole: str, scale: int = 1000) -> Column:
    return F.expr(f"({part} * {scale}) div greatest({whole}, 1)")


def rates() -> dict[str, Column]:
    return {
        "symbol_rate": _rate("n_symbols", "word_chars"),
        "upper_rate": _rate("n_upper", "word_chars"),
        "dup_line_rate": _rate("n_dup_lines", "n_lines"),
        "repeat_rate": _rate("n_repeat_words", "n_words"),
        "echo_rate": _rate("n_echoes", "n_words"),
        "long_rate": _rate("word_chars", "n_words"),
    }


def sketch_bin(value: Column) -> Column:
    """Number of the bin that holds a non-negative integer; grows with it."""
    power = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(power * 16 + _shifted(value, power)).cast("long")


def _shifted(value: Column, power: Column) -> Column:
    return F.call_function("shiftright", value, power)


def bin_top(number: Column) -> Column:
    """Largest value of a bin."""
    power = F.floor(number / 16).cast("int") - 1
    lead = (number % 16) + 16
    top = F.call_function("shiftleft", lead + 1, power) - 1
    return F.when(number < 32, number).otherwise(top).cast("long")


def sketches(df: DataFrame, groups: list[str]) -> DataFrame:
    """Counts per group, rate and bin: one row per non-empty bin."""
    pairs = F.array(*[F.struct(F.lit(n).alias("rate"), sketch_bin(F.col(n)).alias("bin")) for n in RATES])
    rows = df.select(*groups, F.explode(pairs).alias("p")).select(*groups, "p.*")
    return rows.groupBy(*groups, "rate", "bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of larger groups by adding those of the smaller."""
    return sketch.groupBy(*groups, "rate", "bin").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, groups: list[str], suffix: str) -> DataFrame:
    """One row per group: its rows, and the largest accepted value of each rate."""
    key = [*groups, "rate"]
    by = Window.partitionBy(*key)
    up = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"_up": F.sum("n").over(up), "_all": F.sum("n").over(by)})
    quantiles = [
        F.min(F.when(F.col("_up") * d >= F.col("_all") * n, bin_top(F.col("bin")))).alias(name)
        for name, (n, d) in QUANTILES.items()
    ]
    rows = ranked.groupBy(*key).agg(*quantiles, F.max("_all").alias("_rows"))
    tolerance = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])[F.col("rate")]
    fence = F.col("high") + FENCE * (F.col("high") - F.col("low"))
    rows = rows.withColumn("limit", F.greatest(fence, F.col("middle") + tolerance))
    found = [F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"{r}_{suffix}") for r in RATES]
    return rows.groupBy(*groups).agg(F.max("_rows").alias(f"_rows_{suffix}"), *found)


def judge(df: DataFrame, counted: DataFrame) -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``; the sketches are those of ``counted``.

    Both have ``_lang`` and ``_source`` beside the counts. Null languages and sources are groups of
    their own. Every row of ``df`` gets one row back.
    """
    rated = df.withColumns(rates())
    by_source = stored(sketches(counted.withColumns(rates()), ["_lang", "_source"]), "sketches")
    by_lang = merged(by_source, ["_lang"])
    whole = merged(by_lang, [])
    out = rated
    for sketch, groups, suffix in (
        (by_source, ["_lang", "_source"], "s"),
        (by_lang, ["_lang"], "l"),
        (whole, [], "w"),
    ):
        found = limits(sketch, groups, suffix)
        if groups:
            renamed = found.select(*[F.col(g).alias(f"{g}_{suffix}") for g in groups], *found.columns[len(groups) :])
            same = F.lit(True)
            for g in groups:
                same = same & F.col(g).eqNullSafe(F.col(f"{g}_{suffix}"))
            out = out.join(renamed, same, "left")
        else:
            # One row; an empty table has none and no rows to judge.
            values = found.first()
            out = out.withColumns({c: F.lit(values[c]) for c in found.columns})
    normal = F.lit(True)
    for rate in RATES:
        limit = (
            F.when(F.col("_rows_s") >= LEAST_ROWS, F.col(f"{rate}_s"))
            .when(F.col("_rows_l") >= LEAST_ROWS, F.col(f"{rate}_l"))
            .otherwise(F.col(f"{rate}_w"))
        )
        normal = normal & (F.col(rate) <= limit)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(*df.columns, failed.alias("base_failed"), (~failed & normal).alias("kept"))


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts beside language, source and some columns, without the texts."""
    rows = docs.select(*keep, *[F.col(f"`{c}`").alias(f"_{c}") for c in ("lang", "source", "text")])
    return measure(rows, "_text", [*keep, "_lang", "_source"])


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Some columns, counts and verdicts of documents; only these are stored, not the texts."""
    counted = stored(_measured(docs, keep), "measured")
    return judge(counted, counted).drop("_lang", "_source")


def remove_failing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged.

    The counts are taken twice, so that neither texts nor row numbers have to be stored.
    """
    rows = measure(boxed(docs, _lang="lang", _source="source"), inside(docs, "text"), ["row", "_lang", "_source"])
    return judge(rows, _measured(docs, [])).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: counts, base verdict and adaptive verdict of every document."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), ["doc_id"])
    names = ["doc_id", *[f.name for f in FIELDS[:5]], "base_failed", "kept"]
    return rows.select(*names)


def oracle_sql() -> str:
    """The same rows from windows, counts and sums over all bins."""
    white, rate_sql = "[\\x20\\x09-\\x0D]", {
        "symbol_rate": ("n_symbols", "word_chars"),
        "upper_rate": ("n_upper", "word_chars"),
        "dup_line_rate": ("n_dup_lines", "n_lines"),
        "repeat_rate": ("n_repeat_words", "n_words"),
        "echo_rate": ("n_echoes", "n_words"),
        "long_rate": ("word_chars", "n_words"),
    }
    rated = ", ".join(f"({a} * 1000) // greatest({b}, 1) AS {r}" for r, (a, b) in rate_sql.items())
    power = "(len(bin(v)) - 5)"
    levels = {"s": "lang, source", "l": "lang", "w": ""}
    parts = []
    for suffix, groups in levels.items():
        keys = f"{groups}, " if groups else ""
        top = "CASE WHEN bin < 32 THEN bin ELSE ((bin % 16 + 17) << (bin // 16 - 1)::INT) - 1 END"
        values = ", ".join(f"min(CASE WHEN up * {d} >= total * {n} THEN {top} END) AS {q}" for q, (n, d) in QUANTILES.items())
        tolerance = "CASE rate " + " ".join(f"WHEN '{r}' THEN {t}" for r, t in RATES.items()) + " END"
        picked = ", ".join(f"max(CASE WHEN rate = '{r}' THEN lim END) AS {r}_lim" for r in RATES)
        parts.append(f"""
        n_{suffix} AS (SELECT {keys}rate, bin, count(*) AS n FROM bins GROUP BY ALL),
        c_{suffix} AS (SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bin) AS up,
          sum(n) OVER (PARTITION BY {keys}rate) AS total FROM n_{suffix}),
        q_{suffix} AS (SELECT {keys}rate, max(total) AS total, {values} FROM c_{suffix} GROUP BY ALL),
        t_{suffix} AS (SELECT *, greatest(high + {FENCE} * (high - low), middle + {tolerance}) AS lim FROM q_{suffix}),
        {suffix} AS (SELECT {keys}max(total) AS n_rows, {picked} FROM t_{suffix} GROUP BY ALL)""")
    checks = " AND ".join(
        f"r.{x} <= CASE WHEN s.n_rows >= {LEAST_ROWS} THEN s.{x}_lim WHEN l.n_rows >= {LEAST_ROWS} THEN l.{x}_lim "
        f"ELSE w.{x}_lim END"
        for x in RATES
    )
    union = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM r" for r in RATES)
    return f"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    a AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
      len(regexp_replace(text, '{white}', '', 'g')) AS word_chars,
      len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM a WHERE len(w) > 4)),
    rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM
      (SELECT doc_id, i, unnest(range(5)) AS o FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1) GROUP BY 1),
    m AS (SELECT a.doc_id, lang, source, len(w) AS n_words, word_chars, n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      len(lines) AS n_lines, n_upper,
      len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echoes
      FROM a LEFT JOIN rep USING (doc_id)),
    r AS (SELECT *, {rated} FROM m),
    vals AS ({union}),
    bins AS (SELECT lang, source, rate,
      CASE WHEN v < 32 THEN v ELSE {power} * 16 + (v >> {power}::INT) END AS bin FROM vals),
    {", ".join(parts)},
    v AS (SELECT r.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
      {checks} AS normal
      FROM r LEFT JOIN s ON r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source
      LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN w)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND normal AS kept FROM v"""
