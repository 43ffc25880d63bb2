"""Fill-in-middle transformation over a compressed set of token boundaries.

The places where tokens of a text end are a set of integers. It is held as in compressed bitmaps: places are cut into
chunks of 65,536, and every chunk is an array of 16-bit values, a bitmap or a list of runs,
whichever is smallest, with cumulative cardinalities over the chunks. The place where the k-th token ends
is a search for the chunk and a select inside it; both cuts of a document are read that way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, table, whole_text

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
BITMAP_BYTES = CHUNK // 8
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
# Shares in percent: texts left plain, and the suffix-first form among the others.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
FIELDS = (
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
)


@dataclass(frozen=True)
class ArrayContainer:
    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class BitmapContainer:
    """65,536 bits, and how many are set before each byte."""

    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> BitmapContainer:
        flags = np.zeros(CHUNK, dtype=bool)
        flags[values] = True
        bits = np.packbits(flags, bitorder="little")
        return cls(bits, np.concatenate(([0], np.cumsum(POPCOUNT[bits], dtype=np.int64))))

    def select(self, k: int) -> int:
        byte = int(np.searchsorted(self.before, k, side="right")) - 1
        word, left = int(self.bits[byte]), k - int(self.before[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1


@dataclass(frozen=True)
class RunContainer:
    """Starts of the runs of neighbouring values, and how many values come before each run."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def _container(values: np.ndarray):
    """The smallest of the three containers; ``values`` ascend within one chunk."""
    heads = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    if 2 + 4 * len(heads) < min(2 * len(values), BITMAP_BYTES):
        return RunContainer(values[heads].astype(np.uint16), heads)
    if 2 * len(values) <= BITMAP_BYTES:
        return ArrayContainer(values.astype(np.uint16))
    return BitmapContainer.of(values)


class BoundarySet:
    """Ascending places as chunk keys, containers and cumulative cardinalities."""

    def __init__(self, places: np.ndarray) -> None:
        chunks = places >> CHUNK_BITS
        cuts = np.flatnonzero(np.diff(chunks, prepend=-1))
        self.keys = chunks[cuts]
        self.before = np.append(cuts, len(places))
        self.containers = [
            _container(places[a:b] & (CHUNK - 1)) for a, b in zip(self.before[:-1], self.before[1:], strict=True)
        ]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th place, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[at]) << CHUNK_BITS) + self.containers[at].select(k - int(self.before[at]))


def token_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in code points at which tokens end, and the byte at which each code point starts, with the length last.

    A token is a run of letters A-Z and a-z, or any other single code point.
    """
    codes = np.frombuffer(text, dtype=np.uint8)
    starts = np.flatnonzero((codes & 0xC0) != 0x80)
    low = codes[starts] | 0x20
    letter = (low >= ord("a")) & (low <= ord("z"))
    inner = letter[:-1] & letter[1:]
    ends = np.append(np.flatnonzero(~inner) + 1, len(starts)) if len(starts) else np.zeros(0, dtype=np.int64)
    return ends, np.append(starts, len(codes))


def draw_digest(doc_id: Column) -> Column:
    """Hex digest from which a document's numbers are drawn; a null id counts as the empty text."""
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)


def transform(text: bytes, digest: str) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, code points of prefix and middle, and the output of one text."""
    ends, starts = token_ends(text)
    bounds = BoundarySet(ends)
    n = len(bounds)
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (bounds.select(k - 1) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[: starts[a]], text[starts[a] : starts[b]], text[starts[b] :]
    p, s, m = MARKS
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def fill_in_middle(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every whole text.

    A text is cut at two token ends that the id decides. ``psm`` and ``spm`` are prefix, suffix and middle behind
    their marks, in that order or suffix first; ``plain`` is the text itself: the empty text (null counts as empty), texts that hold
    a mark, and the share that the id leaves out. Rows with a null id are cut like each other. Equal rows
    have equal results; an empty table gives an empty one. ``keep`` names the input columns to pass on, all by
    default; those named like new columns, in any case, are replaced.
    """
    new = {f.name.lower() for f in FIELDS}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # The digest, 64 digits, travels before the text, so that no column of the input can meet it.
    boxed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.concat(draw_digest(F.col(f"`{id_column}`")), whole_text(f"`{text}`")).alias("work"),
    )

    def make():
        def run(works: list[bytes]) -> list:
            made = [transform(w[64:], w[:64].decode()) for w in works]
            return [list(column) for column in zip(*made, strict=True)] if made else [[] for _ in FIELDS]

        return run

    made = attach(boxed, "work", FIELDS, make, keep=["row"])
    return made.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[f.name for f in FIELDS])


def restore(output: Column, form: Column) -> Column:
    """The text behind an output; only the output and its form are read.

    Texts that hold a mark stay plain, and no mark can begin or end inside another, so the first
    mark of each kind is the one that was put there.
    """

    def between(begin: str | None, end: str | None) -> Column:
        after = F.substring_index(output, begin, -1) if begin else output
        return F.substring_index(after, end, 1) if end else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents cut, with digests of the outputs and of the texts restored from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    draw = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, tokens, len(tokens) AS n, {draw.format(1)} % (len(tokens) + 1) AS x,
    {draw.format(9)} % (len(tokens) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
        OR {draw.format(17)} % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN {draw.format(25)} % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(tokens[1:least(x, y)], '') AS p,
    array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(tokens[greatest(x, y) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
