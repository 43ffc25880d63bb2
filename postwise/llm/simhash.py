"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into segments and mapped to the number of bits set in each. A bit that differs
changes one count by one, so the Manhattan distance of two such vectors is at most the number of
differing bits: a lower bound in a space with few values per axis. Fingerprints within
``most`` bits are found by a grid range join on these vectors: the axes fall into more blocks than
``most``, the total change is shared out among the blocks, so in every pair at least ``blocks - most``
blocks do not change at all. Each choice of so many blocks is one grid; its cell is the counts of
those blocks, and a pair within reach shares a cell in some grid. In a cell the lower bound is
checked over all axes, then the bits are compared.

Only distinct fingerprints enter the grids. A cell with many is not turned into pairs: it is dealt in
tiles of bounded size, and a tile returns a spanning forest of its links, which keeps every
component. Components come from repeated linking to smaller neighbours, with each
round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, boxed, stored, table

SHINGLE = 3
MOST_BITS = 3
SEED = 42
# Segments of two bits, and the blocks of segments whose choices make the grids: 20 grids.
SEGMENT_BITS = 2
BLOCKS = 6
# Fingerprints of one cell that a tile holds on each side.
TILE = 1024
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingles(body: bytes, size: int) -> list[bytes]:
    """Word shingles of the lower-cased text (A-Z only), repeats included; short texts have one."""
    words = body.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def fingerprint(parts: list[bytes]) -> int:
    """Bit i is set where it is set in over half of the XXH64 values; zero without any."""
    from xxhash import xxh64_intdigest

    if not parts:
        return 0
    hashes = np.array([xxh64_intdigest(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, size: int = SHINGLE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``fp``, the 64-bit fingerprint of the whole text as a signed long; null counts as empty."""

    def make():
        return lambda texts: [np.array([fingerprint(shingles(t, size)) for t in texts], np.uint64).astype(np.int64)]

    return attach(df, text, [T.StructField("fp", T.LongType())], make, keep)


LOW_BITS = 0x5555555555555555


def _unary_counts(fp: Column) -> Column:
    """Set bits of every two-bit segment in unary, in the place of its bits: 0 as 00, 1 as 01, 2 as 11.

    The Manhattan distance of two vectors of counts is then the number of differing bits.
    """
    high, low = F.call_function("shiftrightunsigned", fp, F.lit(1)), F.lit(LOW_BITS)
    any_bit = fp.bitwiseOR(high).bitwiseAND(low)
    both_bits = fp.bitwiseAND(high).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both_bits, 1))


def _block_masks(blocks: int) -> list[int]:
    """Masks over the 64 places, each covering whole segments; sizes differ by one segment at most."""
    segments = 64 // SEGMENT_BITS
    edges = [round(i * segments / blocks) * SEGMENT_BITS for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(points: DataFrame, most: int) -> DataFrame:
    """One row per point and grid: ``grid``, ``cell`` (the counts of the unchanged blocks) and ``fp``."""
    masks = _block_masks(max(BLOCKS, most + 1))
    chosen = combinations(range(len(masks)), len(masks) - most)
    grids = [F.lit(_signed(reduce(int.__or__, (masks[i] for i in c)))) for c in chosen]
    counted = points.select("fp", _unary_counts(F.col("fp")).alias("_counts"))
    pairs = F.array(
        *[F.struct(F.lit(g).alias("grid"), F.col("_counts").bitwiseAND(m).alias("cell")) for g, m in enumerate(grids)]
    )
    return counted.select("fp", F.explode(pairs).alias("c")).select("c.grid", "c.cell", "fp")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """As ``_unary_counts``, for unsigned arrays."""
    high, low, one = fp >> np.uint64(1), np.uint64(LOW_BITS), np.uint64(1)
    return ((fp | high) & low) | ((fp & high & low) << one)


def forest(left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links that span the components of all links inside ``left``, or between ``left`` and ``right``."""
    points = left if right is None else np.concatenate([left, right])
    unary = unary_counts(points)
    n, split = len(points), len(left)
    component = np.arange(n)
    out = []
    for i in range(n if right is None else split):
        first = i + 1 if right is None else split
        near = np.flatnonzero(np.bitwise_count(unary[first:] ^ unary[i]) <= most) + first
        near = near[component[near] != component[i]]
        near = near[np.bitwise_count(points[near] ^ points[i]) <= most]
        if len(near):
            # One link to each component met; then they are one.
            met, where = np.unique(component[near], return_index=True)
            out += [(int(points[i]), int(points[j])) for j in near[where]]
            component[np.isin(component, met)] = component[i]
    return out


def links(points: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links ``a``, ``b`` (fingerprints within ``most`` bits) that span every component of ``points``.

    ``points`` holds distinct ``fp``. A cell of n points is dealt in tiles: points fall into
    n / TILE parts by a hash, and each pair of parts is a tile of its own. Cells with one point drop out.
    """
    if not 0 <= most <= 60:
        raise ValueError("most must be between 0 and 60")
    placed = stored(cells(points, most), "cells")
    sizes = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    dealt = placed.join(sizes, ["grid", "cell"]).withColumn("_parts", parts)
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int"))
    # A point meets the parts after its own as the left side and those before as the right side.
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    tiles = dealt.withColumn("_other", other).select(
        "grid",
        "cell",
        F.least("_part", "_other").alias("i"),
        F.greatest("_part", "_other").alias("j"),
        (F.col("_part") <= F.col("_other")).alias("on_left"),
        "fp",
    )
    key = ["grid", "cell", "i", "j"]
    ordered = tiles.repartition(*key).sortWithinPartitions(*key)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, on_left, fps = None, [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            side, points_ = np.concatenate(on_left), np.concatenate(fps)
            same = last[2] == last[3]
            found = forest(points_, None, most) if same else forest(points_[side], points_[~side], most)
            out.extend(found)

        def packed() -> pa.RecordBatch:
            ends = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            n = batch.num_rows
            new = np.ones(n, bool)
            if n:
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]])
            starts = [*np.flatnonzero(new).tolist(), n]
            for a, b in zip(starts, starts[1:], strict=False):
                this = tuple(int(c[a]) for c in columns[:4])
                if last is not None and this != last:
                    close()
                    on_left, fps = [], []
                last = this
                on_left.append(columns[4][a:b].astype(bool))
                fps.append(columns[5][a:b].astype(np.int64).view(np.uint64))
            if len(out) > 50_000:
                yield packed()
        if last is not None:
            close()
        yield packed()

    found = ordered.mapInArrow(span, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp``, ``root`` for every point of the links: the smallest point of its component.

    Alternates links of all larger neighbours to the smallest one and links of all smaller neighbours
    to the smallest one, until nothing changes; a star of depth one is left. Each
    step shuffles links alone and is written down.
    """
    edges = stored(edges, "links")

    def summary(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = summary(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
        edges = large.filter("a <> b").distinct()
        down = edges.toDF("u", "v")  # v is the larger end
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(low, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
        small = small.union(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "links")
        after = summary(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))


def near_duplicates(
    df: DataFrame, size: int = SHINGLE, most: int = MOST_BITS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``df``: the id, ``fp`` and ``component``, the smallest id reachable.

    Fingerprints within ``most`` bits are linked, components are closed under links. Texts
    without words have fingerprint 0 and are linked like any other. Null ids keep their rows; a
    component of null ids alone has a null component. Repeated rows stay repeated. Columns of ``df`` other than
    the id are left out, whatever their names; an empty table gives an empty result.
    """
    slim = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = stored(fingerprints(slim, size, "_text", keep=["_id"]), "fingerprints")
    named = _rooted(rows, most)
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    answer = named.join(smallest, "root").select("fp", "component")
    return rows.join(answer, "fp").select(F.col("_id").alias(id_column), "fp", "component")


def _rooted(rows: DataFrame, most: int) -> DataFrame:
    """``fp``, its smallest id ``least`` and the ``root`` of its component."""
    points = stored(rows.groupBy("fp").agg(F.min("_id").alias("least")), "points")
    roots = components(links(points.select("fp"), most))
    return points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(
    df: DataFrame, size: int = SHINGLE, most: int = MOST_BITS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component of near-duplicates, with its columns unchanged.

    The row with the smallest id stays, a null id last; among rows with one id the smaller fingerprint
    and then the smaller hash of the whole row decide, and of equal rows one stays.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    slim = df.select(F.col(f"`{id_column}`").alias("_id"), mark.alias("_mark"), F.col(f"`{text}`").alias("_text"))
    rows = stored(fingerprints(slim, size, "_text", keep=["_id", "_mark"]), "fingerprints")
    copies = rows.groupBy("_id", "fp", "_mark").agg(F.count("*").alias("n"))
    ranked = F.struct(F.col("_id").isNull().alias("none"), "_id", "fp", "_mark", "n")
    chosen = copies.join(_rooted(rows, most).select("fp", "root"), "fp").groupBy("root").agg(F.min(ranked).alias("r"))
    chosen = stored(chosen.select("root", F.col("r._id").alias("_id"), F.col("r._mark").alias("_mark"), "r.n"), "chosen")
    wide = boxed(df, _own=id_column).withColumn("_mark", F.xxhash64("row.*"))
    same = [wide["_mark"] == chosen["_mark"], wide["_own"].eqNullSafe(chosen["_id"])]
    kept = wide.join(chosen, same, "inner").select("row", "root", "n")
    repeated = kept.filter("n > 1").groupBy("root").agg(F.first("row").alias("row"))
    return kept.filter("n = 1").select("row.*").unionByName(repeated.select("row.*"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
