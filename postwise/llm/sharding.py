"""Minimax contiguous partition of atomic groups into shards.

Groups of equal texts, ordered by the SHA-256 of the text, are cut into at most ``shards``
runs so that the largest run is as small as possible. The capacity is found by
binary search with a greedy check. The check never sees all groups: it works on
sums per digest prefix, and only prefixes in which a cut can fall are split further,
until every cut falls between single groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwise.llm.common import stored, table, whole_text

# Hex digits by which a prefix is refined: 4,096 sums per refined prefix.
STEP = 3
# Buckets of ids used to number the rows of a shard without sorting it in one task.
SLOT_BUCKETS = 8192


@dataclass(frozen=True)
class Segment:
    """A run of groups with a common digest prefix: total and number of groups."""

    prefix: str
    total: int
    groups: int


class _Bounds:
    """Greedy cuts bounded from below and above by what the segments tell.

    Segment ends are group ends. A cut at most at ``x`` is at least the last segment end up
    to ``x``; it is at most ``x`` itself, or the begin of the segment around ``x`` where that
    holds a single group.
    """

    def __init__(self, segments: list[Segment], shards: int) -> None:
        self.ends = np.cumsum([0] + [s.total for s in segments], dtype=np.int64)
        self.single = np.array([s.groups == 1 for s in segments] + [False])
        self.total, self.shards = int(self.ends[-1]), shards

    def cuts(self, capacity: int, latest: bool) -> list[int]:
        at, found = 0, []
        for _ in range(self.shards):
            aim = min(at + capacity, self.total)
            i = int(np.searchsorted(self.ends, aim, side="right")) - 1
            at = aim if latest and not self.single[i] else int(self.ends[i])
            found.append(at)
        return found

    def smallest(self, low: int, latest: bool) -> int:
        """Smallest capacity of at least ``low`` whose runs reach the end."""
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, latest)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int, size: str = "size") -> list[str]:
    """Digests at which the shards after the first begin; fewer when the last shards stay empty.

    ``groups`` has one row per group: ``digest`` (hex) and a positive ``size``. The driver holds
    4,096 sums at first and at most 4,096 more for every refined prefix, whatever the number
    of groups; the refined prefixes are the few around the cuts.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def sums(frame: DataFrame, digits: int) -> tuple[list[Segment], int]:
        prefix = F.substring("digest", 1, digits).alias("prefix")
        rows = frame.groupBy(prefix).agg(F.sum(size).alias("total"), F.count("*").alias("n"), F.max(size).alias("most"))
        found = [(Segment(r["prefix"], int(r["total"]), r["n"]), int(r["most"])) for r in rows.collect()]
        return [s for s, _ in sorted(found, key=lambda x: x[0].prefix)], max((m for _, m in found), default=0)

    digits = STEP
    segments, largest = sums(groups, digits)
    if not segments:
        return []
    while True:
        bounds = _Bounds(segments, shards)
        low = bounds.smallest(largest, latest=True)
        high = bounds.smallest(low, latest=False)
        open_ = set()
        for first, last in zip(bounds.cuts(low, latest=False), bounds.cuts(high, latest=True), strict=True):
            i = int(np.searchsorted(bounds.ends, first, side="right")) - 1
            while i < len(segments) and bounds.ends[i] < last:
                if segments[i].groups > 1:
                    open_.add(i)
                i += 1
        if not open_:
            starts = {int(e): s.prefix for e, s in zip(bounds.ends, segments, strict=False)}
            return [starts[c] for c in dict.fromkeys(bounds.cuts(high, latest=False)) if c < bounds.total]
        digits += STEP
        wanted = [segments[i].prefix for i in sorted(open_)]
        lengths = sorted({len(p) for p in wanted})
        match = F.lit(False)
        for length in lengths:
            match = match | F.substring("digest", 1, length).isin([p for p in wanted if len(p) == length])
        owners, parts = set(wanted), {}
        for part in sums(groups.filter(match), digits)[0]:
            owner = next(part.prefix[:n] for n in lengths if part.prefix[:n] in owners)
            parts.setdefault(owner, []).append(part)
        segments = [x for i, s in enumerate(segments) for x in (parts[s.prefix] if i in open_ else [s])]


def shard_documents(df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``size``, ``text_crc32``, ``digest``, ``shard`` and ``slot``, without the text.

    Size is the UTF-8 length plus 1. Equal texts always share a shard; null counts as
    the empty text. A group larger than an even share fills a shard alone. Slots number the
    rows of a shard from 0 without gaps; repeated rows get slots of their own. An empty
    table gives an empty result. Input columns named like the new ones are replaced.
    """
    new = ("size", "text_crc32", "digest", "shard", "slot")
    body = whole_text(text).cast("binary")
    others = [c for c in df.columns if c.lower() not in (*new, text.lower())]
    rows = stored(
        df.select(
            *[F.col(f"`{c}`") for c in others],
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.sha2(body, 256).alias("digest"),
        ),
        "sized",
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    shard = F.lit(0)
    for cut in minimax_cuts(groups, shards):
        shard = shard + (F.col("digest") >= cut).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    # Rows are numbered inside id buckets and shifted by the bucket counts: no task holds a shard.
    bucket = F.pmod(F.xxhash64(id_column), F.lit(SLOT_BUCKETS))
    placed = placed.withColumn("_bucket", bucket)
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy(id_column, "digest")
    numbered = placed.withColumn("_rank", F.row_number().over(within))
    # At most shards x SLOT_BUCKETS offsets.
    joined = numbered.join(F.broadcast(offsets), ["shard", "_bucket"])
    slot = (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot")
    return joined.select(*[F.col(f"`{c}`") for c in others], "size", "text_crc32", "digest", "shard", slot)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in eight shards of near equal bytes."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
