"""Exact dedup by content sort, on DataFrame functions alone.

Rows are dealt to ranges by splitters that Spark samples, sorted externally by their normalised
bytes, and compared in full with the row before; a run of equal rows is a group. Splitters are
the first bytes of a text and a hash of all of it, so that a sample never holds whole texts: equal
texts have equal splitter keys, and the bytes decide among texts whose keys collide.

A hot text would fill one range. Its hash is found by a bounded frequency sketch, and its rows
are dealt to lanes, each with a range key of its own. One row of every lane is then compared,
again in full, with those of the other lanes, and the counts are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import stored, table, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Leading bytes of a text in a splitter key.
HEAD_BYTES = 24
# A lane holds about one piece of all rows; there are this many pieces per shuffle partition, and at least LEAST_PIECES.
PIECES_PER_PARTITION, LEAST_PIECES = 4, 1024
# Hashes the sketch tracks per hash it may report; its error is then far below one piece.
TRACKED_PER_HOT = 16
NEW = ("keep_id", "group_size", "kept", "text_sha256")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def _hot_lanes(rows: DataFrame) -> DataFrame:
    """Hash and number of lanes of the texts with at least two pieces of all rows; at most half as many rows as pieces."""
    session = rows.sparkSession
    pieces = max(LEAST_PIECES, PIECES_PER_PARTITION * int(session.conf.get("spark.sql.shuffle.partitions")))
    hot = pieces // 2
    sketch = rows.agg(
        F.expr(f"approx_top_k(hash, {hot}, {hot * TRACKED_PER_HOT})").alias("found"), F.count("*").alias("n")
    )
    found = sketch.select("n", F.explode("found").alias("f")).select("n", F.col("f.item").alias("hash"), "f.count")
    lanes = F.ceil(F.col("count") * pieces / F.col("n")).cast("int").alias("lanes")
    return found.filter(F.col("count") * hot >= F.col("n")).select("hash", lanes)


def exact_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and empty texts
    are equal like any others. Of a group the row with the ``smallest`` or ``largest`` id stays,
    rows without an id last; of rows with one id exactly one stays. ``keep_id`` is null where no
    row of the group has an id. ``carry`` names the columns to pass on, all but the text by default; those named like
    new columns, in any case, are replaced. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    carry = [c for c in df.columns if c.lower() != text.lower()] if carry is None else carry
    # A hot text is dealt by all plain columns: rows that repeat an id need not share a lane.
    dealt = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType) and f.name.lower() != text.lower()]
    body = lower_ascii(whole_text(f"`{text}`")).cast("binary")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_column}`").alias("id"),
        body.alias("body"),
        F.xxhash64(F.lit(0), *dealt).alias("deal"),
    ).withColumn("hash", F.xxhash64("body"))
    # Written down: at most half as many rows as pieces, whatever the input.
    hot = stored(_hot_lanes(df.select(F.xxhash64(body).alias("hash"))), "hot-texts")
    rows = rows.join(F.broadcast(hot), "hash", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    rows = rows.withColumn("lane", F.pmod(F.col("deal"), F.col("lanes"))).drop("deal")
    rows = rows.withColumn("head", F.substring("body", 1, HEAD_BYTES))

    key = ["head", "hash", "lane"]
    order = F.asc_nulls_last("id") if keep == "smallest" else F.desc_nulls_last("id")
    best = F.min if keep == "smallest" else F.max
    # The windows work on the ranges as they are dealt: sorted once by content, once more without it.
    sorted_ = Window.partitionBy(*key).orderBy("body", order)
    ranged = rows.repartitionByRange(*key)
    starts = ~F.col("body").eqNullSafe(F.lag("body").over(sorted_))
    begun = ranged.withColumn("starts", starts)
    begun = begun.withColumn("run", F.sum(F.col("starts").cast("int")).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    slim = begun.select(
        "row",
        "id",
        *key,
        "run",
        "starts",
        F.sha2("body", 256).alias("digest"),
        F.when((F.col("lanes") > 1) & F.col("starts"), F.col("body")).alias("body"),
    )
    run = Window.partitionBy(*key, "run")
    slim = slim.withColumn("run_keep", best("id").over(run)).withColumn("run_size", F.count("*").over(run))
    runs = stored(slim.drop("id", "head"), "runs")

    # One row per lane of a hot text: about three rows per two pieces, whatever the input.
    first = Window.partitionBy("body").orderBy(
        F.asc_nulls_last("run_keep") if keep == "smallest" else F.desc_nulls_last("run_keep"), "lane"
    )
    across = Window.partitionBy("body")
    lanes = runs.filter(F.col("body").isNotNull()).select(
        "hash",
        "lane",
        "run",
        best("run_keep").over(across).alias("all_keep"),
        F.sum("run_size").over(across).alias("all_size"),
        (F.row_number().over(first) == 1).alias("wins"),
    )
    joined = runs.drop("body").join(stored(lanes, "lanes"), ["hash", "lane", "run"], "left")
    inside_lanes = F.col("all_size").isNotNull()
    return joined.select(
        *[F.col(f"row.`{c}`").alias(c) for c in carry if c.lower() not in NEW],
        F.when(inside_lanes, F.col("all_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("all_size", "run_size").cast("long").alias("group_size"),
        (F.col("starts") & F.coalesce("wins", F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, whole, as ``exact_duplicates`` decides; columns named like its new ones are kept."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return exact_duplicates(held, "id", "text", keep, ["held"]).filter("kept").select("held.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, with the largest id of each text kept."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest", carry=["doc_id"])


def oracle_sql() -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256)"""
