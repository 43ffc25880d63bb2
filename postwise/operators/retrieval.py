"""TF-IDF weights of a corpus and exact top-k cosine retrieval."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwise.functions.text import WORD
from postwise.session import folder, writing

# A term counts as frequent from one part in this many of all postings, so there
# are never more frequent terms than this: the bound of the broadcast side.
FREQUENT_TERMS = 100_000
# Characters of text that one task of the term counts cuts into words.
TASK_CHARS = 8_000_000
# Counts are stored in this many folders by key; a refresh weighs one folder after another, so that
# the shuffles of one are all that is on disk beside the tables. A power of two.
SLICES = 8
# Postings of a bucket of the stored vectors, about: what one task reads.
BUCKET_POSTINGS = 1_000_000
# The tables of an index are stored for long and read seldom.
CODEC = "zstd"


def terms(text: Column) -> Column:
    """Lowercase tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def _placed(docs: DataFrame, key: str, text: str, multiple: int) -> DataFrame:
    """Texts by key, at most some ``TASK_CHARS`` in a partition; where the cores suffice for that, Spark chooses the number."""
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    parts = -(-chars // (TASK_CHARS * multiple)) * multiple
    rows = docs.select(key, text)
    return rows.repartition(parts, key) if parts > docs.sparkSession.sparkContext.defaultParallelism else rows.repartition(key)


def term_counts(docs: DataFrame, key: str, text: str = "text", multiple: int = 1) -> DataFrame:
    """(key, term, tf); a document without terms has no rows.

    The texts are placed by document key before they are cut, so the count per
    document and term needs no shuffle of the much larger token rows. The number of partitions follows
    the length of the texts, found by a pass of its own, because a task's counts take many times their room;
    it is a ``multiple`` of the caller's.
    """
    tokens = _placed(docs, key, text, multiple).select(key, F.explode(terms(F.col(text))).alias("term"))
    return tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def join_weights(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts with the idf of their term.

    Frequent terms fill most postings, so a plain join would send one term to
    one task. They are split off and joined by broadcast (their number is
    bounded, see ``FREQUENT_TERMS``); the rest is joined by shuffle.
    """
    cut = weights.agg(F.sum("df") / FREQUENT_TERMS).scalar()
    frequent = F.broadcast(weights.filter(F.col("df") >= cut).select("term", "idf"))
    rare = weights.filter(F.col("df") < cut).select("term", "idf")
    hot = counts.join(frequent, "term")
    cold = counts.join(frequent.select("term"), "term", "left_anti").join(rare, "term")
    return hot.unionByName(cold)


def unit_vectors(weighted: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, entries) with the (term, weight) entries of every document scaled to length one; in ``parts`` by key, if named."""
    raw = weighted.select(key, "term", (F.col("tf") * F.col("idf")).alias("_raw"))
    placed = raw.repartition(parts, key) if parts else raw
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm")
    # Two lists of one aggregation have one order.
    found = placed.groupBy(key).agg(norm, F.collect_list("term").alias("_terms"), F.collect_list("_raw").alias("_raws"))
    unit = F.zip_with("_terms", "_raws", lambda t, x: F.struct(t.alias("term"), (x / F.col("_norm")).alias("weight")))
    return found.select(key, unit.alias("entries"))


def unit_weights(weighted: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) with every document scaled to length one."""
    return unit_vectors(weighted, key).select(key, F.inline("entries"))


def append_index(docs: DataFrame, path: str, batch: str, key: str = "doc_id", text: str = "text") -> None:
    """Count the terms of new documents; nothing stored before is read or changed.

    Three tables grow by one folder each: ``counts`` (key, term, tf), ``frequencies`` (term, df) and
    ``sizes`` (n). The last one written makes the batch count; a batch of the same name
    replaces itself, so a failed one can be replayed. Documents must not be in another batch.
    """
    spark = docs.sparkSession

    def place(name: str) -> str:
        return f"{path}/{name}/batch={batch}"

    with writing(spark):
        # A task's keys are all of one slice, because slices divide the partitions.
        found = term_counts(docs, key, text, SLICES).withColumn("slice", F.pmod(F.hash(key), F.lit(SLICES)))
        found.write.mode("overwrite").partitionBy("slice").parquet(place("counts"), compression=CODEC)
        # A batch without terms leaves its columns all the same.
        none = spark.createDataFrame([], found.drop("slice").schema)
        none.write.mode("append").parquet(f"{place('counts')}/slice=0")
        counts = spark.read.parquet(place("counts"))
        counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(place("frequencies"))
        docs.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place("sizes"))


def _batches(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the finished batches of a table."""
    rows = spark.read.parquet(f"{path}/{name}")
    finished = [str(r["batch"]) for r in spark.read.parquet(f"{path}/sizes").select("batch").distinct().collect()]
    return rows.filter(F.col("batch").cast("string").isin(finished)).drop("batch")


def corpus_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, idf) of all batches: document frequencies add up. The idf is ``ln((1 + n) / (1 + df)) + 1``."""
    n = _batches(spark, path, "sizes").agg(F.sum("n")).scalar()
    df = _batches(spark, path, "frequencies").groupBy("term").agg(F.sum("df").alias("df"))
    return df.withColumn("idf", F.log((1 + n) / (1.0 + F.col("df"))) + 1.0)


def refresh_index(spark: SparkSession, path: str, key: str = "doc_id") -> None:
    """Weigh the counts of all batches by the frequencies of now: the tables ``terms`` and ``vectors``.

    No text is read. Each table is read back for the next, so a lost executor costs one step at most. ``vectors`` has
    one row per document with its (term, weight) entries, in buckets by key, so no later read needs to place
    them. The slices of the counts are weighed in turn, few of them at once where there are many postings.
    """
    with writing(spark):
        corpus_terms(spark, path).write.mode("overwrite").parquet(f"{path}/terms")
        weights = spark.read.parquet(f"{path}/terms")
        counts = _batches(spark, path, "counts")
        postings = weights.agg(F.sum("df")).first()[0] or 0
        rounds = 1
        while rounds < SLICES and rounds * BUCKET_POSTINGS < postings:
            rounds *= 2
        buckets = -(-postings // (BUCKET_POSTINGS * rounds)) * rounds
        spark.range(1).select(F.lit(buckets).alias("n")).write.mode("overwrite").parquet(f"{path}/buckets")
        if not buckets:
            unit_vectors(join_weights(counts, weights), key).write.mode("overwrite").parquet(f"{path}/vectors")
            return
        files, place = folder(spark, f"{path}/vectors")
        files.delete(place, True)
        table = _enter_vectors(spark, path, key, counts.schema[key].dataType.simpleString(), buckets)
        for i in range(rounds):
            weighted = join_weights(counts.filter(F.col("slice") % rounds == i), weights)
            unit_vectors(weighted, key, buckets).write.insertInto(table)


def _enter_vectors(spark: SparkSession, path: str, key: str, key_type: str, buckets: int) -> str:
    """The catalog name of the ``vectors`` below ``path``; this session's catalog then knows their buckets."""
    name = f"vectors_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    at = f"{path}/vectors".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} (`{key}` {key_type}, entries ARRAY<STRUCT<term: STRING, weight: DOUBLE>>) USING parquet "
        f"OPTIONS (compression '{CODEC}') CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{at}'"
    )
    return name


def read_vectors(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, entries) rows of a stored index, known to Spark as placed by key."""
    rows = spark.read.parquet(f"{path}/vectors")
    buckets = spark.read.parquet(f"{path}/buckets").first()["n"]
    return spark.table(_enter_vectors(spark, path, key, rows.schema[key].dataType.simpleString(), buckets)) if buckets else rows


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """An index of one batch below ``path``, ready for retrieval."""
    append_index(docs, path, "first", key, text)
    refresh_index(docs.sparkSession, path, key)


def read_postings(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, term, weight) rows of a stored index."""
    return spark.read.parquet(f"{path}/vectors").select(key, F.inline("entries"))


def query_weights(queries: DataFrame, weights: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Unit-length weights of the queries; terms outside the corpus are ignored."""
    counts = term_counts(queries, key, text)
    return unit_weights(join_weights(counts, weights), key)


def retrieve(
    query_rows: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    doc_key: str = "doc_id",
    placed: bool = False,
) -> DataFrame:
    """Top ``k`` documents per query by cosine, similarity above zero only.

    The stored vectors are placed by document once, whatever the number of queries, or not at all if they are
    ``placed`` already, as those of ``read_vectors`` are. Each task then joins its
    documents' terms with the query weights and adds up the similarities of its own documents,
    only for pairs that share a term; the best ``k`` per query of every task are all that is shuffled. Where the
    query weights are beyond the broadcast threshold, terms are joined by shuffle, frequent query
    terms spread by adaptive execution. Ties fall to the lower document key; similarities are
    compared at ten decimals. Keys may be of any orderable type.
    """
    rows = vectors.select(doc_key, "entries")
    entries = (rows if placed else rows.repartition(doc_key)).select(doc_key, F.inline("entries"))
    wanted = query_rows.select(query_key, "term", F.col("weight").alias("_wanted"))
    matched = entries.join(wanted, "term").select(query_key, doc_key, (F.col("weight") * F.col("_wanted")).alias("_part"))
    sums = matched.groupBy(query_key, doc_key).agg(F.round(F.sum("_part"), 10).alias("similarity"))
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), doc_key)
    ranked = sums.filter(F.col("similarity") > 0).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)
