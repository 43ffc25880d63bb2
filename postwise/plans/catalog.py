"""Registered queries: every operator over the whole given tables.

Times are returned as text and computed numbers rounded to six decimals, so
that results of different engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwise import schemas
from postwise.functions import handles, scoring, text, verdicts
from postwise.operators import (
    clustering,
    dedup,
    emotion,
    energy,
    features,
    incremental,
    ingest,
    phrases,
    reliability,
    reports,
    retrieval,
)
from postwise.operators import service_metrics as metrics
from postwise.plans import given, jobs
from postwise.session import scratch_path, stored
from postwise.sources import keys, models, parameters, tables
from postwise.streaming import posts as post_streams
from postwise.streaming import windows as window_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Whole words that occur in the given documents, in the place of the news keywords.
DOCUMENT_THEMES = {
    "Discover": ["license", "idiot"],
    "Trending": ["was"],
    "Hot Topics": ["pathetic", "Scum"],
    "Misinformation": ["with"],
}
# Partitions of the state of the registered streams; a choice for their small inputs.
STATE_PARTITIONS = 8
PAGE_DOMAINS = ["example.com", "example.org"]


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def six(c: Column | str) -> Column:
    """Round half away from zero on the scaled value, as both engines compute it."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6, 0) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: six(name) for name in names})


def clock(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def clock_micros(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# Sources and sinks


@query
def landing_posts(spark, sf):
    path = scratch_path(spark, "landing")
    given.payloads(spark, sf).write.json(path)
    return tables.read_landing(spark, path)


@query
def quarantined_payloads(spark, sf):
    """Landed lines by what becomes of them; a tenth is cut short and a tenth has no text."""
    landing, aside = scratch_path(spark, "landing"), scratch_path(spark, "quarantine")
    number = F.substring_index("uri", "/", -1).cast("long")
    rows = given.payloads(spark, sf).withColumn("number", number)
    rows = rows.withColumn("text", F.when(number % 10 != 7, F.col("text")))
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "arrival_date"]))
    cut = F.when(number % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    rows.select(cut.alias("value")).write.text(landing)
    lines = tables.read_lines(spark, landing)
    tables.append(tables.rejected_lines(lines), aside, loaded_at="rejected_at")
    kept = tables.landed_payloads(lines).select(F.lit("stored").alias("outcome"), "uri")
    outcomes = kept.unionByName(spark.read.parquet(aside).select(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("uri")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def posts_view(spark, sf):
    return tables.posts_view(given.cleaned(spark, sf)).withColumn("created_at", clock_micros("created_at"))


@query
def classified_view(spark, sf):
    stored = given.classified(spark, sf).withColumn("classified_at", tables.parse_instant(F.col("created_at")))
    return rounded(tables.classified_view(stored), "fake_news_prob").withColumn(
        "classified_at", clock_micros("classified_at")
    )


@query
def emotion_view(spark, sf):
    times = given.posts(spark, sf).select("doc_id", tables.parse_instant(F.col("created_at")).alias("classified_at"))
    stored = given.emotions(spark, sf).join(times, "doc_id")
    return tables.emotion_view(stored).withColumn("classified_at", clock_micros("classified_at"))


@query
def append_posts(spark, sf):
    path = scratch_path(spark, "posts")
    rows = given.posts(spark, sf).select("unique_id", "category")
    tables.append(rows.filter("category = 'Misinformation'"), path)
    tables.append(rows.filter("category <> 'Misinformation'"), path)
    stored = spark.read.parquet(path)
    return stored.select("unique_id", "category", F.col("utc_saved_at").isNotNull().alias("has_load_time"))


@query
def upsert_posts(spark, sf):
    path = scratch_path(spark, "scores")
    columns = ["unique_id", "category", "fake_news_prob"]
    current = given.classified(spark, sf).select("doc_id", *columns)
    judged = current.join(given.table(spark, sf, "labels"), "doc_id")
    first = judged.select("unique_id", F.lit("Draft").alias("category"), F.lit(0.5).alias("fake_news_prob"))
    second = judged.select(
        "unique_id", F.lit("Reviewed").alias("category"), F.col("quality").cast("double").alias("fake_news_prob")
    )
    added = judged.filter("toxic = 1").select(
        F.concat("unique_id", F.lit("/reply")).alias("unique_id"), "category", "fake_news_prob"
    )
    updates = (
        first.withColumn("round", F.lit(1))
        .unionByName(second.withColumn("round", F.lit(2)))
        .unionByName(added.withColumn("round", F.lit(1)))
    )
    schema = current.select(*columns).schema
    part = tables.key_bucket("unique_id", 16)
    tables.upsert(current.select(*columns), path, "unique_id", schema, part)
    tables.upsert(updates, path, "unique_id", schema, part, [F.desc("round")])
    return rounded(tables.read_keyed(spark, path, schema), "fake_news_prob")


@query
def newest_energy_logs(spark, sf):
    newest = tables.newest_first(given.energy_logs(spark, sf))
    return newest.select("run_id", "node_name", clock_micros("timestamp").alias("logged_at"), "duration_s")


@query
def reloaded_clusters(spark, sf):
    path = scratch_path(spark, "kmeans")
    rows = _feature_rows(spark, sf)
    model = clustering.fit_clusters(rows, key="doc_id", partitions=8)
    clustered = clustering.assign_clusters(rows, clustering.centers_of(model))
    fake = clustering.orient(clustered).first()["fake_cluster"]
    models.save_clusters(spark, model, fake, path)
    loaded, fake_cluster = models.load_clusters(spark, path)
    again = clustering.assign_clusters(rows, clustering.centers_of(loaded))
    return _differences(clustering.score_posts(clustered, fake), clustering.score_posts(again, fake_cluster), "fake_news_prob")


def _differences(before, after, score):
    """How far the scores of two frames are apart, row by row."""
    pairs = before.select("doc_id", F.col(score).alias("a")).join(after.select("doc_id", F.col(score).alias("b")), "doc_id")
    return pairs.select("doc_id", F.abs(F.col("a") - F.col("b")).alias("difference"))


@query
def reloaded_reliability(spark, sf):
    path = scratch_path(spark, "reliability")
    rows = _feature_rows(spark, sf)
    model = reliability.fit_reliability(features.labelled_posts(rows))
    models.save_reliability(model, path)
    loaded = models.load_reliability(path)
    before, after = (reliability.raw_probability(m, rows, "p") for m in (model, loaded))
    return _differences(before, after, "p")


# Projections and filters


@query
def post_keys(spark, sf):
    return given.posts(spark, sf).select("doc_id", "unique_id")


@query
def complete_posts(spark, sf):
    times = given.events(spark, sf).select(F.col("event_id"), "ts")
    pages = given.table(spark, sf, "pages").withColumn("event_id", F.col("page_id") * 50).join(times, "event_id", "left")
    payloads = pages.select("page_id", F.col("html").alias("text"), F.date_format("ts", given.ISO_FORMAT).alias("created_at"))
    return ingest.complete(payloads).select("page_id", "created_at")


@query
def source_labels(spark, sf):
    return given.posts(spark, sf).select("doc_id", "username", "source_label")


@query
def page_source_labels(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    pages = given.table(spark, sf, "pages").select("page_id", host.alias("host"))
    return pages.withColumn("source_label", handles.source_label(F.col("host"), PAGE_DOMAINS))


@query
def source_labels_by_table(spark, sf):
    plain = given.posts(spark, sf).select("doc_id", "username")
    labelled = ingest.label_sources(plain, parameters.reliable_domains(spark))
    return labelled.select("doc_id", "username", "source_label")


@query
def themed_posts(spark, sf):
    return ingest.keyword_posts(given.payloads(spark, sf)).select("uri", "category", "source_label")


@query
def themed_documents(spark, sf):
    found = ingest.keyword_posts(given.payloads(spark, sf), DOCUMENT_THEMES)
    return found.select("uri", "unique_id", "category", "source_label")


@query
def account_feed(spark, sf):
    feed = ingest.account_posts(given.payloads(spark, sf))
    return feed.select("uri", "unique_id", "username", "category", "source_label")


@query
def scorable_posts(spark, sf):
    return incremental.scorable(given.cleaned(spark, sf)).select("doc_id", "normalized_text")


@query
def post_defaults(spark, sf):
    labels = given.table(spark, sf, "labels").select("doc_id", "quality")
    partial = given.posts(spark, sf).join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality").isNotNull(), F.col("source_label")).alias("source_label"),
        F.when(F.col("quality") == 1, F.array(*[(F.col("n_chars") * i).cast("double") for i in range(1, 6)])).alias(
            "style_features"
        ),
    )
    filled = ingest.with_defaults(partial)
    return filled.select(
        "doc_id", "source_label", *[F.col("style_features")[i].alias(f"style_{i}") for i in range(5)]
    )


@query
def parsed_instants(spark, sf):
    plain = F.substring("created_at", 1, 26)
    zone = F.when(F.col("doc_id") % 3 == 0, "Z").when(F.col("doc_id") % 3 == 1, "+00:00").otherwise("+02:00")
    written = given.posts(spark, sf).select("doc_id", F.concat(plain, zone).alias("written"))
    return written.select("doc_id", clock_micros(tables.parse_instant(F.col("written"))).alias("instant"))


@query
def real_fake_labels(spark, sf):
    return given.classified(spark, sf).select("doc_id", "is_real", "label")


@query
def energy_units(spark, sf):
    converted = energy.energy_units(given.energy_logs(spark, sf))
    return converted.select(
        clock_micros("timestamp").alias("logged_at"),
        "run_id",
        *[six(c).alias(c) for c in ("energy_wh", "cpu_energy_wh", "gpu_energy_wh", "ram_energy_wh", "co2_mg")],
    )


@query
def emotion_percent(spark, sf):
    return given.emotions(spark, sf).select(
        "doc_id", "emotion", emotion.emotion_percent(F.col("emotion_score")).alias("pct")
    )


def _scored_emotions(spark, sf):
    return emotion.emotion_scores(given.cleaned(spark, sf), given.stand_in_emotion_model())


@query
def emotion_badges(spark, sf):
    # The outer form keeps Spark from testing the array in a filter, which would run the model twice.
    shown = _scored_emotions(spark, sf).select(
        "doc_id", F.explode_outer(emotion.emotion_badges(F.col("emotions"))).alias("badge")
    )
    badge = emotion.badge_text(F.col("badge.emotion"), F.col("badge.score"))
    return shown.filter(F.col("badge").isNotNull()).select(
        "doc_id", F.col("badge.emotion").alias("emotion"), badge.alias("badge")
    )


# Joins against stored keys


def _judged_keys(spark, sf):
    return given.posts(spark, sf).join(given.table(spark, sf, "labels"), "doc_id", "left_semi").select("unique_id")


def _stored_cleaned(spark, sf):
    """The cleaned table as the stages keep it: the text is cleaned once and read back."""
    cleaned = given.cleaned(spark, sf)
    return stored(
        cleaned.select("doc_id", "unique_id", "username", "category", "source_label", "normalized_text"), "cleaned"
    )


@query
def posts_to_clean(spark, sf):
    pending = incremental.posts_to_clean(given.posts(spark, sf), _judged_keys(spark, sf))
    return pending.select("doc_id", "unique_id")


@query
def posts_to_clean_by_keys(spark, sf):
    """The same with the stored keys in a bucketed table that is not shuffled."""
    path = scratch_path(spark, "keys")
    name = f"keys_{path.rsplit('-', 1)[-1]}"
    buckets = max(STATE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys.open_keys(spark, name, path, buckets)
    keys.add_keys(_judged_keys(spark, sf), name, buckets)
    pending = keys.unseen_by_keys(given.posts(spark, sf), keys.open_keys(spark, name, path, buckets))
    return pending.select("doc_id", "unique_id")


@query
def posts_to_classify(spark, sf):
    stored = given.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    classified = given.posts(spark, sf).join(stored, "doc_id", "left_semi").select("unique_id")
    return incremental.posts_to_classify(_stored_cleaned(spark, sf), classified).select("doc_id", "unique_id")


@query
def posts_for_emotion(spark, sf):
    return incremental.posts_for_emotion(_stored_cleaned(spark, sf), _judged_keys(spark, sf))


@query
def unseen_posts(spark, sf):
    fresh = ingest.new_posts(given.payloads(spark, sf), _judged_keys(spark, sf), themes=DOCUMENT_THEMES)
    return fresh.select("uri", "unique_id", "category", "source_label")


@query
def aligned_features(spark, sf):
    width = F.size("features")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return given.feature_posts(spark, sf).select(
        "doc_id", width.cast("long").alias("width"), six(total).alias("total")
    )


@query
def emotion_by_verdict(spark, sf):
    return reports.emotion_by_verdict(given.emotions(spark, sf), given.classified(spark, sf))


# Dedup and set operations


@query
def first_hit_per_uri(spark, sf):
    hits = ingest.keyword_hits(given.payloads(spark, sf), DOCUMENT_THEMES)
    return dedup.first_rows(hits, "uri", ["theme_rank", "keyword_rank"]).select("uri", "category", "keyword")


@query
def first_post_per_author(spark, sf):
    return dedup.first_rows(given.posts(spark, sf), "username", ["created_at", "doc_id"]).select("username", "doc_id")


@query
def merged_feeds(spark, sf):
    payloads = given.payloads(spark, sf)
    merged = ingest.merge_feeds(ingest.account_posts(payloads), ingest.keyword_posts(payloads, DOCUMENT_THEMES))
    return merged.select("uri", "unique_id", "category", "source_label")


@query
def themed_in_one_pass(spark, sf):
    """Both feeds, merged, from one pass: what the ingest stage and stream store."""
    found = ingest.themed_posts(given.payloads(spark, sf), themes=DOCUMENT_THEMES)
    return found.select("uri", "unique_id", "category", "source_label")


@query
def themed_by_tables(spark, sf):
    """The same from the stored tables of accounts and keywords."""
    accounts = parameters.as_accounts(parameters.reliable_accounts(spark))
    themes = parameters.as_themes(parameters.keyword_themes(spark, DOCUMENT_THEMES))
    found = ingest.themed_posts(given.payloads(spark, sf), themes=themes, accounts=accounts)
    return found.select("uri", "unique_id", "category", "source_label")


@query
def distinct_keys(spark, sf):
    posts = given.posts(spark, sf)
    return incremental.distinct_keys(posts.unionByName(posts))


@query
def phrase_hits(spark, sf):
    """Documents that hold the first two words of a benchmark item, with the phrase; joins, no list of literals."""
    two_words = rf"^[{text.WORD}]+[^{text.WORD}]+[{text.WORD}]+"
    listed = given.table(spark, sf, "benchmark").select(F.regexp_extract(F.lower("text"), two_words, 0).alias("phrase"))
    return phrases.phrase_hits(_documents(spark, sf), phrases.phrase_table(listed), "doc_id")


# Text


def _documents(spark, sf):
    return given.texts(spark, sf, "documents").select("doc_id", "text")


def _pages(spark, sf):
    return given.texts(spark, sf, "pages").select("page_id", F.col("html").alias("text"))


@query
def lowercase_text(spark, sf):
    return _documents(spark, sf).select("doc_id", F.lower("text").alias("result"))


@query
def text_without_urls(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_urls(F.lower("text")).alias("result"))


@query
def text_without_mentions(spark, sf):
    return _documents(spark, sf).select("doc_id", text.strip_mentions(F.col("text")).alias("result"))


@query
def text_without_hashtags(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_hashtags(F.col("text")).alias("result"))


@query
def text_without_emojis(spark, sf):
    return _documents(spark, sf).select("doc_id", text.strip_emojis(F.col("text")).alias("result"))


@query
def text_without_punctuation(spark, sf):
    return _pages(spark, sf).select("page_id", text.strip_punctuation(F.col("text")).alias("result"))


@query
def ascii_text(spark, sf):
    return _documents(spark, sf).select("doc_id", text.nfkd_ascii(F.col("text")).alias("result"))


@query
def single_spaced_text(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", text.collapse_spaces(text.nfkd_ascii(F.col("text"))).alias("result")
    )


@query
def normalized_posts(spark, sf):
    return text.normalize_text(text.clean_text(_documents(spark, sf))).select("doc_id", "normalized_text")


@query
def normalized_pages(spark, sf):
    return text.normalize_text(text.clean_text(_pages(spark, sf))).select("page_id", "normalized_text")


def _style_columns(df, key):
    styled = text.with_style_features(df)
    return styled.select(
        key, *[F.col("style_features")[i].alias(name) for i, name in enumerate(text.STYLE_COLUMNS)]
    )


@query
def style_features(spark, sf):
    return _style_columns(_documents(spark, sf), "doc_id")


@query
def page_style_features(spark, sf):
    return _style_columns(_pages(spark, sf), "page_id")


@query
def parsed_verdicts(spark, sf):
    return verdicts.parse_verdicts(given.answers(spark, sf)).select("conv_id", "turn", "verdict", "reasoning")


# Vectors, models, scores


@query
def hashed_embeddings(spark, sf):
    encoded = features.hashed_embeddings(given.cleaned(spark, sf))
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("position", "value")).filter("value <> 0")
    return cells.select("doc_id", F.col("position").cast("long").alias("position"), six("value").alias("value"))


@query
def hashed_embedding_norms(spark, sf):
    encoded = features.hashed_embeddings(given.cleaned(spark, sf))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return encoded.select("doc_id", F.size("embedding").cast("long").alias("width"), six(norm).alias("norm"))


@query
def encoded_embeddings(spark, sf):
    encoded = features.encode(given.cleaned(spark, sf), given.stand_in_encoder())
    return encoded.select("doc_id", *[six(F.col("embedding")[i]).alias(f"e{i}") for i in range(3)])


@query
def feature_matrix(spark, sf):
    rows = given.feature_posts(spark, sf)
    return rows.select("doc_id", F.posexplode_outer("features").alias("position", "value")).select(
        "doc_id", F.col("position").cast("long").alias("position"), six("value").alias("value")
    )


@query
def fitted_clusters(spark, sf):
    """The fitted clusters as a fixed point: every row is at its nearest centre, every centre the mean of its rows.

    ``gap`` is how much nearer another centre is; ``drift`` is the distance from a row's centre to the mean of its
    rows, in ten thousandths of the centre's length.
    """
    rows = _feature_rows(spark, sf)
    centers = clustering.centers_of(clustering.fit_clusters(rows, key="doc_id", partitions=8))
    clustered = stored(clustering.assign_clusters(rows, centers), "clustered")
    means = _means(clustered, "cluster")
    drift = F.lit(None).cast("double")
    for i, center in enumerate(centers):
        length = float(np.linalg.norm(center)) or 1.0
        far = float(np.linalg.norm(np.array(center) - means[i])) / length if i in means else 0.0
        drift = F.when(F.col("cluster") == i, far * 1e4).otherwise(drift)
    own = F.get("distances", F.col("cluster"))
    return clustered.select(
        "doc_id", six(own - F.array_min("distances")).alias("gap"), F.floor(drift).cast("long").alias("drift")
    )


def _means(rows, side):
    """Mean feature row of each side: one vector per side reaches the driver."""
    vectors = rows.select(F.col(side).alias("side"), array_to_vector("features").alias("v"))
    found = vectors.groupBy("side").agg(Summarizer.mean(F.col("v")).alias("mean")).collect()
    return {r["side"]: r["mean"].toArray() for r in found}


def _given_centers(rows):
    """Mean feature row of the even and of the odd vector labels."""
    means = _means(rows.withColumn("_side", F.col("vector_label") % 2), "_side")
    width = len(next(iter(means.values())))
    return [list(map(float, means.get(side, np.zeros(width)))) for side in range(2)]


def _assigned(spark, sf):
    rows = _feature_rows(spark, sf)
    return stored(clustering.assign_clusters(rows, _given_centers(rows)).drop("features"), "assigned")


@query
def centroid_distances(spark, sf):
    return _assigned(spark, sf).select(
        "doc_id",
        six(F.col("distances")[0]).alias("d0"),
        six(F.col("distances")[1]).alias("d1"),
        F.col("cluster").cast("long").alias("cluster"),
    )


@query
def cluster_orientation(spark, sf):
    oriented = clustering.orient(_assigned(spark, sf))
    return oriented.select(
        six("score_0").alias("score_0"),
        six("score_1").alias("score_1"),
        F.col("real_cluster").cast("long").alias("real_cluster"),
        F.col("fake_cluster").cast("long").alias("fake_cluster"),
        "orientation_known",
    )


@query
def cluster_scores(spark, sf):
    rows = _feature_rows(spark, sf)
    scored = clustering.classify_posts(rows, _given_centers(rows))
    return scored.select("doc_id", six("fake_news_prob").alias("fake_news_prob"), "is_real")


@query
def claim_scores(spark, sf):
    clustered = _assigned(spark, sf)
    fake = clustering.orient(clustered).first()["fake_cluster"]
    scored = clustering.score_claims(clustered, fake)
    return scored.select(
        "doc_id", "probability", "verdict", scoring.score_percent(F.col("probability")).alias("score_pct"), "based_on"
    )


def _labelled(spark, sf):
    return features.labelled_posts(_stored_cleaned(spark, sf))


@query
def labelled_posts(spark, sf):
    return _labelled(spark, sf).select("unique_id", "label")


@query
def unconflicted_posts(spark, sf):
    return features.labelled_posts(given.cleaned(spark, sf), drop_conflicts=True).select("unique_id", "label")


@query
def sample_counts(spark, sf):
    return features.label_counts(_labelled(spark, sf))


@query
def balanced_weights(spark, sf):
    weighted = features.with_balanced_weights(_labelled(spark, sf))
    return weighted.select("unique_id", "label", six("weight").alias("weight"))


def _feature_rows(spark, sf):
    """Feature rows of the posts, stored once because fits and passes read them repeatedly."""
    columns = ["doc_id", "unique_id", "category", "source_label", "normalized_text", "vector_label", "features"]
    return stored(given.feature_posts(spark, sf).select(*columns), "features")


# Coefficient of place i of a feature row, and the intercept, of a model given by rule.
GIVEN_WEIGHTS = [((i * 37) % 19 - 9) / 4 for i in range(69)]
GIVEN_INTERCEPT = -0.25
GIVEN_CENTERS = [[((i * 11 + side * 5) % 13) / 10 for i in range(69)] for side in range(2)]


@query
def reliability_scores(spark, sf):
    """Scores by given coefficients."""
    p = reliability.linear_probability(F.col("features"), GIVEN_WEIGHTS, GIVEN_INTERCEPT)
    return _feature_rows(spark, sf).select("doc_id", scoring.probability_of(p).alias("reliability"))


@query
def reliability_gradient(spark, sf):
    """Penalised gradient of the fitted model per coefficient, in thousandths of the number of rows."""
    labelled = stored(features.labelled_posts(_feature_rows(spark, sf)).select("doc_id", "label", "features"), "labelled")
    model = reliability.fit_reliability(labelled)
    found = reliability.penalised_gradient(model, labelled)
    rows = [(i, int(abs(g) * 1000)) for i, g in enumerate(found)]
    return spark.createDataFrame(rows, "position long, gradient long")


@query
def cross_validated_auc(spark, sf):
    """Area under the curve per fold of a given score."""
    return rounded(reliability.fold_areas(_given_folds(spark, sf)), "roc_auc")


@query
def cross_validation_summary(spark, sf):
    return rounded(reliability.summarise_folds(reliability.fold_areas(_given_folds(spark, sf))), "mean_auc", "std_auc")


def _given_folds(spark, sf):
    folded = features.stratified_folds(_labelled_scores(spark, sf), folds=5)
    return folded.select("fold", "label", "probability")


def _labelled_scores(spark, sf):
    scored = given.cleaned(spark, sf).withColumn("probability", (F.col("n_chars") % 997) / F.lit(996.0))
    return features.labelled_posts(scored)


# Area that a fitted model must reach on the rows it was fitted on; a model by chance reaches one half.
FITTED_AREA = 0.6


@query
def fitted_auc_is_valid(spark, sf):
    """Each fold's model separates the classes of the rows it was fitted on, by the exact area of its scores."""
    labelled = features.labelled_posts(_feature_rows(spark, sf))
    areas = reliability.fold_areas(reliability.cross_validated_scores(labelled, folds=5, held_out=False))
    return areas.select(F.col("fold").cast("long").alias("fold"), (F.col("roc_auc") >= FITTED_AREA).alias("valid"))


@query
def sample_guards(spark, sf):
    """Both training guards: the rows of each class, and whether they pass."""
    counts = features.label_counts(_labelled(spark, sf))
    found = counts.agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("reliable"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("misinformation"),
    )
    guards = [("fine-tuning", 30), ("reliability", 1)]
    listed = F.array(*[F.struct(F.lit(g).alias("guard"), F.lit(n).cast("long").alias("least")) for g, n in guards])
    enough = (F.col("reliable") >= F.col("least")) & (F.col("misinformation") >= F.col("least"))
    rows = found.select("reliable", "misinformation", F.inline(listed))
    return rows.select("guard", "least", "reliable", "misinformation", enough.alias("passes"))


@query
def training_set(spark, sf):
    """The stored set of the fine-tuning path: labelled, guarded and split."""
    path = scratch_path(spark, "training")
    jobs.training_set_stage(given.cleaned(spark, sf), path, min_reliable=1, min_misinformation=1)
    return spark.read.parquet(path).select("unique_id", "label", "split")


@query
def softmax_scores(spark, sf):
    logits = F.col("embedding").cast("array<double>")
    return given.table(spark, sf, "embeddings").select("vec_id", scoring.softmax_real(logits).alias("p_real"))


@query
def stratified_split(spark, sf):
    return features.stratified_split(_labelled(spark, sf)).select("unique_id", "label", "split")


@query
def stratified_folds(spark, sf):
    folded = features.stratified_folds(_labelled(spark, sf), folds=5)
    return folded.select("unique_id", "label", F.col("fold").cast("long").alias("fold"))


@query
def classifier_evaluation(spark, sf):
    labelled = features.labelled_posts(
        given.posts(spark, sf).withColumn("normalized_text", F.col("text"))
    ).select("label", ((F.col("n_chars") % 997) / F.lit(996.0)).alias("probability"))
    found = reliability.evaluate(labelled)
    return spark.createDataFrame([(found["roc_auc"], found["accuracy"])], "roc_auc double, accuracy double")


@query
def top_emotion(spark, sf):
    return emotion.top_emotion(_scored_emotions(spark, sf)).select("doc_id", "emotion", "emotion_score")


@query
def emotion_ranking(spark, sf):
    ranked = _scored_emotions(spark, sf).select("doc_id", F.posexplode_outer("emotions").alias("place", "entry"))
    return ranked.select("doc_id", F.col("place").cast("long").alias("place"), "entry.emotion", "entry.score")


def _claims(spark, sf):
    """One claim per document with the probabilities of the scorers that have its inputs."""
    labels = given.table(spark, sf, "labels").select("doc_id", "quality")
    vectors = given.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = given.table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = docs.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 101) / F.lit(100.0)).alias("finetuned"),
        F.when(F.col("embedding").isNotNull(), (F.col("n_chars") % 103) / F.lit(102.0)).alias("reliability"),
        ((F.col("n_chars") % 107) / F.lit(106.0)).alias("kmeans"),
    )


@query
def scorer_cascade(spark, sf):
    probability, based_on = scoring.cascade(F.col("finetuned"), F.col("reliability"), F.col("kmeans"))
    return _claims(spark, sf).select("doc_id", six(probability).alias("probability"), based_on.alias("based_on"))


@query
def answered_claims(spark, sf):
    answered = scoring.answer_claims(_claims(spark, sf))
    return answered.select(
        "doc_id", six("probability").alias("probability"), "based_on", "verdict", "label", "score_pct", "band", "tone"
    )


@query
def verdict_labels(spark, sf):
    p = F.when(F.col("status") == 200, F.col("probability"))
    log = given.request_log(spark, sf).select(clock_micros("ts").alias("asked_at"), p.alias("probability"))
    p = F.col("probability")
    return log.select(
        "asked_at",
        "probability",
        scoring.verdict_label(p).alias("label"),
        scoring.score_percent(p).alias("score_pct"),
        scoring.verdict_text(p).alias("verdict"),
        scoring.probability_band(p).alias("band"),
        scoring.tone(p).alias("tone"),
    )


@query
def verdict_labels_by_table(spark, sf):
    """Labels by the stored table of thresholds."""
    bounds = parameters.as_bounds(parameters.thresholds(spark))
    levels = {name: bounds[name] for name in ("likely", "probable", "possible")}
    p = F.when(F.col("status") == 200, F.col("probability"))
    log = given.request_log(spark, sf)
    return log.select(clock_micros("ts").alias("asked_at"), scoring.verdict_label(p, **levels).alias("label"))


# Retrieval


@query
def tfidf_weights(spark, sf):
    path = scratch_path(spark, "index")
    retrieval.write_index(_documents(spark, sf), path)
    return rounded(retrieval.read_postings(spark, path), "weight")


@query
def appended_weights(spark, sf):
    """The same weights from an index that grew by three appends."""
    path = scratch_path(spark, "index")
    for i in range(3):
        retrieval.append_index(_documents(spark, sf).filter(F.col("doc_id") % 3 == i), path, str(i))
    retrieval.refresh_index(spark, path)
    return rounded(retrieval.read_postings(spark, path), "weight")


@query
def retrieved_documents(spark, sf):
    path = scratch_path(spark, "index")
    retrieval.write_index(_documents(spark, sf), path)
    queries = given.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    wanted = stored(retrieval.query_weights(queries, spark.read.parquet(f"{path}/terms")), "wanted")
    found = retrieval.retrieve(wanted, retrieval.read_vectors(spark, path), placed=True)
    return found.select("query_id", "doc_id", six("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


# Reports


@query
def top_users_per_category(spark, sf):
    return reports.top_users_per_category(given.posts(spark, sf))


@query
def trending_keywords(spark, sf):
    return reports.trending_keywords(given.cleaned(spark, sf))


@query
def trending_keywords_by_category(spark, sf):
    return reports.trending_keywords_by_category(given.cleaned(spark, sf))


def _dated(spark, sf):
    return given.posts(spark, sf).withColumn("created_at", tables.parse_instant(F.col("created_at")))


@query
def posts_per_hour(spark, sf):
    return reports.posts_per_hour(_dated(spark, sf)).withColumn("hour", F.col("hour").cast("long"))


@query
def posts_per_day(spark, sf):
    return reports.posts_per_day(_dated(spark, sf)).withColumn("date", clock("date"))


@query
def fake_real_distribution(spark, sf):
    return reports.fake_real_distribution(given.classified(spark, sf))


@query
def classification_by_category(spark, sf):
    return reports.classification_by_category(given.classified(spark, sf))


@query
def prob_histogram(spark, sf):
    return reports.prob_histogram(given.classified(spark, sf))


@query
def classification_tables(spark, sf):
    """Rows of the reports on classified posts from one read: name, first and second key, number."""
    found = reports.classification_tables(given.classified(spark, sf))
    name, none = F.lit, F.lit(None).cast("string")
    keyed = [
        found["fake_real_distribution"].select(name("labels").alias("report"), F.col("label").alias("key"), none.alias("then"), F.col("count").alias("n")),
        found["classification_by_category"].select(name("categories"), "category", "label", "count"),
        found["prob_histogram"].select(name("bins"), F.round(F.col("bin_start") * 10).cast("int").cast("string"), "side", "count"),
        found["classification_kpis"].select(name("real"), none, none, "n_real"),
        found["classification_kpis"].select(name("fake"), none, none, "n_fake"),
    ]
    return reduce(DataFrame.union, keyed)


@query
def emotion_distribution(spark, sf):
    return reports.emotion_distribution(given.emotions(spark, sf))


@query
def emotion_by_category(spark, sf):
    return reports.emotion_by_category(given.emotions(spark, sf))


@query
def avg_emotion_score(spark, sf):
    return reports.avg_emotion_score(given.emotions(spark, sf))


@query
def corpus_kpis(spark, sf):
    return reports.corpus_kpis(given.cleaned(spark, sf), given.classified(spark, sf))


@query
def classification_kpis(spark, sf):
    found = reports.classification_kpis(given.classified(spark, sf))
    return rounded(found, "pct_real", "pct_fake", "avg_probability")


@query
def categories_by_real_share(spark, sf):
    return rounded(reports.categories_by_real_share(given.classified(spark, sf)), "real_share")


@query
def share_within_category(spark, sf):
    return rounded(reports.share_within_category(given.classified(spark, sf)), "share")


@query
def emotion_kpis(spark, sf):
    return reports.emotion_kpis(given.emotions(spark, sf))


@query
def categories_in_order(spark, sf):
    counted = reports.classification_by_category(given.classified(spark, sf))
    ordered = reports.in_category_order(counted, "label")
    return ordered.withColumn("category_rank", F.col("category_rank").cast("long"))


@query
def top_eight_authors(spark, sf):
    return reports.top_users_per_category(given.posts(spark, sf), top_k=8)


def _energy(spark, sf):
    return energy.energy_units(given.energy_logs(spark, sf))


@query
def energy_by_job(spark, sf):
    return rounded(energy.energy_by_pipeline(_energy(spark, sf)), "total_wh", "total_co2_mg", "total_duration_s")


@query
def energy_by_node(spark, sf):
    found = energy.energy_by_node(_energy(spark, sf))
    return rounded(
        found, "avg_wh", "total_wh", "avg_cpu_wh", "avg_gpu_wh", "avg_ram_wh", "avg_duration_s"
    )


@query
def energy_timeline(spark, sf):
    found = rounded(energy.energy_timeline(_energy(spark, sf)), "total_wh", "total_co2_mg")
    return found.withColumn("timestamp", clock_micros("timestamp"))


@query
def energy_kpis(spark, sf):
    return rounded(energy.energy_kpis(_energy(spark, sf)), "total_wh", "total_co2_mg")


@query
def energy_breakdown(spark, sf):
    return rounded(energy.energy_breakdown(energy.energy_by_node(_energy(spark, sf))), "avg_wh")


@query
def recent_runs(spark, sf):
    return energy.recent_runs(_energy(spark, sf))


# Service metrics


@query
def total_requests(spark, sf):
    return metrics.total_requests(given.request_log(spark, sf))


@query
def request_rate(spark, sf):
    found = metrics.request_rate(given.request_log(spark, sf))
    return found.withColumn("window_start", clock("window_start"))


@query
def error_rate(spark, sf):
    found = rounded(metrics.error_rate(given.request_log(spark, sf)), "error_rate")
    banded = found.withColumn("band", metrics.band(F.col("error_rate"), "error_rate"))
    return banded.withColumn("window_start", clock("window_start"))


@query
def hit_rate(spark, sf):
    found = rounded(metrics.hit_rate(given.request_log(spark, sf)), "hit_rate")
    return found.withColumn("band", metrics.band(F.col("hit_rate"), "hit_rate"))


def _quantiles(spark, sf, value, bounds, names):
    log = metrics.ask_requests(given.request_log(spark, sf))
    found = rounded(metrics.latency_quantiles(log, value, bounds, names), *names)
    return found.withColumn("window_start", clock("window_start"))


@query
def http_latency(spark, sf):
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return _quantiles(spark, sf, "latency_s", metrics.HTTP_LATENCY_BUCKETS, names)


@query
def answer_latency(spark, sf):
    return _quantiles(spark, sf, "latency_s", metrics.ANSWER_LATENCY_BUCKETS, {"p50": 0.5, "p95": 0.95})


@query
def context_size(spark, sf):
    found = _quantiles(spark, sf, "context_chars", metrics.CONTEXT_CHARS_BUCKETS, {"p50": 0.5, "p95": 0.95})
    return found.withColumn("target", F.lit(metrics.CONTEXT_CHARS_TARGET)).withColumn(
        "band", metrics.band(F.col("p50"), "context_chars")
    )


@query
def verdict_totals(spark, sf):
    return metrics.verdict_totals(given.request_log(spark, sf))


@query
def verdict_rates(spark, sf):
    found = rounded(metrics.verdict_rates(given.request_log(spark, sf)), "per_second")
    return found.withColumn("window_start", clock("window_start"))


@query
def retrieval_rates(spark, sf):
    found = rounded(metrics.retrieval_rates(given.request_log(spark, sf)), "per_second")
    return found.withColumn("window_start", clock("window_start"))


@query
def cpu_busy(spark, sf):
    found = rounded(metrics.cpu_busy(given.host_samples(spark, sf)), "cpu_busy")
    banded = found.withColumn("band", metrics.band(F.col("cpu_busy"), "cpu"))
    return banded.withColumn("window_start", clock("window_start"))


@query
def memory_and_disk(spark, sf):
    found = rounded(metrics.usage(given.host_samples(spark, sf)), "ram_used", "disk_used")
    return found.select(
        "event_id",
        "ram_used",
        "disk_used",
        metrics.band(F.col("ram_used"), "ram").alias("ram_band"),
        metrics.band(F.col("disk_used"), "disk").alias("disk_band"),
    )


# Streams


def _event_stream(spark, sf):
    schema = given.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return given.event_times(stream)


@query
def streamed_posts(spark, sf):
    landing, stored = scratch_path(spark, "landing"), scratch_path(spark, "posts")
    for _ in range(2):
        given.payloads(spark, sf).write.mode("append").json(landing, compression="gzip")
    arrived = post_streams.read_payload_stream(spark, landing)
    post_streams.stream_posts(arrived, stored, scratch_path(spark, "checkpoint"), STATE_PARTITIONS, themes=DOCUMENT_THEMES)
    return spark.read.parquet(stored).select("unique_id", "username", "category", "source_label")


@query
def streamed_cleaning(spark, sf):
    raw, stored = scratch_path(spark, "raw"), scratch_path(spark, "cleaned")
    given.posts(spark, sf).select("text", "username", "created_at", "unique_id", "category", "source_label").write.parquet(raw)
    stream = spark.readStream.schema(schemas.POSTS).parquet(raw)
    post_streams.stream_cleaning(stream, stored, scratch_path(spark, "checkpoint"))
    cleaned = spark.read.parquet(stored)
    return cleaned.select("unique_id", "normalized_text", six(F.col("style_features")[0]).alias("caps_ratio"))


def _stream_to_table(spark, windows):
    path = scratch_path(spark, "windows")
    window_streams.stream_windows(windows, path, scratch_path(spark, "checkpoint"), STATE_PARTITIONS)
    stored = tables.read_keyed(spark, path, windows.schema)
    return stored.withColumn("window_start", clock("window_start"))


@query
def streamed_daily_counts(spark, sf):
    return _stream_to_table(spark, window_streams.daily_posts(_event_stream(spark, sf), "ts"))


@query
def streamed_request_windows(spark, sf):
    log = given.as_requests(_event_stream(spark, sf))
    return _stream_to_table(spark, window_streams.request_windows(log))


@query
def streamed_verdict_windows(spark, sf):
    log = given.as_requests(_event_stream(spark, sf))
    return _stream_to_table(spark, window_streams.verdict_windows(log))


# Stages


@query
def staged_classification(spark, sf):
    """Landing files through ingest, cleaning and classification; which posts come out, in range."""
    paths = {name: scratch_path(spark, name) for name in ("landing", "posts", "cleaned", "classified", "model")}
    given.payloads(spark, sf).write.json(paths["landing"])
    jobs.ingest_stage(spark, paths["landing"], paths["posts"], state_partitions=STATE_PARTITIONS)
    jobs.clean_stage(spark, paths["posts"], paths["cleaned"])
    jobs.classify_stage(spark, paths["cleaned"], paths["classified"], paths["model"])
    found = tables.read_table(spark, paths["classified"], schemas.CLASSIFIED)
    return found.select("unique_id", "category", F.col("fake_news_prob").between(0.0, 1.0).alias("in_range"))


@query
def answered_texts(spark, sf):
    """User turns answered from their text by given models; odd conversations lack the classifier."""
    turns = given.texts(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    encoder = partial(features.encode, load_model=given.stand_in_vectors())
    both = jobs.ClaimModels((GIVEN_CENTERS, 0), (GIVEN_WEIGHTS, GIVEN_INTERCEPT))
    clusters_only = jobs.ClaimModels((GIVEN_CENTERS, 0), None)
    answered = jobs.answer_texts(turns.filter("conv_id % 2 = 0"), both, encoder).unionByName(
        jobs.answer_texts(turns.filter("conv_id % 2 = 1"), clusters_only, encoder)
    )
    return answered.select(
        "conv_id", "turn", "probability", "based_on", "verdict", "label", "score_pct", "band", "tone"
    )


@query
def finetuned_answers(spark, sf):
    """User turns answered by all three scorers; the given fine-tuned model comes first."""
    turns = given.texts(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    encoder = partial(features.encode, load_model=given.stand_in_vectors())
    models_ = jobs.ClaimModels((GIVEN_CENTERS, 0), (GIVEN_WEIGHTS, GIVEN_INTERCEPT), given.stand_in_logits())
    answered = jobs.answer_texts(turns, models_, encoder)
    return answered.select("conv_id", "turn", "probability", "based_on", "verdict", "label", "score_pct", "band", "tone")
