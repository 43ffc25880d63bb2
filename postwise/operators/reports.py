"""Reports on posts, credibility and emotions.

Rows with a missing group key are left out everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwise.constants import CATEGORY_PRIORITY, KEYWORD_BLACKLIST, MIN_KEYWORD_LENGTH
from postwise.functions.rounding import percent, round_scaled
from postwise.functions.text import SPACE
from postwise.session import stored


def _counted(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _top_per(df: DataFrame, group: str, order: Sequence[str | Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_users_per_category(posts: DataFrame, top_k: int = 10) -> DataFrame:
    """Most active authors per category; ties in username order."""
    counted = _counted(posts, ["category", "username"], "post_count")
    top = _top_per(counted, "category", [F.desc("post_count"), "username"], top_k)
    return top.orderBy("category", "rank").drop("rank")


def keyword_rows(posts: DataFrame, *keep: str) -> DataFrame:
    """One row per keyword: whole words of letters, long enough, not on the blacklist."""
    word = rf"(?<![^{SPACE}])[A-Za-z]{{{MIN_KEYWORD_LENGTH},}}+(?![^{SPACE}])"
    found = F.regexp_extract_all(F.col("normalized_text"), F.lit(word), F.lit(0))
    rows = posts.select(*keep, F.explode(found).alias("keyword"))
    return rows.filter(~F.col("keyword").isin(*KEYWORD_BLACKLIST))


def trending_keywords(posts: DataFrame, top_k: int = 20) -> DataFrame:
    counted = keyword_rows(posts).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "keyword").limit(top_k)


def trending_keywords_by_category(posts: DataFrame, top_k: int = 12) -> DataFrame:
    counted = _counted(keyword_rows(posts, "category"), ["category", "keyword"])
    top = _top_per(counted, "category", [F.desc("count"), "keyword"], top_k)
    return top.orderBy("category", "rank").drop("rank")


def category_rank(category: Column) -> Column:
    """Place in the fixed report order; other categories come after."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_PRIORITY]), category)
    return F.when(place > 0, place).otherwise(len(CATEGORY_PRIORITY) + 1)


def in_category_order(report: DataFrame, *then: str | Column) -> DataFrame:
    return report.withColumn("category_rank", category_rank(F.col("category"))).orderBy(
        "category_rank", "category", *then
    )


def posts_per_hour(posts: DataFrame) -> DataFrame:
    return _counted(posts.select(F.hour("created_at").alias("hour")), ["hour"]).orderBy("hour")


def posts_per_day(posts: DataFrame) -> DataFrame:
    days = posts.select(F.date_trunc("day", "created_at").alias("date"))
    return _counted(days, ["date"]).orderBy("date")


def fake_real_distribution(classified: DataFrame) -> DataFrame:
    return _counted(classified, ["label"]).orderBy(F.desc("count"), "label")


def classification_by_category(classified: DataFrame) -> DataFrame:
    return _counted(classified, ["category", "label"]).orderBy("category", "label")


def _bin(probability: Column, n_bins: int) -> Column:
    place = F.least(F.greatest((probability * n_bins).cast("int"), F.lit(0)), F.lit(n_bins - 1)) / n_bins
    return F.when(probability.isNotNull(), place)


def _with_side(binned: DataFrame) -> DataFrame:
    side = F.when(F.col("bin_start") >= 0.5, "real").otherwise("fake")
    return binned.withColumn("side", side).orderBy("bin_start")


def prob_histogram(classified: DataFrame, n_bins: int = 10) -> DataFrame:
    """Posts per probability bin with the side the bin belongs to."""
    scored = classified.filter(F.col("fake_news_prob").isNotNull())
    return _with_side(_counted(scored.select(_bin(F.col("fake_news_prob"), n_bins).alias("bin_start")), ["bin_start"]))


def emotion_distribution(emotions: DataFrame) -> DataFrame:
    return _counted(emotions, ["emotion"]).orderBy(F.desc("count"), "emotion")


def emotion_by_category(emotions: DataFrame) -> DataFrame:
    return _counted(emotions, ["category", "emotion"]).orderBy("category", "emotion")


def avg_emotion_score(emotions: DataFrame) -> DataFrame:
    """Mean score per emotion, three decimals, highest first."""
    means = emotions.filter(F.col("emotion").isNotNull()).groupBy("emotion").agg(F.avg("emotion_score").alias("mean"))
    ordered = means.orderBy(F.desc_nulls_last("mean"), "emotion")
    return ordered.select("emotion", round_scaled(F.col("mean"), 3).alias("avg_score"))


def emotion_by_verdict(emotions: DataFrame, classified: DataFrame) -> DataFrame:
    """Emotion counts split by Fake and Real posts, matched by key."""
    labels = classified.select("unique_id", "label")
    return _counted(emotions.select("unique_id", "emotion").join(labels, "unique_id"), ["label", "emotion"]).orderBy(
        "label", "emotion"
    )


def corpus_kpis(posts: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: posts, authors, classified posts, fake rate and top keyword."""
    corpus = posts.agg(
        F.count(F.lit(1)).alias("total_posts"), F.count_distinct("username").alias("authors")
    )
    verdicts = classified.agg(
        F.count(F.lit(1)).alias("classified"),
        F.concat(percent(F.avg((~F.col("is_real")).cast("double"))).cast("string"), F.lit("%")).alias("fake_rate"),
    )
    return corpus.select(
        "*",
        verdicts.select("classified").scalar().alias("classified"),
        verdicts.select("fake_rate").scalar().alias("fake_rate"),
        trending_keywords(posts, 1).select("keyword").scalar().alias("top_keyword"),
    )


def _kpis(counted: DataFrame) -> DataFrame:
    return counted.select(
        "n_real",
        (F.col("n") - F.col("n_real")).alias("n_fake"),
        (F.col("n_real") / F.col("n") * 100).alias("pct_real"),
        ((F.col("n") - F.col("n_real")) / F.col("n") * 100).alias("pct_fake"),
        "avg_probability",
    )


def classification_kpis(classified: DataFrame) -> DataFrame:
    """One row: real and fake counts with percentages, mean probability."""
    counted = classified.agg(
        F.count_if("is_real").alias("n_real"),
        F.count(F.lit(1)).alias("n"),
        F.avg("fake_news_prob").alias("avg_probability"),
    )
    return _kpis(counted)


def _real_shares(shares: DataFrame) -> DataFrame:
    share = F.when(F.col("n_real") > 0, F.col("n_real") / F.col("n"))
    return shares.select("category", share.alias("real_share")).orderBy(F.desc_nulls_last("real_share"), "category")


def categories_by_real_share(classified: DataFrame) -> DataFrame:
    """Categories by share of real posts; without any real post null and last."""
    shares = (
        classified.filter(F.col("category").isNotNull() & F.col("label").isNotNull())
        .groupBy("category")
        .agg(F.count_if(F.col("label") == "Real").alias("n_real"), F.count(F.lit(1)).alias("n"))
    )
    return _real_shares(shares)


def _shares(counted: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("category"))
    return counted.select("category", "label", "count", (F.col("count") / total).alias("share"))


def share_within_category(classified: DataFrame) -> DataFrame:
    return _shares(classification_by_category(classified))


def classification_tables(classified: DataFrame, n_bins: int = 10) -> dict[str, DataFrame]:
    """The six reports on classified posts by name, from one read: grouping sets, whose few rows are written down."""
    rows = classified.select(
        "label", "category", _bin(F.col("fake_news_prob"), n_bins).alias("bin_start"), "is_real", "fake_news_prob"
    )
    sets = [["label"], ["category", "label"], ["bin_start"], []]
    cube = rows.groupingSets(sets, "label", "category", "bin_start").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("count"),
        F.count_if("is_real").alias("n_real"),
        F.avg("fake_news_prob").alias("avg_probability"),
    )
    cube = stored(cube, "classification")
    # One bit per column that a row does not group by: label, category, bin.
    labels, pairs, bins, whole = (cube.filter(F.col("level") == level) for level in (0b011, 0b001, 0b110, 0b111))
    pairs = pairs.filter(F.col("category").isNotNull() & F.col("label").isNotNull()).select("category", "label", "count")
    labels = labels.filter(F.col("label").isNotNull()).select("label", "count")
    real = F.coalesce(F.sum(F.when(F.col("label") == "Real", F.col("count"))), F.lit(0))
    return {
        "fake_real_distribution": labels.orderBy(F.desc("count"), "label"),
        "classification_by_category": pairs.orderBy("category", "label"),
        "prob_histogram": _with_side(bins.filter(F.col("bin_start").isNotNull()).select("bin_start", "count")),
        "classification_kpis": _kpis(whole.withColumnRenamed("count", "n")),
        "categories_by_real_share": _real_shares(pairs.groupBy("category").agg(real.alias("n_real"), F.sum("count").alias("n"))),
        "share_within_category": _shares(pairs),
    }


def emotion_kpis(emotions: DataFrame) -> DataFrame:
    """One row: posts analysed and the dominant emotion, capitalised."""
    counted = _counted(emotions, ["emotion"])
    dominant = F.min_by("emotion", F.struct(-F.col("count"), F.col("emotion")))
    return counted.agg(F.sum("count").alias("posts_analysed"), F.initcap(dominant).alias("dominant_emotion"))
