"""Scores, labels and bands of a claim or post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwise.constants import EPSILON, LIKELY, MARGIN_GAIN, POSSIBLE, PROBABLE
from postwise.functions.rounding import percent, round_exact


def share_score(to_fake: Column, to_real: Column) -> Column:
    """Distance to the fake centre as a share of both; high means real."""
    return to_fake / (to_fake + to_real + EPSILON)


def margin_score(closer: Column, farther: Column, is_fake: Column) -> Column:
    """Interactive score, unrounded: the relative margin between two distances through a sigmoid."""
    margin = (farther - closer) / (closer + EPSILON)
    confidence = 1.0 / (1.0 + F.exp(-margin * MARGIN_GAIN))
    return F.when(is_fake, 1.0 - confidence).otherwise(confidence)


def probability_of(score: Column) -> Column:
    """The probability that is shown and banded: four decimals of a score."""
    return round_exact(score, 4)


def softmax_score(logits: Column) -> Column:
    """Probability of class 1 from two logits, unrounded."""
    top = F.greatest(logits[0], logits[1])
    fake, real = F.exp(logits[0] - top), F.exp(logits[1] - top)
    return real / (fake + real)


def softmax_real(logits: Column) -> Column:
    """Probability of class 1 from two logits, four decimals."""
    return probability_of(softmax_score(logits))


def cascade(finetuned: Column, reliability: Column, kmeans: Column) -> tuple[Column, Column]:
    """First available score and the scorer it came from."""
    probability = F.coalesce(finetuned, reliability, kmeans)
    based_on = (
        F.when(finetuned.isNotNull(), "xlm_roberta_finetuned")
        .when(reliability.isNotNull(), "reliability_classifier")
        .when(kmeans.isNotNull(), "kmeans")
    )
    return probability, based_on


def verdict_label(p: Column, likely: float = LIKELY, probable: float = PROBABLE, possible: float = POSSIBLE) -> Column:
    """Five levels; null stays null."""
    return (
        F.when(p >= likely, "true")
        .when(p >= probable, "very likely true")
        .when(p >= possible, "uncertain")
        .when(p > 0, "very likely false")
        .when(p.isNotNull(), "false")
    )


def score_percent(p: Column) -> Column:
    return percent(p)


def verdict_text(score: Column) -> Column:
    """Text of an unrounded score; its percent is rounded once."""
    return F.concat(percent(score).cast("string"), F.lit("% real"))


def probability_band(p: Column) -> Column:
    return (
        F.when(p.isNull(), "muted")
        .when(p >= LIKELY, "success")
        .when(p >= PROBABLE, "warning")
        .otherwise("danger")
    )


def tone(p: Column) -> Column:
    return F.when(p >= PROBABLE, "reliable").when(p.isNotNull(), "potentially misleading")


def real_fake(is_real: Column) -> Column:
    return F.when(is_real, "Real").when(~is_real, "Fake")


def answer_claims(
    claims: DataFrame,
    finetuned: str = "finetuned",
    reliability: str = "reliability",
    kmeans: str = "kmeans",
) -> DataFrame:
    """Answer any number of claims from the unrounded scores of the available scorers.

    Adds ``score``, ``probability`` (its four decimals), ``based_on``, ``verdict``, ``label``, ``score_pct``,
    ``band`` and ``tone``; a missing scorer is a null column. The verdict text comes from the score, all
    else from the probability.
    """
    score, based_on = cascade(F.col(finetuned), F.col(reliability), F.col(kmeans))
    scored = claims.withColumn("score", score).withColumn("based_on", based_on)
    scored = scored.withColumn("probability", probability_of(F.col("score")))
    p = F.col("probability")
    return scored.select(
        "*",
        verdict_text(F.col("score")).alias("verdict"),
        verdict_label(p).alias("label"),
        score_percent(p).alias("score_pct"),
        probability_band(p).alias("band"),
        tone(p).alias("tone"),
    )
