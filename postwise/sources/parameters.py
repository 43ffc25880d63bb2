"""Parameter lists as small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postwise import constants


def reliable_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in constants.RELIABLE_DOMAINS], "domain string")


def reliable_accounts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in constants.RELIABLE_ACCOUNTS], "username string")


def keyword_themes(spark: SparkSession, themes: dict[str, list[str]] = constants.THEMES) -> DataFrame:
    """Keywords with theme and keyword rank in search order."""
    rows = [
        (theme_rank, theme, keyword_rank, keyword)
        for theme_rank, (theme, keywords) in enumerate(themes.items())
        for keyword_rank, keyword in enumerate(keywords)
    ]
    return spark.createDataFrame(
        rows, "theme_rank int, category string, keyword_rank int, keyword string"
    )


def as_themes(table: DataFrame) -> dict[str, list[str]]:
    """A keyword table as the themes of the ingest operators; a short list by nature."""
    rows = table.orderBy("theme_rank", "keyword_rank").select("category", "keyword").collect()
    themes: dict[str, list[str]] = {}
    for category, keyword in rows:
        themes.setdefault(category, []).append(keyword)
    return themes


def as_accounts(table: DataFrame) -> list[str]:
    return [r["username"] for r in table.select("username").distinct().orderBy("username").collect()]


def as_bounds(table: DataFrame) -> dict[str, float]:
    return {r["name"]: r["value"] for r in table.select("name", "value").collect()}


def thresholds(spark: SparkSession) -> DataFrame:
    """Probability thresholds and metric bands by name."""
    rows = [
        ("likely", constants.LIKELY),
        ("probable", constants.PROBABLE),
        ("possible", constants.POSSIBLE),
    ]
    for name, (first, second) in constants.BANDS.items():
        rows += [(f"{name}_first", first), (f"{name}_second", second)]
    return spark.createDataFrame(rows, "name string, value double")
