"""Landed payloads to unique, labelled raw posts.

A payload says how it was delivered where that is known: by an account's feed or by the search for a
word. Its category follows from that. Payloads without a known delivery are matched by
their author and by whole words of their text. All landed posts are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.constants import RELIABLE_ACCOUNTS, RELIABLE_DOMAINS, THEMES
from postwise.functions.handles import source_label, suffixes, unique_id
from postwise.functions.phrases import found_phrases, looked_up, one_of
from postwise.operators.dedup import first_rows
from postwise.operators.incremental import unseen_batch
from postwise.session import stored

POST_COLUMNS = ["username", "text", "created_at", "category", "source_label"]
SEARCH_ORDER = ["theme_rank", "keyword_rank"]


def complete(df: DataFrame) -> DataFrame:
    """Rows with a non-empty text and creation time."""
    return df.filter((F.length("text") > 0) & (F.length(F.col("created_at").cast("string")) > 0))


PLACE = T.StructType(
    [
        T.StructField("theme_rank", T.IntegerType()),
        T.StructField("keyword_rank", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("keyword", T.StringType()),
    ]
)


def _search_hits(themes: dict[str, list[str]], lang: str) -> Column:
    """Array of (theme_rank, keyword_rank, category, keyword) of the searches that found a payload."""
    places: dict[str, list[tuple]] = {}
    for theme_rank, (category, listed) in enumerate(themes.items()):
        for keyword_rank, word in enumerate(listed):
            places.setdefault(word.lower(), []).append((theme_rank, keyword_rank, category, word.lower()))
    feed, term = F.coalesce(F.col("feed"), F.lit("")), F.lower("term")
    delivered = (feed == "search") & F.coalesce(F.expr(one_of("lower(term)", places)), F.lit(False))
    unknown = (feed != "account") & (F.col("lang") == lang)
    words = F.when(delivered, F.array(term)).when(unknown, found_phrases("text", places))
    return looked_up(F.coalesce(words, F.array().cast("array<string>")), places, PLACE)


def _from_account(accounts: Sequence[str]) -> Column:
    feed = F.coalesce(F.col("feed"), F.lit(""))
    return (feed == "account") | ((feed == "") & F.coalesce(F.col("username").isin(*accounts), F.lit(False)))


def keyword_hits(payloads: DataFrame, themes: dict[str, list[str]] = THEMES, lang: str = "en") -> DataFrame:
    """One row per (keyword, post): the search that delivered the post, or the words of its text.

    The keywords are constants of the plan and each text is cut into words once, so only actual hits leave the
    scan. ``operators.phrases`` joins with tables of keywords that are too long for that.
    """
    hits = payloads.select("*", F.explode(_search_hits(themes, lang)).alias("_hit"))
    return hits.select(*payloads.columns, "_hit.*")


def _labelled(rows: DataFrame, domains: Sequence[str]) -> DataFrame:
    keyed = rows.withColumn("unique_id", unique_id(F.col("username"), F.col("created_at")))
    return keyed.withColumn("source_label", source_label(F.col("username"), domains))


def keyword_posts(
    payloads: DataFrame,
    themes: dict[str, list[str]] = THEMES,
    domains: Sequence[str] = RELIABLE_DOMAINS,
    lang: str = "en",
) -> DataFrame:
    """Themed posts: the first hit in search order owns a complete post, then one row per key.

    Incomplete payloads go first, so callers that need no text do not shuffle it.
    """
    owned = first_rows(keyword_hits(complete(payloads), themes, lang), "uri", SEARCH_ORDER)
    unique = first_rows(_labelled(owned, domains), "unique_id", [*SEARCH_ORDER, "uri"])
    return unique.select("uri", "unique_id", *POST_COLUMNS)


def account_posts(
    payloads: DataFrame,
    accounts: Sequence[str] = RELIABLE_ACCOUNTS,
    domains: Sequence[str] = RELIABLE_DOMAINS,
) -> DataFrame:
    """Posts from account feeds or by a listed account, category ``Reliable``."""
    feed = _labelled(complete(payloads).filter(_from_account(accounts)), domains)
    return feed.withColumn("category", F.lit("Reliable")).select("uri", "unique_id", *POST_COLUMNS)


def merge_feeds(account_rows: DataFrame, keyword_rows: DataFrame) -> DataFrame:
    """Both feeds with one row per key; the account feed wins."""
    both = account_rows.withColumn("_feed", F.lit(0)).unionByName(keyword_rows.withColumn("_feed", F.lit(1)))
    return first_rows(both, "unique_id", ["_feed", "uri"]).drop("_feed")


def themed_rows(
    payloads: DataFrame,
    themes: dict[str, list[str]] = THEMES,
    accounts: Sequence[str] = RELIABLE_ACCOUNTS,
    domains: Sequence[str] = RELIABLE_DOMAINS,
    lang: str = "en",
) -> DataFrame:
    """Every wanted payload with its best category and ``_place``, in one pass without a shuffle.

    An account feed comes before all searches, searches come in their order. Smaller places win.
    """
    hits = _search_hits(themes, lang)
    account = F.struct(
        F.lit(-1).alias("theme_rank"), F.lit(-1).alias("keyword_rank"), F.lit("Reliable").alias("category"), F.lit("").alias("keyword")
    )
    best = F.when(_from_account(accounts), account).otherwise(F.array_min(hits))
    # Exploding drops the rows without a place, and no filter repeats the search below it.
    found = complete(payloads).select("*", F.explode(F.array_compact(F.array(best))).alias("_place"))
    return _labelled(found.withColumn("category", F.col("_place.category")), domains)


def themed_posts(payloads: DataFrame, **options) -> DataFrame:
    """One labelled row per key of all wanted payloads: both feeds, merged, from one pass."""
    rows = first_rows(themed_rows(payloads, **options), "unique_id", ["_place", "uri"])
    return rows.select("uri", "unique_id", *POST_COLUMNS)


def new_posts(payloads: DataFrame, known: DataFrame, **options) -> DataFrame:
    """Posts of one landed batch that are not stored yet."""
    return unseen_batch(themed_posts(payloads, **options), known)


def label_sources(posts: DataFrame, domains: DataFrame) -> DataFrame:
    """Add ``source_label`` from a table of domains instead of a list.

    The distinct handles are matched, not the posts: their dot-suffixes are
    joined to the domains, and the reliable handles are looked up per post.
    """
    handles = stored(posts.select("username").distinct(), "handles")
    matched = handles.select("username", F.explode(suffixes(F.col("username"))).alias("domain"))
    reliable = stored(matched.join(domains, "domain", "left_semi").select("username").distinct(), "reliable")
    flagged = reliable.withColumn("source_label", F.lit("reliable"))
    labelled = posts.drop("source_label").join(flagged, "username", "left")
    return labelled.withColumn("source_label", F.coalesce("source_label", F.lit("unverified")))


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing source labels become ``unverified``, missing style features zeros."""
    zeros = F.array(*[F.lit(0.0)] * 5)
    filled = df.withColumn("source_label", F.coalesce("source_label", F.lit("unverified")))
    return filled.withColumn("style_features", F.coalesce("style_features", zeros))
