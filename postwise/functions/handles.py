"""Source labels from account handles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwise.constants import RELIABLE_DOMAINS


def suffixes(handle: Column) -> Column:
    """All dot-suffixes of a handle, the whole handle first."""
    labels = F.split(F.lower(handle), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
    )


def is_reliable(handle: Column, domains: Sequence[str] = RELIABLE_DOMAINS) -> Column:
    """Handle equals a listed domain or is a sub-handle of one.

    Every dot-suffix of the handle is looked up in the list, so the work grows
    with the dots in a handle and not with the length of the list.
    """
    return F.exists(suffixes(handle), lambda suffix: suffix.isin(*domains))


def source_label(handle: Column, domains: Sequence[str] = RELIABLE_DOMAINS) -> Column:
    return F.when(is_reliable(handle, domains), "reliable").otherwise("unverified")


def unique_id(username: Column, created_at: Column) -> Column:
    """Key of a post: ``username_created_at``; a missing part is written ``None``.

    A null key would make all such posts one post.
    """
    missing = F.lit("None")
    return F.concat(F.coalesce(username, missing), F.lit("_"), F.coalesce(created_at.cast("string"), missing))
