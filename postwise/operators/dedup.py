"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key by ``order``, which should be a total order.

    The rank limit is applied in every input task before the shuffle, so a key
    shared by a large part of the rows is cut to one row per task first.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
