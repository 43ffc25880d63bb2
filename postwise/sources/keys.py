"""Tables of keys that are stored bucketed and sorted, so that an anti-join does not shuffle them.

The table is Parquet below a path of the caller's; its definition is entered in the session's catalog when it
is opened, so every session that names the same path and number of buckets sees the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwise.operators.incremental import distinct_keys
from postwise.session import stored


def open_keys(spark: SparkSession, name: str, path: str, buckets: int, key: str = "unique_id") -> DataFrame:
    """The key table at ``path`` under a catalog name, empty before the first keys.

    ``buckets`` is fixed for the life of the table: at least ``spark.sql.shuffle.partitions``, or Spark prefers
    to shuffle both sides.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (`{key}` STRING) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def add_keys(rows: DataFrame, name: str, buckets: int, key: str = "unique_id") -> None:
    """Append the keys of ``rows``; keys that are there already do no harm, so a failed batch can be repeated.

    The rows are dealt as the buckets are, so every task writes one file.
    """
    distinct_keys(rows, key).repartition(int(buckets), F.col(key)).write.insertInto(name)
    rows.sparkSession.catalog.refreshTable(name)


def unseen_keys(candidates: DataFrame, keys: DataFrame, key: str = "unique_id") -> DataFrame:
    """Distinct keys of ``candidates`` that the key table lacks; beyond the broadcast threshold only the candidates move."""
    return distinct_keys(candidates, key).join(keys, key, "left_anti")


def unseen_by_keys(candidates: DataFrame, keys: DataFrame, key: str = "unique_id") -> DataFrame:
    """Rows of ``candidates`` whose key is not in the key table, as ``incremental.unseen`` gives them."""
    return candidates.join(stored(unseen_keys(candidates, keys, key), "pending"), key, "left_semi")
