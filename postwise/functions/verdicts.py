"""Verdict and reasoning from free-text fact-check answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwise.functions.text import SPACE

# Accepted verdicts, line ends, colour codes.
VERDICTS = ("TRUE", "UNCERTAIN", "FALSE")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
COLOUR_CODE = r"\x1b\[[0-9;]*m"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def _is_verdict(line: Column) -> Column:
    return F.upper(_strip(line)).startswith("VERDICT:")


def parse_verdicts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``verdict`` and ``reasoning``.

    The first line that starts with ``VERDICT:`` decides; anything but the
    accepted values is UNCERTAIN. Reasoning is every later non-blank line, or
    the whole answer when there is none.
    """
    output = _strip(F.regexp_replace(F.col(text), COLOUR_CODE, ""))
    lines = df.withColumn("_output", output).withColumn("_lines", F.split("_output", LINE_END))
    found = lines.withColumn(
        "_at", F.array_position(F.transform("_lines", _is_verdict), True).cast("int")
    )
    line = F.upper(_strip(F.get("_lines", F.col("_at") - 1)))
    value = _strip(F.substring(line, F.lit(len("VERDICT:") + 1), F.length(line)))
    later = F.slice(F.col("_lines"), F.col("_at") + 1, F.size("_lines"))
    kept = F.filter(later, lambda x: _strip(x) != "")
    reasoning = F.nullif(_strip(F.array_join(kept, " ")), F.lit(""))
    return found.select(
        "*",
        F.when((F.col("_at") > 0) & value.isin(*VERDICTS), value).otherwise("UNCERTAIN").alias("verdict"),
        F.when(F.col("_at") > 0, F.coalesce(reasoning, F.col("_output")))
        .otherwise(F.col("_output"))
        .alias("reasoning"),
    ).drop("_output", "_lines", "_at")
