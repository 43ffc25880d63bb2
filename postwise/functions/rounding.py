"""Rounding rules of Python, numpy and printf as Spark columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """``f"{x:.<digits>f}"``: decided on the exact binary value, no grouping.

    The formatter drops the one value that is half of the last place although
    its binary value lies above the half; it is nudged over it.
    """
    half = float(f"5e-{digits + 1}")
    if Decimal(half) > Decimal(5).scaleb(-digits - 1):
        c = F.when(F.abs(c) == half, c * 1.000001).otherwise(c)
    return F.translate(F.format_number(c, digits), ",", "")


def round_exact(c: Column, digits: int) -> Column:
    """``round(x, digits)`` of Python floats."""
    return fixed(c, digits).cast("double")


def round_scaled(c: Column, digits: int) -> Column:
    """``Series.round(digits)``: scale, round half to even, scale back."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def percent(c: Column) -> Column:
    """``int(round(x * 100))`` for a share in [0, 1]."""
    return F.rint(c * 100.0).cast("long")
