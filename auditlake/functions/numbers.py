"""Rounding for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, places: int) -> Column:
    """Round the decimal form of a double, ties to the even digit."""
    return F.bround(value.cast("decimal(38,18)"), places).cast("double")
