"""Rounding that agrees between engines, and binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half up, as floor(x * 10^places + 0.5) / 10^places; infinities and nulls stay."""
    k = float(10**places)
    return F.when(F.abs(x) == float("inf"), x).otherwise(F.floor(x * k + 0.5) / k)


def floored(x: Column, places: int) -> Column:
    k = float(10**places)
    return F.floor(x * k) / k


def heat_level(n: Column) -> Column:
    """0, 1, 2-3, 4-6, 7 and more as levels 0 to 4."""
    return F.when(n <= 0, 0).when(n == 1, 1).when(n <= 3, 2).when(n <= 6, 3).otherwise(4)
