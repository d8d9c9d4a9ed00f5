"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def bucket_of(column: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the highest value lies in the last bin."""
    place = F.floor((column - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    return F.greatest(F.lit(0), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))).cast("long")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
