"""Rounding, ratios and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Above 2^53 a double holds no fraction, so there is nothing left to round.
_INTEGRAL = float(2**53)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round a double half away from zero."""
    scale = float(10**digits)
    magnitude = F.abs(value) * scale
    rounded = F.signum(value) * F.floor(magnitude + 0.5) / F.lit(scale)
    return F.when(magnitude < _INTEGRAL, rounded).otherwise(value)


def as_double(value: Column) -> Column:
    return value.cast("double")


def money(total: Column, digits: int = 2) -> Column:
    """Round an exact decimal and hand it out as a double."""
    return as_double(F.round(total, digits))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in doubles; NULL when the denominator is zero or NULL."""
    return as_double(numerator) / F.nullif(as_double(denominator), F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return as_double(numerator) * 100.0 / F.nullif(as_double(denominator), F.lit(0.0))


def mean(name: str) -> Column:
    """Average as exact sum over count, so that it does not depend on the row order."""
    return ratio(F.sum(name), F.count(name))


def lookup(key: Column, table: dict, other: object) -> Column:
    """Value of a small fixed table, ``other`` for absent keys and NULL."""
    result = F.lit(other)
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def exact_sum(name: str) -> Column:
    """Sum of a money column held as double, taken in cents so that it does not depend on the row order."""
    return F.coalesce(as_double(F.sum(F.col(name).cast("decimal(28,2)"))), F.lit(0.0))
