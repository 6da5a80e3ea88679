"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def year_label(day: Column) -> Column:
    return F.date_format(day, "yyyy")


def month_number(day: Column) -> Column:
    return F.date_format(day, "MM")


# Spellings of days besides the ISO one, in the order in which they are preferred where all agree.
DATE_FORMATS = (
    "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "M.d.yyyy", "d-M-yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy",
)


def parse_date(value: Column, formats: tuple[str, ...] = ()) -> Column:
    """Date from text, NULL when it cannot be read. ISO dates and timestamps come first."""
    readings = [F.try_to_timestamp(value)] + [F.try_to_timestamp(value, F.lit(f)) for f in formats]
    return F.coalesce(*readings).cast("date")
