"""Text cleaning and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendgrain.model import FALSE_WORDS, TRUE_WORDS


def slug(name: str) -> str:
    """Header or file name in lower snake form."""
    text = name.strip().lower().replace("&", "and")
    for separator in "/- ":
        text = text.replace(separator, "_")
    return text


def filled(value: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(value), F.lit(""))


def yes_no(value: Column) -> Column:
    """Boolean from the usual spellings, NULL for anything else."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def currency_symbol(unit: Column) -> Column:
    return F.when(unit == "USD", F.lit("$")).otherwise(F.lit("₦"))


def currency_text(value: Column, unit: Column) -> Column:
    """Whole units with thousands separators behind the currency symbol."""
    return F.concat(currency_symbol(unit), F.format_number(value, 0))


def currency_short(value: Column, unit: Column) -> Column:
    """Compact form with a B, M or K suffix."""
    size = F.abs(value)
    number = (
        F.when(size >= 1e9, F.format_string("%.1fB", value / 1e9))
        .when(size >= 1e6, F.format_string("%.1fM", value / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", value / 1e3))
        .otherwise(F.format_number(value, 0))
    )
    return F.concat(currency_symbol(unit), number)


def metric_text(value: Column, unit: Column) -> Column:
    """Display text of a metric: money by its currency, anything else as a percentage."""
    return F.when(unit.isin("NGN", "USD"), currency_text(value, unit)).otherwise(F.format_string("%.2f%%", value))
