import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_label, month_number, parse_date, year_label
from spendgrain.functions.numeric import half_up, lookup, percent, ratio
from spendgrain.functions.text import currency_short, currency_text, metric_text, slug, yes_no


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("value", "digits", "expected"),
    [(2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (1234.5649, 2, 1234.56), (1e17, 2, 1e17), (0.0, 2, 0.0)],
)
def test_half_up(spark, value, digits, expected):
    assert evaluate(spark, half_up(F.lit(value), digits)) == expected


def test_half_up_keeps_null(spark):
    assert evaluate(spark, half_up(F.lit(None).cast("double"), 2)) is None


def test_division_by_zero_is_null(spark):
    assert evaluate(spark, ratio(F.lit(1), F.lit(0))) is None
    assert evaluate(spark, percent(F.lit(1), F.lit(None).cast("int"))) is None
    assert evaluate(spark, percent(F.lit(1), F.lit(4))) == 25.0


def test_lookup_falls_back(spark):
    scores = {"Low": 1.0, "High": 0.2}
    assert evaluate(spark, lookup(F.lit("High"), scores, 0.4)) == 0.2
    assert evaluate(spark, lookup(F.lit("Unknown"), scores, 0.4)) == 0.4
    assert evaluate(spark, lookup(F.lit(None).cast("string"), scores, 0.4)) == 0.4


def test_slug():
    assert slug("  Vendor-ID ") == "vendor_id"
    assert slug("R&D / Cost") == "randd___cost"


@pytest.mark.parametrize(
    ("word", "expected"),
    [(" YES ", True), ("Approved", True), ("1", True), ("inactive", False), ("0", False), ("maybe", None), (None, None)],
)
def test_yes_no(spark, word, expected):
    assert evaluate(spark, yes_no(F.lit(word).cast("string"))) is expected


@pytest.mark.parametrize(
    ("value", "unit", "long", "short"),
    [
        (1234567.4, "NGN", "₦1,234,567", "₦1.2M"),
        (310390475723.0, "NGN", "₦310,390,475,723", "₦310.4B"),
        (-2500.0, "USD", "$-2,500", "$-2.5K"),
        (12.0, "USD", "$12", "$12"),
    ],
)
def test_currency_formats(spark, value, unit, long, short):
    assert evaluate(spark, currency_text(F.lit(value), F.lit(unit))) == long
    assert evaluate(spark, currency_short(F.lit(value), F.lit(unit))) == short


def test_metric_text(spark):
    assert evaluate(spark, metric_text(F.lit(12.345), F.lit("percent"))) in ("12.35%", "12.34%")
    assert evaluate(spark, metric_text(F.lit(1000.0), F.lit("USD"))) == "$1,000"


def test_dates(spark):
    day = F.lit(dt.date(2025, 3, 9))
    assert evaluate(spark, month_label(day)) == "2025-03"
    assert evaluate(spark, year_label(day)) == "2025"
    assert evaluate(spark, month_number(day)) == "03"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-03-09", dt.date(2025, 3, 9)),
        ("2025-03-09 17:30:00", dt.date(2025, 3, 9)),
        ("09/03/2025", dt.date(2025, 3, 9)),
        ("2024-13-40", None),
        ("soon", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    assert evaluate(spark, parse_date(F.lit(text).cast("string"), ("dd/MM/yyyy",))) == expected
