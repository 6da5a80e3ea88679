"""Headline metrics in long form, and the figures of a filtered view."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.numeric import exact_sum, half_up, money, percent
from spendgrain.functions.text import metric_text
from spendgrain.operators.distribution import savings_bootstrap
from spendgrain.operators.risk import IS_MAVERICK, fx_exposure, maverick_total
from spendgrain.operators.savings import consolidation, performance_savings
from spendgrain.operators.sourcing import constrained_savings, optimization_savings
from spendgrain.operators.spend import price_variance
from spendgrain.params import PRESETS, AllocationPolicy, SourcingRules
from spendgrain.plans import marts
from spendgrain.plans.shared import keep_lines
from spendgrain.tables import MONTH_COLUMN, Tables

# Metric names and units of the summary.
SUMMARY_ROWS = (
    ("Total Spend", "total_spend", "NGN"),
    ("Price Standardization Savings", "price", "NGN"),
    ("Supplier Performance Savings", "performance", "NGN"),
    ("Supplier Consolidation Savings", "consolidation", "NGN"),
    ("Optimization Savings", "optimization", "NGN"),
    ("Total Savings Potential", "total_savings", "NGN"),
    ("Savings Percentage", "savings_pct", "percent"),
    ("Optimization Savings Percentage", "optimization_pct", "percent"),
    ("Constrained Savings", "constrained", "NGN"),
    ("Constrained Savings Percentage", "constrained_pct", "percent"),
    ("Maverick Spend", "maverick", "NGN"),
    ("USD Spend", "usd", "USD"),
    ("FX Volatility", "fx_volatility", "percent"),
)
BOOTSTRAP_ROWS = (
    ("Bootstrap P05 Price Savings", "p05", "NGN"),
    ("Bootstrap Median Price Savings", "median", "NGN"),
    ("Bootstrap P95 Price Savings", "p95", "NGN"),
)

# Order columns that the figures of a filtered view use.
KPI_COLUMNS = ("supplier_id", "material_name", "category", "unit_price_ngn", "total_amount_ngn")


def _measures(df: DataFrame, **columns: str) -> DataFrame:
    """Named values of a one-row frame, one row each."""
    pairs = F.array(
        *(F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in columns.items())
    )
    return df.select(F.inline(pairs))


def insights_summary(
    t: Tables,
    *,
    rules: SourcingRules = PRESETS["standard"],
    policy: AllocationPolicy = AllocationPolicy(),
    replicates: int = 0,
    price_limit: int | None = None,
) -> DataFrame:
    """All headline metrics as metric, value, unit. With ``replicates`` also a bootstrap interval.

    Price savings are those of all materials, or of so many with the largest
    ones.

    Each measure is a one-row aggregate; their union is a few rows, from
    which the derived totals and percentages follow.
    """
    total = marts.total_spend(t).select(F.coalesce(money(F.col("total"), 2), F.lit(0.0)).alias("total"))
    price = price_variance(t, min_spread_pct=None, limit=price_limit).agg(exact_sum("potential_savings_ngn").alias("v"))
    merged = consolidation(t).agg(exact_sum("consolidation_savings_ngn").alias("v"))
    parts = [
        _measures(total, total_spend="total"),
        _measures(price, price="v"),
        _measures(performance_savings(t), performance="performance_improvement_savings_ngn"),
        _measures(merged, consolidation="v"),
        _measures(maverick_total(t), maverick="maverick_spend_ngn"),
        _measures(
            fx_exposure(t, round_first=False), usd="total_usd_spend", fx_volatility="fx_volatility_pct"
        ),
        _measures(
            optimization_savings(t, policy),
            optimization="optimization_savings_ngn",
            optimization_pct="optimization_savings_pct",
        ),
        _measures(
            constrained_savings(t, rules),
            constrained="constrained_savings_ngn",
            constrained_pct="constrained_savings_pct",
        ),
    ]
    rows = list(SUMMARY_ROWS)
    if replicates:
        parts.append(_measures(savings_bootstrap(t, replicates), p05="p05", median="median", p95="p95"))
        rows += BOOTSTRAP_ROWS

    def named(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0)).alias(name)

    derived = ("total_savings", "savings_pct")
    wide = reduce(DataFrame.unionByName, parts).agg(*(named(name) for _, name, _ in rows if name not in derived))
    savings = F.col("price") + F.col("performance") + F.col("consolidation")
    wide = wide.withColumn("total_savings", half_up(savings, 2)).withColumn(
        "savings_pct", F.coalesce(half_up(percent(savings, F.col("total_spend")), 4), F.lit(0.0))
    )
    long_form = F.array(
        *(
            F.struct(F.lit(label).alias("metric"), F.col(name).alias("value"), F.lit(unit).alias("unit"))
            for label, name, unit in rows
        )
    )
    return wide.select(F.inline(long_form))


def displayed(summary: DataFrame) -> DataFrame:
    """Metrics with a display text."""
    return summary.select("metric", metric_text(F.col("value"), F.col("unit")).alias("display"))


def filtered_view(
    t: Tables,
    categories: Sequence[str] | DataFrame = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> Tables:
    """Tables whose order lines lie in the categories and the inclusive date range.

    No category means all known ones. A long list is given as a table of keys:
    its columns may be any of the orders', such as category, supplier_id or, where
    lines are stored by month, po_month. The range applies only with both ends.
    Lines stored by month are read from the months of the range only.
    """
    if isinstance(categories, DataFrame):
        return filtered_view(t, (), start, end).matching_orders(categories)
    condition = F.col("category").isin(*categories) if categories else F.col("category").isNotNull()
    uses = ["category"]
    if start is not None and end is not None:
        condition = condition & F.col("po_date").between(F.lit(start), F.lit(end))
        uses.append("po_date")
        if MONTH_COLUMN in t.order_columns():
            condition = condition & F.col(MONTH_COLUMN).between(f"{start:%Y-%m}", f"{end:%Y-%m}")
            uses.append(MONTH_COLUMN)
    return t.where_orders(condition, *uses)


def of_categories(df: DataFrame, categories: Sequence[str] | DataFrame = ()) -> DataFrame:
    """The rows of a mart or recommendation table that belong to some categories; none means all known ones."""
    if isinstance(categories, DataFrame):
        return df.join(categories, "category", "left_semi")
    return df.where(F.col("category").isin(*categories) if categories else F.col("category").isNotNull())


def filtered_maverick_lines(
    t: Tables,
    categories: Sequence[str] | DataFrame = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """The filtered order lines bought from unapproved or high-risk suppliers, with the reason."""
    flagged = t.suppliers("supplier_id", "risk_level", "is_approved").where(IS_MAVERICK)
    lines = filtered_view(t, categories, start, end).orders("po_number", "po_date", "supplier_id", "material_id", "category", "total_amount_ngn")
    return lines.join(flagged, "supplier_id")


def filtered_kpis(
    t: Tables,
    categories: Sequence[str] | DataFrame = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    price_limit: int | None = None,
) -> DataFrame:
    """Spend, maverick spend, price savings and supplier count of the filtered lines, which are joined and written once."""
    view = keep_lines(filtered_view(t, categories, start, end), *KPI_COLUMNS)
    totals = view.orders("total_amount_ngn", "supplier_id").agg(
        F.coalesce(F.sum("total_amount_ngn"), F.lit(0)).alias("spend"),
        F.countDistinct("supplier_id").alias("suppliers"),
    )
    savings = price_variance(view, min_spread_pct=None, limit=price_limit).agg(exact_sum("potential_savings_ngn").alias("v"))
    return totals.select(
        money(F.col("spend"), 2).alias("filtered_total_spend"),
        maverick_total(view).select("maverick_spend_ngn").scalar().alias("filtered_maverick_spend"),
        savings.scalar().alias("filtered_savings"),
        F.col("suppliers").alias("filtered_supplier_count"),
    )
