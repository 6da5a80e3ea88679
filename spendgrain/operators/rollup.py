"""Answers from merged partials (``plans.partials``): the same rows as from the lines they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.numeric import as_double, exact_sum, half_up, money, percent, ratio
from spendgrain.operators.ranking import largest_first, top_n
from spendgrain.operators.risk import IS_MAVERICK
from spendgrain.plans import marts
from spendgrain.plans.partials import SKETCH_ERROR
from spendgrain.tables import MONTH_COLUMN, Tables


def distinct_orders() -> Column:
    """Distinct order numbers of all merged rows, by the union of their sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg("orders"))


def category_spend(rows: DataFrame) -> DataFrame:
    """As ``spend.category_spend``."""
    total = rows.agg(F.sum("spend").alias("total")).scalar()
    grouped = rows.groupBy("category").agg(
        F.sum("lines").alias("order_count"),
        F.sum("spend").alias("spend"),
        F.sum("priced").alias("priced"),
        F.countDistinct("supplier_id").alias("supplier_count"),
    )
    result = grouped.select(
        "category",
        "order_count",
        money(F.col("spend"), 0).alias("total_spend"),
        half_up(percent(F.col("spend"), total), 2).alias("pct_of_total"),
        half_up(ratio(F.col("spend"), F.col("priced")), 0).alias("avg_order_value"),
        "supplier_count",
    )
    return largest_first(result, "total_spend", "category")


def monthly_spend(rows: DataFrame) -> DataFrame:
    """As ``spend.monthly_spend_by_category``."""
    known = rows.where(F.col(MONTH_COLUMN).rlike("^[0-9]{4}-"))
    grouped = known.groupBy(F.col(MONTH_COLUMN).alias("month"), "category")
    return grouped.agg(money(F.sum("spend"), 2).alias("total_spend_ngn")).orderBy("month", "category")


def price_variance(rows: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """As ``spend.price_variance`` over all materials with a saving."""
    stats = rows.groupBy("material_name", "category").agg(
        F.countDistinct("supplier_id").alias("supplier_count"),
        as_double(F.min("price_min")).alias("lowest"),
        ratio(F.sum("price_sum"), F.sum("prices")).alias("average"),
        as_double(F.max("price_max")).alias("highest"),
        F.sum("spend").alias("spend"),
    )
    found = marts.price_columns(stats).where("supplier_count > 1 AND potential_savings_ngn > 0").drop("overpayment_pct")
    return top_n(found, limit, "potential_savings_ngn", "material_name", "category")


def kpis(rows: DataFrame, t: Tables, *, price_limit: int | None = None) -> DataFrame:
    """As ``summary.filtered_kpis``; of the tables only the suppliers are read."""
    flagged = t.suppliers("supplier_id", "risk_level", "is_approved").where(IS_MAVERICK).select("supplier_id")
    per_supplier = rows.groupBy("supplier_id").agg(F.sum("spend").alias("spend"))
    maverick = per_supplier.join(flagged, "supplier_id").agg(money(F.coalesce(F.sum("spend"), F.lit(0)), 2).alias("v"))
    savings = price_variance(rows, limit=price_limit).agg(exact_sum("potential_savings_ngn").alias("v"))
    totals = per_supplier.agg(F.coalesce(F.sum("spend"), F.lit(0)).alias("spend"), F.count("supplier_id").alias("suppliers"))
    return totals.select(
        money(F.col("spend"), 2).alias("filtered_total_spend"),
        maverick.scalar().alias("filtered_maverick_spend"),
        savings.scalar().alias("filtered_savings"),
        F.col("suppliers").alias("filtered_supplier_count"),
    )


def supplier_activity(rows: DataFrame) -> DataFrame:
    """Spend, deliveries and about how many orders per supplier."""
    grouped = rows.groupBy("supplier_id").agg(
        F.sum("lines").alias("order_rows"),
        distinct_orders().alias("orders_estimate"),
        F.sum("spend").alias("spend"),
        F.sum("priced").alias("priced"),
        F.sum("on_time").alias("on_time"),
        F.sum("delivered").alias("delivered"),
    )
    return grouped.select(
        "supplier_id",
        "order_rows",
        "orders_estimate",
        money(F.col("spend"), 2).alias("total_spend_ngn"),
        half_up(ratio(F.col("spend"), F.col("priced")), 2).alias("avg_order_value"),
        marts.on_time_pct().alias("on_time_delivery_pct"),
    )


def category_orders(rows: DataFrame) -> DataFrame:
    """About how many distinct orders, and how many suppliers, each category has."""
    grouped = rows.groupBy("category")
    return grouped.agg(distinct_orders().alias("orders_estimate"), F.countDistinct("supplier_id").alias("unique_suppliers"))


def estimate_holds(estimate: Column, exact: Column, deviations: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard deviations of the exact count, or within one."""
    return F.abs(estimate - exact) <= F.greatest(exact * deviations * SKETCH_ERROR, F.lit(1.0))
