"""Aggregates that several queries build on.

Orders and incidents are aggregated on their own before they meet, so a
supplier with many orders and many incidents is never counted twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_number, year_label
from spendgrain.functions.numeric import as_double, half_up, mean, money, percent, ratio
from spendgrain.tables import Tables


def base_mart(mart: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A mart that is read back where the tables have it stored."""

    @wraps(mart)
    def given(t: Tables, **options) -> DataFrame:
        stored = None if options else t.bases.get(mart.__name__)
        return mart(t, **options) if stored is None else stored

    BASES[mart.__name__] = given
    return given


#: Marts that others build on, by name.
BASES: dict[str, Callable[..., DataFrame]] = {}


def on_time_lines() -> Column:
    return F.count_if(F.col("actual_delivery_date") <= F.col("expected_delivery_date"))


def delivered_lines() -> Column:
    return F.count("actual_delivery_date")


@base_mart
def total_spend(t: Tables) -> DataFrame:
    """One row: the exact spend over all lines. Reads a single column and shuffles one row per task."""
    return t.orders("total_amount_ngn").agg(F.sum("total_amount_ngn").alias("total"))


def on_time_pct() -> Column:
    """Delivered lines that were on time, in percent."""
    return half_up(percent(F.col("on_time"), F.col("delivered")), 2)


def merged(keys: list[str], *parts: DataFrame) -> DataFrame:
    """One row per group of all measures that the parts, each with one row per group, have of it.

    The few rows per group meet in a union, not a join, so groups with NULL
    keys stay. A measure that no part has of a group is NULL.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in rows.columns if c not in keys))


def distinct_count(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Per group how many values a column has. Only keys and values are shuffled; groups without any value are left out."""
    return rows.select(*keys, column).where(F.col(column).isNotNull()).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def supplier_orders(t: Tables) -> DataFrame:
    """Order activity per supplier, with exact sums.

    Sums combine before they are shuffled; they do not travel with the order
    numbers that are counted.
    """
    sums = (
        t.orders("supplier_id", "total_amount_ngn", "actual_delivery_date", "expected_delivery_date")
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("order_rows"),
            F.sum("total_amount_ngn").alias("spend"),
            F.count("total_amount_ngn").alias("priced_rows"),
            on_time_lines().alias("on_time"),
            delivered_lines().alias("delivered"),
        )
    )
    numbers = distinct_count(t.orders("supplier_id", "po_number"), ["supplier_id"], "po_number", "total_orders")
    return merged(["supplier_id"], sums, numbers).withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))


def supplier_incidents(t: Tables) -> DataFrame:
    """Incident activity per supplier."""
    return (
        t.incidents("supplier_id", "incident_id", "cost_impact_ngn")
        .groupBy("supplier_id")
        .agg(
            F.countDistinct("incident_id").alias("incidents"),
            F.count("*").alias("incident_rows"),
            F.sum("cost_impact_ngn").alias("quality_cost"),
        )
    )


@base_mart
def supplier_performance(t: Tables, *, compat: bool = False) -> DataFrame:
    """Orders, spend, delivery and quality per supplier.

    ``compat`` repeats the totals of a plain orders-by-incidents join, in
    which spend counts once per incident and quality cost once per order
    line. They are scaled, not exploded. Averages and rates do not change.
    """
    spend, cost = F.col("spend"), F.coalesce("quality_cost", F.lit(0))
    if compat:
        # Products of decimals and row counts need the full width.
        rows = "decimal(18,0)"
        spend = spend.cast("decimal(20,2)") * F.greatest(F.col("incident_rows"), F.lit(1)).cast(rows)
        cost = cost.cast("decimal(20,2)") * F.greatest(F.col("order_rows"), F.lit(1)).cast(rows)
    return (
        t.suppliers("supplier_id", "supplier_name", "category", "country", "risk_level", "quality_rating")
        .join(supplier_orders(t), "supplier_id", "left")
        .join(supplier_incidents(t), "supplier_id", "left")
        .select(
            "supplier_id",
            "supplier_name",
            "category",
            "country",
            "risk_level",
            "quality_rating",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            money(spend, 2).alias("total_spend_ngn"),
            half_up(ratio(F.col("spend"), F.col("priced_rows")), 2).alias("avg_order_value"),
            on_time_pct().alias("on_time_delivery_pct"),
            F.coalesce("incidents", F.lit(0)).alias("quality_incidents"),
            money(cost, 2).alias("total_quality_cost"),
        )
    )


def category_month(t: Tables) -> DataFrame:
    """Distinct orders and suppliers, spend and average per category and month.

    Lines are shuffled once per count: reduced per order, with the sums, and
    reduced per supplier.
    """
    keys = ["category", "year", "month"]
    lines = (
        t.orders("category", "po_date", "po_number", "supplier_id", "total_amount_ngn")
        .where("po_date IS NOT NULL")
        .withColumns({"year": year_label(F.col("po_date")), "month": month_number(F.col("po_date"))})
    )
    per_order = lines.groupBy(*keys, "po_number").agg(F.sum("total_amount_ngn").alias("spend"), F.count("total_amount_ngn").alias("priced"))
    orders = per_order.groupBy(*keys).agg(
        F.count("po_number").alias("total_orders"), F.sum("spend").alias("spend"), F.sum("priced").alias("priced")
    )
    return merged(keys, orders, distinct_count(lines, keys, "supplier_id", "unique_suppliers")).select(
        *keys,
        "total_orders",
        money(F.col("spend"), 2).alias("total_spend_ngn"),
        half_up(ratio(F.col("spend"), F.col("priced")), 2).alias("avg_order_value"),
        F.coalesce("unique_suppliers", F.lit(0)).alias("unique_suppliers"),
    )


def overpayment(spend: Column, average: Column, lowest: Column) -> Column:
    """Spend above what the lowest price would have cost."""
    return half_up(as_double(spend) * (average - lowest) / F.nullif(average, F.lit(0.0)), 0)


@base_mart
def savings_opportunities(t: Tables, *, min_orders: int = 5, min_pct: float = 5.0) -> DataFrame:
    """Suppliers whose average price lies well above their own best price in a category."""
    stats = (
        t.orders("category", "supplier_name", "unit_price_ngn", "total_amount_ngn")
        .groupBy("category", "supplier_name")
        .agg(
            F.count("*").alias("order_count"),
            mean("unit_price_ngn").alias("average"),
            as_double(F.min("unit_price_ngn")).alias("lowest"),
            F.sum("total_amount_ngn").alias("spend"),
        )
    )
    average, lowest = F.col("average"), F.col("lowest")
    return stats.select(
        "category",
        "supplier_name",
        "order_count",
        half_up(average, 2).alias("avg_price_paid"),
        half_up(lowest, 2).alias("best_price"),
        half_up((average - lowest) / F.nullif(lowest, F.lit(0.0)) * 100, 2).alias("potential_savings_pct"),
        overpayment(F.col("spend"), average, lowest).alias("potential_savings_ngn"),
    ).where((F.col("order_count") > min_orders) & (F.col("potential_savings_pct") > min_pct))


@base_mart
def price_stats(t: Tables) -> DataFrame:
    """Price spread of each material between its suppliers, who are counted apart from the prices."""
    keys = ["material_name", "category"]
    prices = (
        t.orders(*keys, "unit_price_ngn", "total_amount_ngn")
        .groupBy(*keys)
        .agg(
            as_double(F.min("unit_price_ngn")).alias("lowest"),
            mean("unit_price_ngn").alias("average"),
            as_double(F.max("unit_price_ngn")).alias("highest"),
            F.sum("total_amount_ngn").alias("spend"),
        )
    )
    counts = distinct_count(t.orders(*keys, "supplier_id"), keys, "supplier_id", "supplier_count")
    return price_columns(merged(keys, prices, counts).withColumn("supplier_count", F.coalesce("supplier_count", F.lit(0))))


def price_columns(stats: DataFrame) -> DataFrame:
    """Spread and overpayment from the lowest, average and highest price and the spend of each material."""
    lowest, average, highest = F.col("lowest"), F.col("average"), F.col("highest")
    base = F.nullif(lowest, F.lit(0.0))
    return stats.select(
        "material_name",
        "category",
        "supplier_count",
        half_up(lowest, 2).alias("min_price"),
        half_up(average, 2).alias("avg_price"),
        half_up(highest, 2).alias("max_price"),
        half_up((highest - lowest) / base * 100, 2).alias("price_variance_pct"),
        half_up((average - lowest) / base * 100, 2).alias("overpayment_pct"),
        overpayment(F.col("spend"), average, lowest).alias("potential_savings_ngn"),
    )


@base_mart
def supplier_category(t: Tables) -> DataFrame:
    """Volume, cost, delivery and quality per category and supplier.

    Lines are first reduced to one row per category, supplier and order.
    That grain counts orders without a distinct and meets the incidents of
    the same order and supplier exactly once per category. The lines are
    moved once, to where both happen: few of them agree in all keys, and they
    are narrower than sums. Lines without a category take no part.
    """
    keys = ["category", "supplier_id", "supplier_name"]
    per_order = (
        t.orders(
            *keys, "po_number", "quantity", "total_amount_ngn", "actual_delivery_date", "expected_delivery_date"
        )
        .where("category IS NOT NULL")
        .repartition("po_number", "supplier_id")
        .groupBy(*keys, "po_number")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("total_amount_ngn").alias("spend"),
            on_time_lines().alias("on_time"),
            delivered_lines().alias("delivered"),
        )
    )
    incidents = (
        t.incidents("po_number", "supplier_id", "incident_id", "cost_impact_ngn")
        .groupBy("po_number", "supplier_id")
        .agg(F.countDistinct("incident_id").alias("incidents"), F.sum("cost_impact_ngn").alias("quality_cost"))
    )
    per_supplier = (
        per_order.join(incidents, ["po_number", "supplier_id"], "left")
        .groupBy(*keys)
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("spend").alias("spend"),
            F.sum("on_time").alias("on_time"),
            F.sum("delivered").alias("delivered"),
            F.coalesce(F.sum("incidents"), F.lit(0)).alias("quality_incident_count"),
            F.coalesce(F.sum("quality_cost"), F.lit(0)).alias("quality_cost"),
            F.count("po_number").alias("total_orders"),
        )
        .where(F.round("quantity", 2) > 0)
    )
    return per_supplier.join(t.suppliers("supplier_id", "risk_level"), "supplier_id").select(
        *keys,
        "risk_level",
        money(F.col("quantity"), 2).alias("total_quantity"),
        money(F.col("spend"), 2).alias("total_spend_ngn"),
        half_up(ratio(F.col("spend"), F.col("quantity")), 4).alias("avg_unit_cost_ngn"),
        on_time_pct().alias("on_time_delivery_pct"),
        "quality_incident_count",
        money(F.col("quality_cost"), 2).alias("total_quality_cost_ngn"),
        "total_orders",
    )


@base_mart
def category_history(t: Tables) -> DataFrame:
    """Quantity, spend and unit cost per category over all lines."""
    return (
        t.orders("category", "quantity", "total_amount_ngn")
        .groupBy("category")
        .agg(F.sum("quantity").alias("quantity"), F.sum("total_amount_ngn").alias("spend"))
        .select(
            "category",
            money(F.col("quantity"), 2).alias("category_quantity"),
            money(F.col("spend"), 2).alias("category_spend_ngn"),
            half_up(ratio(F.col("spend"), F.col("quantity")), 4).alias("category_avg_unit_cost"),
        )
    )
