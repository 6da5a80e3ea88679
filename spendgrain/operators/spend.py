"""Where the money goes: totals, categories, suppliers, prices and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_label, month_number, year_label
from spendgrain.functions.numeric import half_up, mean, money, percent
from spendgrain.operators.ranking import largest_first, top_n
from spendgrain.plans import marts
from spendgrain.tables import Tables


def executive_summary(t: Tables, *, approximate: bool = False) -> DataFrame:
    """Orders, suppliers and spend overall. Approximate counts avoid moving every order number.

    Exact counts are scalars over one column each, so no line is repeated for
    them.
    """
    usd = F.when(F.col("currency") == "USD", F.col("total_amount_usd")).otherwise(0)

    def distinct(column: str) -> Column:
        if approximate:
            return F.approx_count_distinct(column)
        return F.any_value(t.orders(column).distinct().agg(F.count(column).alias("n")).scalar())

    sums = t.orders("po_number", "supplier_id", "total_amount_ngn", "total_amount_usd", "currency")
    return sums.agg(
        distinct("po_number").alias("total_orders"),
        distinct("supplier_id").alias("total_suppliers"),
        money(F.sum("total_amount_ngn"), 0).alias("total_spend_ngn"),
        half_up(mean("total_amount_ngn"), 0).alias("avg_order_value"),
        money(F.sum(usd), 0).alias("total_usd_spend"),
    )


def category_spend(t: Tables) -> DataFrame:
    """Spend, share, average and supplier count per category, largest first."""
    grouped = (
        t.orders("category", "supplier_id", "total_amount_ngn")
        .groupBy("category")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount_ngn").alias("spend"),
            half_up(mean("total_amount_ngn"), 0).alias("avg_order_value"),
            F.countDistinct("supplier_id").alias("supplier_count"),
        )
    )
    result = grouped.select(
        "category",
        "order_count",
        money(F.col("spend"), 0).alias("total_spend"),
        half_up(percent(F.col("spend"), marts.total_spend(t).scalar()), 2).alias("pct_of_total"),
        "avg_order_value",
        "supplier_count",
    )
    return largest_first(result, "total_spend", "category")


def category_share(t: Tables) -> DataFrame:
    """Spend and share per category, as exported: largest first."""
    grouped = t.orders("category", "total_amount_ngn").groupBy("category").agg(F.sum("total_amount_ngn").alias("spend"))
    result = grouped.select(
        "category",
        money(F.col("spend"), 2).alias("total_spend_ngn"),
        half_up(percent(F.col("spend"), marts.total_spend(t).scalar()), 2).alias("pct_of_total"),
    )
    return largest_first(result, "total_spend_ngn", "category")


def supplier_concentration(t: Tables, limit: int | None = 10) -> DataFrame:
    """Largest suppliers with their share of all spend.

    Lines are summed per supplier before the supplier table is joined for
    the country, so the join sees one row per supplier and category.
    """
    per_supplier = (
        t.orders("supplier_id", "supplier_name", "category", "total_amount_ngn")
        .groupBy("supplier_id", "supplier_name", "category")
        .agg(F.count("*").alias("orders"), F.sum("total_amount_ngn").alias("spend"))
    )
    grouped = (
        per_supplier.join(t.suppliers("supplier_id", "country"), "supplier_id", "left")
        .groupBy("supplier_name", "category", "country")
        .agg(F.sum("orders").alias("order_count"), F.sum("spend").alias("spend"))
    )
    result = grouped.select(
        "supplier_name",
        "category",
        "country",
        "order_count",
        money(F.col("spend"), 0).alias("total_spend"),
        half_up(percent(F.col("spend"), marts.total_spend(t).scalar()), 2).alias("pct_of_total_spend"),
    )
    return top_n(result, limit, "total_spend", "supplier_name", "category", "country")


def price_variance(
    t: Tables, *, min_spread_pct: float | None = 10.0, limit: int | None = 20
) -> DataFrame:
    """Materials bought from several suppliers at different prices.

    With ``min_spread_pct=None`` every material with a saving qualifies.
    """
    stats = marts.price_stats(t).where("supplier_count > 1").drop("overpayment_pct")
    if min_spread_pct is None:
        stats = stats.where("potential_savings_ngn > 0")
    else:
        stats = stats.where(F.col("price_variance_pct") > min_spread_pct)
    return top_n(stats, limit, "potential_savings_ngn", "material_name", "category")


def price_overpayment(t: Tables, *, min_pct: float = 10.0, limit: int | None = 10) -> DataFrame:
    """Materials whose average price exceeds the lowest one by more than ``min_pct`` percent."""
    stats = (
        marts.price_stats(t)
        .where((F.col("supplier_count") > 1) & (F.col("overpayment_pct") > min_pct))
        .drop("price_variance_pct")
    )
    return top_n(stats, limit, "potential_savings_ngn", "material_name", "category")


def spend_trend(t: Tables) -> DataFrame:
    """Orders, spend and average per year, month and category."""
    day = F.col("po_date")
    return (
        t.orders("po_date", "category", "total_amount_ngn")
        .groupBy(year_label(day).alias("year"), month_number(day).alias("month"), "category")
        .agg(
            F.count("*").alias("order_count"),
            money(F.sum("total_amount_ngn"), 0).alias("total_spend"),
            half_up(mean("total_amount_ngn"), 0).alias("avg_order_value"),
        )
        .orderBy("year", "month", "category")
    )


def monthly_spend_by_category(t: Tables) -> DataFrame:
    return (
        t.orders("po_date", "category", "total_amount_ngn")
        .where("po_date IS NOT NULL")
        .groupBy(month_label(F.col("po_date")).alias("month"), "category")
        .agg(money(F.sum("total_amount_ngn"), 2).alias("total_spend_ngn"))
        .orderBy("month", "category")
    )
