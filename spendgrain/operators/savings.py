"""What could be saved: prices, weak suppliers, fragmentation and scenarios."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.numeric import as_double, exact_sum, half_up, money, percent, ratio
from spendgrain.operators.ranking import largest_first, top_n
from spendgrain.operators.spend import price_variance
from spendgrain.params import SCENARIOS, ScenarioFactors
from spendgrain.plans import marts
from spendgrain.tables import Tables

# Assumed saving rates.
LATE_COST_RATE = 0.03
CONSOLIDATION_RATE = 0.06
SUMMARY_CONSOLIDATION_RATE = 0.05

# Which suppliers underperform and which should be replaced.
UNDERPERFORMS = "(on_time_delivery_pct < 80 OR quality_incidents > 2) AND total_orders > 5"
REPLACEABLE = "on_time_delivery_pct < 70 AND quality_incidents > 3"


def consolidation(t: Tables, *, max_suppliers: int = 8) -> DataFrame:
    """Categories spread over more than ``max_suppliers`` suppliers."""
    result = (
        t.orders("category", "supplier_id", "total_amount_ngn")
        .groupBy("category")
        .agg(F.countDistinct("supplier_id").alias("supplier_count"), F.sum("total_amount_ngn").alias("spend"))
        .where(F.col("supplier_count") > max_suppliers)
        .select(
            "category",
            "supplier_count",
            money(F.col("spend"), 0).alias("total_spend"),
            half_up(ratio(F.col("spend"), F.col("supplier_count")), 0).alias("spend_per_supplier"),
            half_up(as_double(F.col("spend")) * CONSOLIDATION_RATE, 2).alias("consolidation_savings_ngn"),
        )
    )
    return largest_first(result, "total_spend", "category")


def performance_savings(t: Tables, *, limit: int | None = None) -> DataFrame:
    """Quality cost and late-delivery cost of underperforming suppliers.

    With a limit only the largest suppliers by spend count, in whole units.
    """
    weak = marts.supplier_performance(t).where(UNDERPERFORMS)
    if limit is not None:
        weak = weak.withColumns(
            {name: half_up(F.col(name), 0) for name in ("total_spend_ngn", "total_quality_cost")}
        )
        weak = top_n(weak, limit, "total_spend_ngn", "supplier_id")
    quality, delivery = exact_sum("total_quality_cost"), exact_sum("total_spend_ngn") * LATE_COST_RATE
    return weak.agg(
        F.count("*").alias("suppliers"),
        half_up(quality, 2).alias("quality_cost_ngn"),
        half_up(delivery, 2).alias("delivery_cost_ngn"),
        half_up(quality + delivery, 2).alias("performance_improvement_savings_ngn"),
    )


def savings_summary(t: Tables, *, max_suppliers: int = 10) -> DataFrame:
    """One row per kind of saving: price, quality cost and consolidation."""

    def row(source: DataFrame, label: str, count: Column, total: Column) -> DataFrame:
        return source.agg(
            F.lit(label).alias("opportunity_type"),
            count.alias("opportunities"),
            half_up(total, 0).alias("total_potential_savings"),
        )

    price = marts.savings_opportunities(t)
    costly = (
        marts.supplier_incidents(t)
        .where("incidents > 0")
        .join(t.suppliers("supplier_id"), "supplier_id")
        .select("supplier_id", money(F.coalesce("quality_cost", F.lit(0)), 2).alias("total_quality_cost"))
    )
    spread = (
        t.orders("category", "supplier_id", "total_amount_ngn")
        .groupBy("category")
        .agg(F.countDistinct("supplier_id").alias("suppliers"), F.sum("total_amount_ngn").alias("spend"))
        .where(F.col("suppliers") > max_suppliers)
    )
    saved = F.coalesce(as_double(F.sum("spend")), F.lit(0.0)) * SUMMARY_CONSOLIDATION_RATE
    return (
        row(price, "Price Standardization", F.count("*"), exact_sum("potential_savings_ngn"))
        .unionByName(row(costly, "Quality Cost Reduction", F.count("supplier_id"), exact_sum("total_quality_cost")))
        .unionByName(row(spread, "Supplier Consolidation", F.count("category"), saved))
    )


def action_items(t: Tables, *, per_kind: int = 5) -> DataFrame:
    """Suppliers to renegotiate with and suppliers to replace, a few of each."""

    def labelled(df: DataFrame, action: str, saving: Column, reason: str) -> DataFrame:
        return df.select(
            F.lit(action).alias("action_item"),
            F.col("supplier_name").alias("target"),
            "category",
            half_up(saving, 0).alias("estimated_savings"),
            F.lit(reason).alias("reason"),
        )

    pricey = top_n(
        marts.savings_opportunities(t), per_kind, "potential_savings_ngn", "supplier_name", "category"
    )
    weak = top_n(
        marts.supplier_performance(t).where(REPLACEABLE), per_kind, "total_spend_ngn", "supplier_id"
    )
    return labelled(
        pricey, "Renegotiate Price", F.col("potential_savings_ngn"), "High price variance detected"
    ).unionByName(
        labelled(
            weak,
            "Replace Supplier",
            F.col("total_quality_cost") + F.col("total_spend_ngn") * LATE_COST_RATE,
            "Poor delivery & quality performance",
        )
    )


def savings_components(t: Tables, *, price_limit: int | None = None, max_suppliers: int = 8) -> DataFrame:
    """The three savings of each category, one row per category that has any.

    Price and consolidation follow the category of the lines, performance
    the category of the supplier.
    """

    def part(df: DataFrame, component: str, value: Column) -> DataFrame:
        return df.select("category", F.lit(component).alias("component"), value.alias("value"))

    price = (
        price_variance(t, min_spread_pct=None, limit=price_limit)
        .groupBy("category")
        .agg(exact_sum("potential_savings_ngn").alias("v"))
    )
    performance = (
        marts.supplier_performance(t)
        .where(UNDERPERFORMS)
        .groupBy("category")
        .agg((exact_sum("total_quality_cost") + exact_sum("total_spend_ngn") * LATE_COST_RATE).alias("v"))
    )
    parts = (
        part(price, "price", F.col("v"))
        .unionByName(part(performance, "performance", F.col("v")))
        .unionByName(
            part(consolidation(t, max_suppliers=max_suppliers), "consolidation", F.col("consolidation_savings_ngn"))
        )
    )
    return parts.groupBy("category").agg(
        *(
            F.coalesce(F.max(F.when(F.col("component") == name, F.col("value"))), F.lit(0.0)).alias(name)
            for name in ("price", "performance", "consolidation")
        )
    )


def savings_scenarios(
    t: Tables,
    scenarios: Mapping[str, ScenarioFactors] = SCENARIOS,
    *,
    by_category: bool = False,
    price_limit: int | None = None,
) -> DataFrame:
    """Savings components under each scenario, in total or rolled up from the categories.

    The factors are literals in the plan. ``by_category`` adds one row per
    category below each total, whose category is NULL; all percentages refer
    to the whole spend.
    """
    table = F.array(
        *(
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(float(f.price)).alias("price_factor"),
                F.lit(float(f.performance)).alias("performance_factor"),
                F.lit(float(f.consolidation)).alias("consolidation_factor"),
            )
            for name, f in scenarios.items()
        )
    )
    names = ("price", "performance", "consolidation")
    scaled = (
        savings_components(t, price_limit=price_limit)
        .select("category", *names, F.inline(table))
        .select("scenario", "category", *((F.col(n) * F.col(f"{n}_factor")).alias(n) for n in names))
    )
    keys = ("scenario", "category") if by_category else ("scenario",)
    grouped = scaled.rollup(*keys) if by_category else scaled.groupBy(*keys)
    summed = grouped.agg(*(F.sum(n).alias(n) for n in names), F.grouping_id().alias("level") if by_category else F.lit(1).alias("level"))
    if by_category:
        # The level above the scenarios would mix them.
        summed = summed.where("level < 3")
    total = F.col("price") + F.col("performance") + F.col("consolidation")
    spend = marts.total_spend(t).scalar()
    return summed.select(
        *keys,
        half_up(F.col("price"), 2).alias("price_standardization_savings_ngn"),
        half_up(F.col("performance"), 2).alias("performance_improvement_savings_ngn"),
        half_up(F.col("consolidation"), 2).alias("consolidation_savings_ngn"),
        half_up(total, 2).alias("total_savings_ngn"),
        F.coalesce(half_up(percent(total, spend), 4), F.lit(0.0)).alias("savings_pct_of_spend"),
    ).orderBy("total_savings_ngn", *keys)
