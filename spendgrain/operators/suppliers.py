"""How suppliers perform: grades, deliveries, payments and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.numeric import half_up, money, percent, ratio
from spendgrain.operators.ranking import largest_first, top_n
from spendgrain.plans import marts
from spendgrain.tables import Tables


def late_lines() -> Column:
    return F.count_if(F.col("actual_delivery_date") > F.col("expected_delivery_date"))


def scorecard_grade(on_time: Column, incidents: Column) -> Column:
    """Four-step grade of the scorecard."""
    return (
        F.when((on_time >= 90) & (incidents == 0), "A - Excellent")
        .when((on_time >= 80) & (incidents <= 2), "B - Good")
        .when((on_time >= 70) | (incidents <= 5), "C - Average")
        .otherwise("D - Poor")
    )


def letter_grade(on_time: Column, incidents: Column) -> Column:
    """Five-step grade; a supplier without deliveries counts as never on time."""
    rate, count = F.coalesce(on_time, F.lit(0.0)), F.coalesce(incidents, F.lit(0))
    return (
        F.when((rate >= 95) & (count <= 1), "A")
        .when((rate >= 90) & (count <= 2), "B")
        .when((rate >= 80) & (count <= 4), "C")
        .when((rate >= 70) & (count <= 6), "D")
        .otherwise("E")
    )


def supplier_scorecard(t: Tables, *, min_orders: int = 5) -> DataFrame:
    result = (
        marts.supplier_performance(t)
        .where(F.col("total_orders") > min_orders)
        .select(
            "supplier_name",
            "category",
            "country",
            "total_orders",
            half_up(F.col("total_spend_ngn"), 0).alias("total_spend"),
            F.col("on_time_delivery_pct").alias("otd_pct"),
            "quality_incidents",
            half_up(F.col("total_quality_cost"), 0).alias("quality_cost"),
            scorecard_grade(F.col("on_time_delivery_pct"), F.col("quality_incidents")).alias("performance_grade"),
        )
    )
    return largest_first(result, "total_spend", "supplier_name", "category", "country")


def graded_suppliers(t: Tables) -> DataFrame:
    """Suppliers with at least one order and their letter grade."""
    return (
        marts.supplier_performance(t)
        .where("total_orders > 0")
        .select(
            "supplier_id",
            "supplier_name",
            "category",
            "country",
            "total_orders",
            "total_spend_ngn",
            "on_time_delivery_pct",
            "quality_incidents",
            "total_quality_cost",
            letter_grade(F.col("on_time_delivery_pct"), F.col("quality_incidents")).alias("performance_grade"),
        )
    )


def supplier_grade(t: Tables) -> DataFrame:
    return largest_first(graded_suppliers(t), "total_spend_ngn", "supplier_id")


def grade_distribution(t: Tables) -> DataFrame:
    return (
        graded_suppliers(t)
        .groupBy("performance_grade", "category")
        .agg(F.count("*").alias("supplier_count"))
        .orderBy("performance_grade", "category")
    )


def top_suppliers(t: Tables, limit: int = 15) -> DataFrame:
    return top_n(graded_suppliers(t), limit, "total_spend_ngn", "supplier_id")


def late_delivery(t: Tables, *, min_deliveries: int = 5, limit: int | None = 15) -> DataFrame:
    """Suppliers by share of late deliveries; early lines count as negative delay."""
    delay = F.datediff("actual_delivery_date", "expected_delivery_date")
    result = (
        t.orders("supplier_name", "category", "actual_delivery_date", "expected_delivery_date")
        .where("actual_delivery_date IS NOT NULL")
        .groupBy("supplier_name", "category")
        .agg(
            F.count("*").alias("total_deliveries"),
            late_lines().alias("late_deliveries"),
            half_up(percent(late_lines(), F.count("*")), 2).alias("late_delivery_pct"),
            half_up(ratio(F.sum(delay), F.count(delay)), 1).alias("avg_delay_days"),
        )
        .where(F.col("total_deliveries") > min_deliveries)
    )
    return top_n(result, limit, "late_delivery_pct", "supplier_name", "category")


def late_delivery_rate(t: Tables) -> DataFrame:
    """Late lines overall, as a count and in percent of all delivered lines."""
    return t.orders("actual_delivery_date", "expected_delivery_date").agg(
        late_lines().alias("late_deliveries"),
        half_up(percent(late_lines(), marts.delivered_lines()), 2).alias("late_delivery_pct"),
    )


def payment_terms(t: Tables) -> DataFrame:
    """Orders, value and payment state per payment terms.

    Lines are summed per supplier first; the terms are joined to the sums.
    """
    overdue = F.col("payment_status") == "Overdue"
    per_supplier = (
        t.orders("supplier_id", "payment_status", "total_amount_ngn")
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("total_amount_ngn").alias("value"),
            F.count_if(F.col("payment_status") == "Paid").alias("paid"),
            F.count_if(overdue).alias("overdue"),
            F.sum(F.when(overdue, F.col("total_amount_ngn")).otherwise(0)).alias("overdue_value"),
        )
    )
    result = (
        per_supplier.join(t.suppliers("supplier_id", "payment_terms"), "supplier_id")
        .groupBy("payment_terms")
        .agg(
            F.sum("orders").alias("order_count"),
            money(F.sum("value"), 0).alias("total_value"),
            F.sum("paid").alias("paid_count"),
            F.sum("overdue").alias("overdue_count"),
            money(F.sum("overdue_value"), 0).alias("overdue_value"),
        )
    )
    return largest_first(result, "total_value", "payment_terms")


def quality_cost(t: Tables) -> DataFrame:
    """Incidents, high-severity incidents and their cost against the supplier's spend."""
    incidents = (
        t.incidents("supplier_id", "incident_id", "severity", "cost_impact_ngn")
        .groupBy("supplier_id")
        .agg(
            F.count("incident_id").alias("incidents"),
            F.count_if(F.col("severity") == "High").alias("high"),
            F.sum("cost_impact_ngn").alias("cost"),
        )
    )
    spend = (
        t.orders("supplier_id", "total_amount_ngn")
        .groupBy("supplier_id")
        .agg(F.sum("total_amount_ngn").alias("spend"))
    )
    result = (
        incidents.join(t.suppliers("supplier_id", "supplier_name", "category", "quality_rating"), "supplier_id")
        .join(spend, "supplier_id", "left")
        .groupBy("supplier_name", "category", "quality_rating", "spend")
        .agg(
            F.sum("incidents").alias("incident_count"),
            F.sum("high").alias("high_severity_count"),
            F.sum("cost").alias("cost"),
        )
        .select(
            "supplier_name",
            "category",
            "quality_rating",
            "incident_count",
            "high_severity_count",
            money(F.col("cost"), 0).alias("total_quality_cost"),
            half_up(percent(F.col("cost"), F.col("spend")), 2).alias("quality_cost_pct_of_spend"),
        )
    )
    return largest_first(result, "total_quality_cost", "supplier_name", "category", "quality_rating")
