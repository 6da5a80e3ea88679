"""How to split each category between suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.functions.numeric import exact_sum, half_up, lookup, percent
from spendgrain.model import RISK_RANK_OTHER, RISK_RANKS, RISK_SCORE_OTHER, RISK_SCORES
from spendgrain.operators.ranking import first_per_group, join_group_values
from spendgrain.params import PRESETS, AllocationPolicy, SourcingRules
from spendgrain.plans import marts
from spendgrain.tables import Tables

# Fixed value: share of the cheaper supplier when two are used.
PRIMARY_SHARE = 0.65


def _scaled(value: Column, low: Column, high: Column, *, higher_is_better: bool) -> Column:
    """Position between the bounds; 1 when they coincide or are unknown."""
    position = (value - low) / (high - low)
    return F.when(low.isNull() | (low == high), 1.0).otherwise(position if higher_is_better else 1 - position)


def scored_suppliers(t: Tables, policy: AllocationPolicy = AllocationPolicy()) -> DataFrame:
    """Scores of every supplier within its category.

    The bounds are aggregated per category and joined back. A category with
    very many suppliers is thus spread over tasks, unlike in a window.
    """
    metrics = marts.supplier_category(t).drop("quality_incident_count", "total_orders")
    measures = {"cost": "avg_unit_cost_ngn", "delivery": "on_time_delivery_pct", "quality": "total_quality_cost_ngn"}
    bounds = metrics.groupBy("category").agg(
        *(F.min(column).alias(f"{name}_low") for name, column in measures.items()),
        *(F.max(column).alias(f"{name}_high") for name, column in measures.items()),
    )
    scores = {
        f"{name}_score": _scaled(
            F.col(column), F.col(f"{name}_low"), F.col(f"{name}_high"), higher_is_better=name == "delivery"
        )
        for name, column in measures.items()
    }
    scored = join_group_values(metrics, bounds, ["category"], "supplier_id").select(
        *metrics.columns,
        *(score.alias(name) for name, score in scores.items()),
        lookup(F.col("risk_level"), RISK_SCORES, RISK_SCORE_OTHER).alias("risk_score"),
    )
    return scored.withColumn(
        "composite_score",
        policy.unit_cost * F.col("cost_score")
        + policy.delivery * F.col("delivery_score")
        + policy.quality * F.col("quality_score")
        + policy.risk * F.col("risk_score"),
    )


def _allocation(t: Tables, policy: AllocationPolicy) -> DataFrame:
    """Chosen suppliers with unrounded shares and projections.

    Suppliers whose score is unknown, having no deliveries, are not ranked.
    """
    chosen = first_per_group(
        scored_suppliers(t, policy).where("composite_score IS NOT NULL"),
        ["category"],
        policy.max_suppliers,
        F.col("composite_score").desc(),
        "supplier_id",
        "supplier_name",
    )
    category = Window.partitionBy("category")
    score_sum, members = F.sum("composite_score").over(category), F.count("*").over(category)
    share = F.when(score_sum > 0, F.col("composite_score") / score_sum).otherwise(1.0 / members)
    raised = chosen.withColumn("raised", F.greatest(share, F.lit(policy.min_share)))
    shared = raised.withColumn("share", F.col("raised") / F.sum("raised").over(category))
    return (
        shared.join(marts.category_history(t), "category")
        .withColumn("projected_quantity", F.col("share") * F.col("category_quantity"))
        .withColumn("projected_spend", F.col("projected_quantity") * F.col("avg_unit_cost_ngn"))
    )


def supplier_optimization(t: Tables, policy: AllocationPolicy = AllocationPolicy()) -> DataFrame:
    """Recommended suppliers per category with their scores, shares and projected spend."""
    return (
        _allocation(t, policy)
        .select(
            "category",
            "supplier_id",
            "supplier_name",
            "total_quantity",
            "total_spend_ngn",
            "avg_unit_cost_ngn",
            "on_time_delivery_pct",
            F.col("total_quality_cost_ngn").alias("quality_cost_ngn"),
            "risk_level",
            *(half_up(F.col(c), 6).alias(c) for c in ("cost_score", "delivery_score", "quality_score")),
            "risk_score",
            half_up(F.col("composite_score"), 6).alias("composite_score"),
            half_up(F.col("share"), 6).alias("recommended_share"),
            half_up(F.col("projected_quantity"), 2).alias("projected_quantity"),
            half_up(F.col("projected_spend"), 0).alias("projected_spend_ngn"),
            F.col("category_spend_ngn").alias("historical_category_spend_ngn"),
            F.col("category_avg_unit_cost").alias("historical_category_avg_unit_cost"),
        )
        .orderBy("category", F.col("composite_score").desc(), "supplier_id")
    )


def optimization_savings(t: Tables, policy: AllocationPolicy = AllocationPolicy()) -> DataFrame:
    """Spend before and after the recommended split; categories without one keep their spend."""
    projected = _allocation(t, policy).groupBy("category").agg(F.sum("projected_spend").alias("projected"))
    compared = (
        marts.category_history(t)
        .join(projected, "category", "left")
        .withColumn("optimized", F.coalesce("projected", "category_spend_ngn"))
    )
    totals = compared.agg(
        exact_sum("category_spend_ngn").alias("before"), F.coalesce(F.sum("optimized"), F.lit(0.0)).alias("after")
    )
    saved = F.greatest(F.lit(0.0), F.col("before") - F.col("after"))
    return totals.select(
        half_up(F.col("before"), 2).alias("historical_spend_ngn"),
        half_up(F.col("after"), 0).alias("optimized_spend_ngn"),
        half_up(saved, 0).alias("optimization_savings_ngn"),
        F.coalesce(half_up(percent(saved, F.col("before")), 4), F.lit(0.0)).alias("optimization_savings_pct"),
    )


def _sourcing(t: Tables, rules: SourcingRules) -> DataFrame:
    """One or two suppliers per category with unrounded shares and projections.

    Rows are ranked by tier and then by unit cost: inside the price band,
    otherwise eligible, otherwise not eligible. The first row is then the
    right source in every case, and a second row of the best tier tells that
    two suppliers qualify.
    """
    rank = lookup(F.col("risk_level"), RISK_RANKS, RISK_RANK_OTHER)
    cost = F.col("avg_unit_cost_ngn")
    eligible = (
        (F.col("on_time_delivery_pct") >= rules.min_on_time_pct)
        & (F.col("quality_incident_count") <= rules.max_incidents)
        & (rank <= RISK_RANKS.get(rules.max_risk, RISK_RANK_OTHER))
    )
    metrics = marts.supplier_category(t).withColumns(
        {"risk_numeric": rank, "eligible": F.coalesce(eligible, F.lit(False))}
    )
    low, high = F.min("avg_unit_cost_ngn"), F.max("avg_unit_cost_ngn")
    spread = F.when(high > low, high - low).otherwise(1.0)
    bands = (
        metrics.where("eligible")
        .groupBy("category")
        .agg((high - (1.0 - rules.price_percentile) * spread).alias("price_limit"))
    )
    tier = F.when(F.col("eligible") & (cost <= F.col("price_limit")), 0).when(F.col("eligible"), 1).otherwise(2)
    tiered = join_group_values(metrics, bands, ["category"], "supplier_id").withColumn("tier", tier)
    # A supplier may trade under several names; its best row stands for it.
    best_rows = first_per_group(tiered, ["category", "supplier_id"], 1, "tier", cost, "supplier_name")
    ranked = first_per_group(best_rows, ["category"], 2, "tier", cost, "supplier_id")

    qualified = F.count_if(F.col("tier") == 0).over(Window.partitionBy("category"))
    dual = (F.col("category_spend_ngn") > rules.dual_source_spend) & (F.col("qualified") > 1)
    primary = min(PRIMARY_SHARE, rules.max_single_share)
    share = (
        F.when(~F.col("dual"), 1.0).when(F.col("position") == 1, primary).otherwise(1.0 - primary)
    )
    if rules.strict_cap:
        share = F.least(share, F.lit(float(rules.max_single_share)))
    return (
        ranked.withColumn("qualified", qualified)
        .join(marts.category_history(t), "category")
        .withColumn("dual", dual)
        .where("position = 1 OR dual")
        .withColumn("share", share)
        .withColumn("projected_quantity", F.col("share") * F.col("category_quantity"))
        .withColumn("projected_spend", F.col("projected_quantity") * cost)
    )


def constrained_sourcing(t: Tables, rules: SourcingRules = PRESETS["standard"]) -> DataFrame:
    """Cheapest supplier within the rules per category, or two for large categories."""
    return (
        _sourcing(t, rules)
        .select(
            "category",
            "supplier_id",
            "supplier_name",
            "total_quantity",
            "total_spend_ngn",
            "avg_unit_cost_ngn",
            "on_time_delivery_pct",
            "quality_incident_count",
            "total_quality_cost_ngn",
            "total_orders",
            "risk_level",
            "risk_numeric",
            half_up(F.col("share"), 6).alias("constrained_share"),
            half_up(F.col("projected_quantity"), 2).alias("projected_quantity"),
            half_up(F.col("projected_spend"), 0).alias("projected_spend_ngn"),
            F.col("category_spend_ngn").alias("historical_category_spend_ngn"),
            F.col("dual").cast("int").alias("dual_sourced"),
        )
        .orderBy("category", F.col("constrained_share").desc(), "supplier_id")
    )


def constrained_savings(t: Tables, rules: SourcingRules = PRESETS["standard"]) -> DataFrame:
    """Spend before and after the rule-based split.

    ``dual_sourced_categories`` adds up the flag of the recommendation rows,
    so a category with two suppliers counts twice. Shares cut off by a strict
    cap keep their historical cost.
    """
    per_category = (
        _sourcing(t, rules)
        .groupBy("category", "category_spend_ngn")
        .agg(
            F.sum("projected_spend").alias("projected"),
            F.sum("share").alias("allocated"),
            F.sum(F.col("dual").cast("int")).alias("dual"),
        )
    )
    after = F.col("projected")
    if rules.strict_cap:
        after = after + (1.0 - F.col("allocated")) * F.col("category_spend_ngn")
    totals = per_category.withColumn("after", after).agg(
        exact_sum("category_spend_ngn").alias("before"),
        F.coalesce(F.sum("after"), F.lit(0.0)).alias("after"),
        F.coalesce(F.sum("dual"), F.lit(0)).alias("dual"),
    )
    saved = F.greatest(F.lit(0.0), F.col("before") - F.col("after"))
    return totals.select(
        half_up(F.col("after"), 0).alias("constrained_spend_ngn"),
        half_up(saved, 0).alias("constrained_savings_ngn"),
        F.coalesce(half_up(percent(saved, F.col("before")), 4), F.lit(0.0)).alias("constrained_savings_pct"),
        F.col("dual").alias("dual_sourced_categories"),
    )
