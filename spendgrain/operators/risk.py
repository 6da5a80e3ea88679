"""Currency exposure and buying outside the approved suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_label
from spendgrain.functions.numeric import half_up, money, percent, ratio
from spendgrain.operators.ranking import first_per_group, largest_first
from spendgrain.plans import marts
from spendgrain.tables import Tables

# Fixed value: suppliers outside the approved low-risk ones.
IS_MAVERICK = "NOT is_approved OR risk_level = 'High'"


def _usd_lines(t: Tables, *columns: str) -> DataFrame:
    """Dollar lines with the exchange rate each of them implies."""
    lines = t.orders("currency", "total_amount_ngn", "total_amount_usd", *columns)
    return lines.where("currency = 'USD' AND total_amount_usd > 0").withColumn(
        "rate", ratio(F.col("total_amount_ngn"), F.col("total_amount_usd"))
    )


def _average_rate() -> Column:
    """Mean of the rates to twelve digits, summed exactly, so that it does not depend on the row order."""
    return ratio(F.sum(F.col("rate").cast("decimal(28,12)")), F.count("rate"))


def _volatility(lowest: Column, highest: Column) -> Column:
    return (highest - lowest) / F.nullif(lowest, F.lit(0.0)) * 100


def fx_monthly(t: Tables) -> DataFrame:
    lowest, highest = F.min("rate"), F.max("rate")
    return (
        _usd_lines(t, "po_date")
        .groupBy(month_label(F.col("po_date")).alias("month"))
        .agg(
            F.count("*").alias("usd_orders"),
            money(F.sum("total_amount_usd"), 0).alias("total_usd"),
            half_up(_average_rate(), 2).alias("avg_fx_rate"),
            half_up(lowest, 2).alias("min_fx_rate"),
            half_up(highest, 2).alias("max_fx_rate"),
            half_up(_volatility(lowest, highest), 2).alias("fx_volatility_pct"),
        )
        .orderBy("month")
    )


def fx_exposure(t: Tables, *, round_first: bool = True) -> DataFrame:
    """Dollar spend and the spread of implied rates.

    ``round_first`` takes the spread between rates rounded to two digits;
    otherwise it uses the exact rates and is 0 unless the lowest is positive.
    """
    totals = _usd_lines(t).agg(
        F.sum("total_amount_usd").alias("usd"),
        _average_rate().alias("average"),
        F.min("rate").alias("lowest"),
        F.max("rate").alias("highest"),
    )
    lowest, highest = F.col("lowest"), F.col("highest")
    low, high = half_up(lowest, 2), half_up(highest, 2)
    if round_first:
        usd, volatility = money(F.col("usd"), 0), _volatility(low, high)
    else:
        usd = F.coalesce(money(F.col("usd"), 2), F.lit(0.0))
        volatility = F.when(lowest > 0, _volatility(lowest, highest)).otherwise(0.0)
    return totals.select(
        usd.alias("total_usd_spend"),
        half_up(F.col("average"), 2).alias("avg_fx_rate"),
        low.alias("min_fx_rate"),
        high.alias("max_fx_rate"),
        half_up(volatility, 6).alias("fx_volatility_pct"),
    )


MAVERICK_KEYS = ["supplier_name", "risk_level", "is_approved"]


def maverick_buyers(t: Tables) -> DataFrame:
    """Orders and spend of each buyer with each unapproved or high-risk supplier: the complete form, a row per pair.

    Lines are reduced to supplier and buyer before the supplier table is joined.
    """
    per_buyer = (
        t.orders("supplier_id", "supplier_name", "buyer", "total_amount_ngn")
        .groupBy("supplier_id", "supplier_name", "buyer")
        .agg(F.count("*").alias("orders"), F.sum("total_amount_ngn").alias("spend"))
    )
    flagged = t.suppliers("supplier_id", "risk_level", "is_approved").where(IS_MAVERICK)
    pairs = per_buyer.join(flagged, "supplier_id").groupBy(*MAVERICK_KEYS, "buyer")
    return pairs.agg(F.sum("orders").alias("order_count"), F.sum("spend").alias("spend"))


def maverick_suppliers(t: Tables) -> DataFrame:
    """Spend with unapproved or high-risk suppliers, and all who bought there as one text.

    The text grows with the number of buyers; ``maverick_top_buyers`` has a
    bounded one, ``maverick_buyers`` a row for each.
    """
    result = (
        maverick_buyers(t)
        .groupBy(*MAVERICK_KEYS)
        .agg(
            F.sum("order_count").alias("order_count"),
            money(F.sum("spend"), 0).alias("total_spend"),
            F.array_join(F.array_sort(F.collect_set("buyer")), ",").alias("buyers"),
        )
    )
    return largest_first(result, "total_spend", *MAVERICK_KEYS)


def maverick_top_buyers(t: Tables, limit: int = 3) -> DataFrame:
    """Spend with unapproved or high-risk suppliers, the buyers who spent most there, and what the others spent.

    Every task keeps ``limit`` buyers of a supplier before they are moved, so
    neither a task nor a row grows with the number of buyers. Ties go to the
    smaller name; lines without a buyer count for the supplier, not for a buyer.
    """
    pairs = maverick_buyers(t)
    totals = pairs.groupBy(*MAVERICK_KEYS).agg(
        F.sum("order_count").alias("order_count"), F.sum("spend").alias("spend"), F.count("buyer").alias("buyers"),
        F.sum(F.when(F.col("buyer").isNotNull(), F.col("spend"))).alias("bought"),
    )
    first = first_per_group(pairs.where("buyer IS NOT NULL"), MAVERICK_KEYS, limit, F.col("spend").desc_nulls_last(), "buyer")
    largest = first.groupBy(*MAVERICK_KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "buyer"))), lambda x: x["buyer"]), ",").alias("top_buyers"),
        F.count("*").alias("named"),
        F.sum("spend").alias("top_spend"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MAVERICK_KEYS]
    joined = totals.join(largest.withColumnsRenamed({c: f"_{c}" for c in MAVERICK_KEYS}), same, "left")
    result = joined.select(
        *MAVERICK_KEYS,
        "order_count",
        money(F.col("spend"), 0).alias("total_spend"),
        F.coalesce("top_buyers", F.lit("")).alias("top_buyers"),
        (F.col("buyers") - F.coalesce("named", F.lit(0))).alias("other_buyers"),
        money(F.coalesce(F.col("bought") - F.col("top_spend"), F.lit(0)), 0).alias("other_spend"),
    )
    return largest_first(result, "total_spend", *MAVERICK_KEYS)


def _maverick_spend(t: Tables) -> DataFrame:
    """Spend of flagged suppliers, one row each."""
    per_supplier = (
        t.orders("supplier_id", "total_amount_ngn")
        .groupBy("supplier_id")
        .agg(F.sum("total_amount_ngn").alias("spend"))
    )
    flagged = t.suppliers("supplier_id", "risk_level", "is_approved").where(IS_MAVERICK)
    return per_supplier.join(flagged, "supplier_id")


def maverick_total(t: Tables) -> DataFrame:
    """Maverick spend and its share of all spend."""
    total = marts.total_spend(t).scalar()
    spend = F.coalesce(F.sum("spend"), F.lit(0))
    return (
        _maverick_spend(t)
        .agg(spend.alias("spend"))
        .select(
            money(F.col("spend"), 2).alias("maverick_spend_ngn"),
            F.coalesce(half_up(percent(F.col("spend"), total), 4), F.lit(0.0)).alias("maverick_pct_of_spend"),
        )
    )


def maverick_by_risk(t: Tables) -> DataFrame:
    return (
        _maverick_spend(t)
        .groupBy("risk_level")
        .agg(money(F.sum("spend"), 2).alias("total_amount_ngn"))
        .orderBy("total_amount_ngn", "risk_level")
    )
