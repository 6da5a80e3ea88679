"""Raw tables with foreign headers and dirty cells, derived from the given star tables.

They exercise the normalization at whatever size the given tables have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.sources.star import StarTables


def _text(value: Column) -> Column:
    return value.cast("string")


def _iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def _case(value: Column, modulus: int, *results: str | None) -> Column:
    picked = F.lit(None).cast("string")
    for remainder, result in enumerate(results):
        picked = F.when(value % modulus == remainder, F.lit(result)).otherwise(picked)
    return picked


def _suppliers(star: StarTables) -> DataFrame:
    key = F.col("supplier_id")
    base = star.suppliers().select(
        key,
        _text(key).alias("Vendor ID"),
        F.col("supplier_name").alias("Vendor Name"),
        F.col("category").alias("Supplier-Category"),
        F.col("country").alias("country_name"),
        F.when(key % 5 != 0, F.lower("currency")).alias("Invoice Currency"),
        F.when(key % 7 == 0, "unrated").otherwise(_text(F.col("quality_rating"))).alias("Rating"),
        _case(key, 6, "Yes", "no", " APPROVED ", "Rejected", "maybe").alias("Approved"),
        _case(key, 4, "HIGH", "low", " ").alias("Risk"),
    )
    renamed = base.where(key % 10 == 0).withColumn("Vendor Name", F.concat("Vendor Name", F.lit(" (old)")))
    nameless = base.where(key % 15 == 0).withColumn("Vendor Name", F.lit(None).cast("string"))
    copies = base.where(key % 7 == 0)
    return base.unionByName(renamed).unionByName(nameless).unionByName(copies).drop("supplier_id")


def _materials(star: StarTables) -> DataFrame:
    key = F.col("material_id")
    base = star.materials().select(
        key,
        _text(key).alias("Item Code"),
        F.col("material_name").alias("item_name"),
        F.col("category").alias("material category"),
        F.when(key % 9 == 0, "abc").otherwise(_text(F.col("standard_price_ngn"))).alias("std_price"),
        F.when(key % 8 == 0, F.lit(None))
        .when(key % 11 == 0, "14.7")
        .otherwise(_text(F.col("lead_time_days")))
        .alias("Lead-Days"),
    )
    nameless = base.where(key % 12 == 0).withColumn("item_name", F.lit(None).cast("string"))
    return base.unionByName(nameless).drop("material_id")


def _orders(star: StarTables) -> DataFrame:
    number, line = F.col("l_orderkey"), F.col("l_linenumber")
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).cast("decimal(18,2)")
    lines = (
        star.table("lineitem")
        .join(star.table("orders"), number == F.col("o_orderkey"), "left")
        .join(star.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    base = lines.select(
        number,
        _text(number).alias("Purchase Order Number"),
        F.when(number % 50 == 0, "2024-13-40").otherwise(_iso(F.col("o_orderdate"))).alias("Order Date"),
        F.when(number % 97 == 0, "999999").otherwise(_text(F.col("l_suppkey"))).alias("vendor_id"),
        F.when(number % 89 == 0, "X").otherwise(_text(F.col("l_partkey"))).alias("SKU"),
        F.when(number % 3 == 2, F.concat("p_type", F.lit(" custom"))).when(number % 3 == 1, "").alias("spend_category"),
        F.when(number % 41 == 0, "abc").otherwise(_text(F.col("l_quantity"))).alias("Qty"),
        F.when(number % 37 != 0, _text(price)).alias("Unit Price"),
        F.when(line % 2 == 0, _text(F.col("l_extendedprice"))).alias("Line Amount"),
        F.when(number % 5 != 0, "usd").alias("po_currency"),
        F.when(F.col("l_linestatus") == "F", _iso(F.col("l_shipdate"))).alias("Receipt Date"),
        F.when(number % 13 != 0, F.col("o_orderstatus")).alias("invoice_status"),
        F.when(number % 17 == 0, _text(F.col("l_extendedprice"))).when(number % 17 == 1, "n/a").alias("Amount USD"),
        F.when(number % 19 == 0, "Own vendor").alias("vendor_name"),
        F.when(number % 23 == 0, "Own item").alias("item_name"),
        F.when(number % 31 == 0, "1999-12-31").when(number % 31 == 1, "soon").alias("Promised Delivery Date"),
        F.when(number % 43 == 0, "Partial").alias("Receipt Status"),
    )
    # Some lines come twice; the joins that all lines need are made once.
    times = F.when(number % 101 == 0, 2).otherwise(1)
    return base.withColumn("time", F.explode(F.sequence(F.lit(1), times))).drop("l_orderkey", "time")


def _incidents(star: StarTables) -> DataFrame:
    number = F.col("po_number")
    return star.incidents().select(
        F.col("incident_id").alias("Issue ID"),
        F.when(number % 29 == 0, "none").otherwise(_text(number)).alias("order_id"),
        F.when(number % 4 != 0, _text(F.col("supplier_id"))).alias("vendor_code"),
        F.upper("severity").alias("Priority"),
        F.when(number % 6 == 0, "unknown").otherwise(_text(F.col("cost_impact_ngn"))).alias("impact amount"),
    )


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    star = StarTables(spark, folder)
    return {
        "suppliers": _suppliers(star),
        "materials": _materials(star),
        "purchase_orders": _orders(star),
        "quality_incidents": _incidents(star),
    }
