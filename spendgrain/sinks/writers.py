"""Writers and named views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_label
from spendgrain.plans import marts
from spendgrain.tables import MONTH_COLUMN, Tables

NO_MONTH = "none"


def _by_month(orders: DataFrame) -> DataFrame:
    """Order lines with their month, brought together by it.

    The rebalance hint splits months that are too large for one file and
    merges small ones, all from sizes measured at run time.
    """
    monthly = orders.withColumn(MONTH_COLUMN, F.coalesce(month_label(F.col("po_date")), F.lit(NO_MONTH)))
    return monthly.hint("rebalance", MONTH_COLUMN)


def write_tables(t: Tables, folder: str) -> None:
    """Replace the canonical tables under a folder, as Parquet, with orders partitioned by month."""
    for name, frame in t.frames().items():
        path = f"{folder}/{name}.parquet"
        if name == "purchase_orders":
            _by_month(frame).write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(path)
        else:
            frame.write.mode("overwrite").parquet(path)


def replace_months(t: Tables, folder: str, months: Sequence[str]) -> None:
    """Replace the order lines of some months (``yyyy-MM``, or NO_MONTH) below a folder written by ``write_tables``.

    Other months are neither read nor written. A month without lines is
    removed. Running it again gives the same files' rows.
    """
    kept = months_of(t, sorted(set(months)))
    path = f"{folder}/purchase_orders.parquet"
    writer = _by_month(kept.orders().drop(MONTH_COLUMN)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_COLUMN).parquet(path)
    drop_months(t.spark, path, set(months) - present_months(kept))


def months_of(t: Tables, months: Sequence[str]) -> Tables:
    """The tables with the lines of some months, pruned where lines are stored by month."""
    if MONTH_COLUMN in t.order_columns():
        return t.where_orders(F.col(MONTH_COLUMN).isin(*months), MONTH_COLUMN)
    return t.where_orders(F.coalesce(month_label(F.col("po_date")), F.lit(NO_MONTH)).isin(*months), "po_date")


def present_months(t: Tables) -> set[str]:
    """The months that have lines."""
    month = F.coalesce(month_label(F.col("po_date")), F.lit(NO_MONTH)).alias(MONTH_COLUMN)
    return {row[0] for row in t.orders("po_date").select(month).distinct().collect()}


def drop_months(spark: SparkSession, path: str, months: Iterable[str]) -> None:
    """Remove the partitions of some months, where they exist."""
    for month in months:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH_COLUMN}={month}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """Canonical tables written by ``write_tables``."""
    names = ("suppliers", "materials", "purchase_orders", "quality_incidents")
    return Tables(*(spark.read.parquet(f"{folder}/{name}.parquet") for name in names))


def save_tables(t: Tables, database: str) -> None:
    """Replace the canonical tables of a catalog database, with orders partitioned by month."""
    for name, frame in t.frames().items():
        table = f"{database}.{name}"
        if name == "purchase_orders":
            _by_month(frame).write.mode("overwrite").partitionBy(MONTH_COLUMN).saveAsTable(table)
        else:
            frame.write.mode("overwrite").saveAsTable(table)


def write_marts(frames: Mapping[str, DataFrame], folder: str, fmt: str = "csv", **options) -> None:
    """One directory per mart, as CSV with a header, Parquet or JSON lines, with options of Spark's writer."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite").options(**options)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder}/{name}")


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A long-form report as JSON lines."""
    report.write.mode("overwrite").json(f"{folder}/{name}")


def register_views(t: Tables) -> None:
    """Name the tables and the analytical views for SQL queries in this session."""
    for name, frame in t.frames().items():
        frame.createOrReplaceTempView(name)
    # View names.
    marts.supplier_performance(t).createOrReplaceTempView("vw_supplier_performance")
    marts.category_month(t).createOrReplaceTempView("vw_category_spend")
    marts.savings_opportunities(t).createOrReplaceTempView("vw_savings_opportunities")
