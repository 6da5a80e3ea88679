"""Aggregates of order lines per month that can be merged: over months, categories, suppliers and materials.

A row holds what the lines of one month, category, supplier and material add
up to: counts, exact sums, extremes, and a sketch of their order numbers. Rows
are kept in one partition per month, so a late month is computed and replaced
alone, and a range of days reads whole months from here and lines only of the
months at its two ends.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrain.functions.dates import month_label
from spendgrain.plans import marts
from spendgrain.session import shared_folder
from spendgrain.sinks.writers import NO_MONTH, drop_months, months_of, present_months
from spendgrain.tables import MONTH_COLUMN, Tables

KEYS = ("category", "supplier_id", "supplier_name", "material_name")
LINE_COLUMNS = (
    *KEYS, "po_date", "po_number", "quantity", "unit_price_ngn", "total_amount_ngn", "actual_delivery_date", "expected_delivery_date"
)

# The lines of a month are brought together in so many parts, each a file at most.
PARTS = 16

# A distinct count from a sketch of 2^14 registers is off by 0.8 % of itself (one standard deviation).
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def month_partials(t: Tables) -> DataFrame:
    """One row per month, category, supplier and material; lines without a day have a month of their own.

    Few lines agree in all keys, and a line is narrower than sums and a sketch,
    so the lines are shuffled, once, to where their partials are stored from.
    """
    placed = {MONTH_COLUMN: F.coalesce(month_label(F.col("po_date")), F.lit(NO_MONTH)), "part": F.pmod(F.xxhash64(*KEYS), F.lit(PARTS))}
    return (
        t.orders(*LINE_COLUMNS)
        .withColumns(placed)
        .repartition(*placed)
        .groupBy(*placed, *KEYS)
        .agg(
            F.count("*").alias("lines"),
            F.count("total_amount_ngn").alias("priced"),
            F.sum("total_amount_ngn").cast("decimal(28,2)").alias("spend"),
            F.sum("quantity").cast("decimal(28,3)").alias("quantity"),
            F.count("unit_price_ngn").alias("prices"),
            F.sum("unit_price_ngn").cast("decimal(28,2)").alias("price_sum"),
            F.min("unit_price_ngn").alias("price_min"),
            F.max("unit_price_ngn").alias("price_max"),
            marts.on_time_lines().alias("on_time"),
            marts.delivered_lines().alias("delivered"),
            F.hll_sketch_agg("po_number", F.lit(SKETCH_BITS)).alias("orders"),
        )
        .drop("part")
    )


def write_partials(t: Tables, folder: str) -> None:
    """Replace all partials."""
    month_partials(t).write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(folder)


def refresh_partials(t: Tables, folder: str, months: Sequence[str]) -> None:
    """Compute the given months (``yyyy-MM``, or NO_MONTH) again from the lines and replace them; other months stay untouched.

    Lines stored by month are read from these months only. A month that has no
    lines any more is removed. Running it again gives the same partials.
    """
    kept = months_of(t, sorted(set(months)))
    writer = month_partials(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH_COLUMN).parquet(folder)
    drop_months(t.spark, folder, set(months) - present_months(kept))


def split_range(start: dt.date, end: dt.date) -> tuple[tuple[str, str] | None, list[str]]:
    """First and last of the months that lie within the inclusive range as a whole, if any, and the others it touches."""
    edges = []
    if start.day > 1:
        edges.append(f"{start:%Y-%m}")
        start = (start.replace(day=28) + dt.timedelta(4)).replace(day=1)
    if end.day < calendar.monthrange(end.year, end.month)[1]:
        edges.append(f"{end:%Y-%m}")
        end = end.replace(day=1) - dt.timedelta(1)
    return ((f"{start:%Y-%m}", f"{end:%Y-%m}") if start <= end else None), sorted(set(edges))


def partial_view(
    t: Tables,
    folder: str,
    categories: Sequence[str] | DataFrame = (),
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    keep_edges: bool = False,
) -> DataFrame:
    """Partials of the lines that ``summary.filtered_view`` would keep.

    Whole months come from the stored partials, pruned to the range; lines are
    read only of the months the range covers in part. With ``keep_edges`` the
    partials of these are written to the shared folder, so that an answer which
    uses the view several times reads and joins the lines once.
    """

    def wanted(rows: DataFrame) -> DataFrame:
        if isinstance(categories, DataFrame):
            return rows.join(categories, categories.columns, "left_semi")
        return rows.where(F.col("category").isin(*categories) if categories else F.col("category").isNotNull())

    rows = t.spark.read.parquet(folder).withColumn(MONTH_COLUMN, F.col(MONTH_COLUMN).cast("string"))
    if start is not None and end is not None:
        whole, edges = split_range(start, end)
        if start > end:
            edges = []
        rows = rows.where(F.col(MONTH_COLUMN).between(*whole) if whole else F.lit(False))
        if edges:
            lines = months_of(t.where_orders(F.col("po_date").between(F.lit(start), F.lit(end)), "po_date"), edges)
            found = wanted(month_partials(lines))
            if keep_edges:
                at = shared_folder(t.spark, "edges")
                found.write.parquet(at)
                found = t.spark.read.parquet(at)
            return wanted(rows).unionByName(found.select(*rows.columns))
    return wanted(rows)
