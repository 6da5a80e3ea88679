"""Entry points: the flagship query, all registered queries and their reference SQL."""

from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from checks import oracle  # noqa: E402
from checks.raw_tables import raw_tables  # noqa: E402
from spendgrain.functions.text import currency_short  # noqa: E402
from spendgrain.operators import (  # noqa: E402
    distribution,
    quality,
    risk,
    rollup,
    savings,
    sourcing,
    spend,
    suppliers,
    summary,
)
from spendgrain.params import PRESETS, SourcingRules  # noqa: E402
from spendgrain.plans import marts, partials  # noqa: E402
from spendgrain.plans.shared import read_once  # noqa: E402
from spendgrain.session import shared_folder  # noqa: E402
from spendgrain.sinks.writers import (  # noqa: E402
    read_tables,
    register_views,
    write_marts,
    write_report,
    write_tables,
)
from spendgrain.sources.normalize import (  # noqa: E402
    cleaned_tables,
    infer_date_formats,
    normalize,
    unreadable_cells,
)
from spendgrain.sources.readers import QUARANTINE, load_folder, load_landing, quarantined  # noqa: E402
from spendgrain.sources.star import StarTables  # noqa: E402
from spendgrain.tables import Tables  # noqa: E402

try:  # the training-data operators are an optional part, as are the libraries they need
    import corpus_pipeline
    from spendgrain.llm import registry as llm
except ImportError:
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds at which the given tables reach every branch of the rules.
MIXED = SourcingRules(0.8, 5.2e8, 60, 2, "Low", 0.8)
DUAL = SourcingRules(0.8, 1e8, 55, 5, "Medium", 0.8)
STRICT = SourcingRules(0.8, 5.2e8, 60, 2, "Low", 0.8, strict_cap=True)

FILTER_CATEGORIES = ("PROMO", "ECONOMY", "LARGE")
FILTER_RANGE = (dt.date(1996, 1, 1), dt.date(1999, 12, 31))
PARTIAL_RANGE = (dt.date(1996, 1, 15), dt.date(1999, 11, 10))  # covers its first and last month in part


def _star(query: Callable[..., DataFrame], *args, **options) -> Query:
    """A query over the given tables."""
    return lambda spark, folder: query(StarTables(spark, folder), *args, **options)


def _insights(**options) -> Query:
    """The headline metrics of the given tables, whose lines are joined and written once."""
    return lambda spark, folder: summary.insights_summary(read_once(StarTables(spark, folder, whole=True)), **options)


def _normalized(query: Callable[[Tables], DataFrame]) -> Query:
    """A query over the tables normalized from raw ones."""
    return lambda spark, folder: query(normalize(raw_tables(spark, folder))[0])


def _reported(query: Callable[[Tables], DataFrame]) -> Query:
    """A query over the raw tables as they are before rows are merged; incidents are completed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw = raw_tables(spark, folder)
        clean, _ = cleaned_tables(raw)
        whole, _ = normalize(raw)
        return query(Tables(clean.suppliers(), clean.materials(), whole.orders(), whole.incidents()))

    return run


def _filtered(query: Callable[..., DataFrame], *args, **options) -> Query:
    """A query over the lines of some categories and days."""
    view = lambda spark, folder: summary.filtered_view(StarTables(spark, folder), FILTER_CATEGORIES, *FILTER_RANGE)
    return lambda spark, folder: query(view(spark, folder), *args, **options)


def _partials(query: Callable[[DataFrame, Tables], DataFrame], *view) -> Query:
    """A query over stored month partials, of some categories and days if given."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        star, work = StarTables(spark, folder, whole=True), shared_folder(spark, "partials")
        partials.write_partials(star, work)
        return query(partials.partial_view(star, work, *view, keep_edges=True), star)

    return run


def _late_month(spark: SparkSession, folder: str) -> DataFrame:
    """Months of which one got most of its lines late: partials are written without them, then that month alone is computed again."""
    star, work = StarTables(spark, folder, whole=True), shared_folder(spark, "partials")
    late = F.col("po_date").between(F.lit(dt.date(1997, 5, 10)), F.lit(dt.date(1997, 5, 31)))
    partials.write_partials(star.where_orders(~late, "po_date"), work)
    partials.refresh_partials(star, work, ["1997-05"])
    return rollup.monthly_spend(partials.partial_view(star, work))


def _estimated_orders(rows: DataFrame, t: Tables) -> DataFrame:
    """Exact orders and suppliers per category, and whether what the sketches say lies within their error."""
    exact = t.orders("category", "po_number").distinct().groupBy("category").agg(F.count("po_number").alias("total_orders"))
    both = rollup.category_orders(rows).join(exact, "category")
    holds = rollup.estimate_holds(F.col("orders_estimate"), F.col("total_orders"))
    return both.select("category", "total_orders", "unique_suppliers", holds.alias("estimate_holds"))


def _filtered_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly spend of the suppliers in a table of keys."""
    star = StarTables(spark, folder)
    keys = star.suppliers("supplier_id", "risk_level").where("risk_level = 'Medium'").select("supplier_id")
    return spend.monthly_spend_by_category(summary.filtered_view(star, keys, *PARTIAL_RANGE))


def _unmapped(spark: SparkSession, folder: str) -> DataFrame:
    """Unmapped keys: incidents without supplier are judged before they are filled."""
    raw = raw_tables(spark, folder)
    clean, _ = cleaned_tables(raw)
    whole, _ = normalize(raw)
    return quality.unmapped_keys(Tables(clean.suppliers(), clean.materials(), whole.orders(), clean.incidents()))


def _plain(df: DataFrame) -> DataFrame:
    """Money as doubles and dates as text, for comparison between engines."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        shown.append(column.alias(name))
    return df.select(*shown)


def _sql_over_views(t: Tables) -> DataFrame:
    register_views(t)
    return t.spark.sql(
        """
        SELECT category, count(*) AS suppliers,
          cast(sum(cast(total_spend_ngn AS decimal(28,2))) AS double) AS total_spend_ngn,
          (SELECT count(*) FROM vw_savings_opportunities) AS opportunities
        FROM vw_supplier_performance WHERE total_orders > 0 GROUP BY category
        """
    )


# File names an upstream system might use.
LANDING_NAMES = {
    "suppliers": "vendor_master_extract.csv",
    "materials": "item_master.csv",
    "purchase_orders": "PO_LINES.csv",
    "quality_incidents": "non_conformance_log.csv",
}


def _files_to_mart(spark: SparkSession, folder: str) -> DataFrame:
    """Raw tables out to CSV files, back in by their names, normalized, stored by month, aggregated."""
    work = shared_folder(spark, "spendgrain")
    landed = {LANDING_NAMES[name]: frame for name, frame in raw_tables(spark, folder).items()}
    # One task reads a compressed file, so each stays small.
    write_marts(landed, f"{work}/landing", compression="gzip", maxRecordsPerFile=500_000)
    clean, _ = normalize(load_landing(spark, f"{work}/landing"))
    write_tables(clean, f"{work}/tables")
    return marts.category_month(read_tables(spark, f"{work}/tables"))


def _landing_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers from two CSV files with different headers and a Parquet file, one of them without currencies."""
    work = shared_folder(spark, "spendgrain")
    raw = raw_tables(spark, folder)
    key = F.col("Vendor ID").cast("bigint") % 3
    rows = raw["suppliers"].dropDuplicates(["Vendor ID"]).drop("Vendor Name")
    names = StarTables(spark, folder).suppliers("supplier_id", "supplier_name")
    rows = rows.join(names.select(F.col("supplier_id").cast("string").alias("Vendor ID"), F.col("supplier_name").alias("Vendor Name")), "Vendor ID")
    other = {"Vendor ID": "supplier_code", "Vendor Name": "Vendor", "Approved": "is active"}
    write_marts({"vendor_a.csv": rows.where(key == 0)}, f"{work}/landing")
    write_marts({"Vendor B.csv": rows.where(key == 1).drop("Invoice Currency").withColumnsRenamed(other)}, f"{work}/landing")
    write_marts({"supplier_c.parquet": rows.where(key == 2)}, f"{work}/landing", "parquet")
    write_marts({"items.csv": raw["materials"], "po.csv": raw["purchase_orders"].limit(0)}, f"{work}/landing")
    return _plain(normalize(load_landing(spark, f"{work}/landing"))[0].suppliers())


def _ragged_landing(spark: SparkSession, folder: str) -> str:
    """A landing folder whose supplier file has rows with a cell too many or too few."""
    work, raw = shared_folder(spark, "spendgrain"), raw_tables(spark, folder)
    key, names = F.col("Vendor ID").cast("bigint"), raw["suppliers"].columns
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"')) for c in names]
    line = F.concat_ws(",", *cells[:-1], F.when(key % 13 != 0, cells[-1]), F.when(key % 11 == 0, F.lit('"a, b"')))
    # Lines are written as they are, each file under the header.
    plain = {"header": True, "sep": "\u0001", "quote": "\u0002", "escapeQuotes": False}
    raw["suppliers"].select(line.alias(",".join(names))).write.options(**plain).csv(f"{work}/vendors.csv")
    write_marts({"items.csv": raw["materials"], "po.csv": raw["purchase_orders"]}, work)
    return work


def _malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = quarantined(spark, _ragged_landing(spark, folder))
    return found.select("dataset", "cells", "expected", "record", F.col("file").endswith(".csv").alias("has_file"))


def _kept_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    raw = load_landing(spark, _ragged_landing(spark, folder), malformed=QUARANTINE)
    return _plain(normalize(raw)[0].suppliers())


def _other_days(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose days are spelled in three ways, one for each column, read by what their cells show."""
    raw = raw_tables(spark, folder)
    spelled = {"Order Date": "MM/dd/yyyy", "Receipt Date": "dd.MM.yyyy", "Promised Delivery Date": "MMM d, yyyy"}
    orders = raw["purchase_orders"].withColumns(
        {c: F.coalesce(F.date_format(F.try_to_timestamp(F.col(c)), f), F.col(c)) for c, f in spelled.items()}
    )
    raw = raw | {"purchase_orders": orders}
    return _plain(normalize(raw, date_formats=infer_date_formats(raw))[0].orders())


def _folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical files of a folder by their names: CSV and Parquet, without incidents, under rules read from JSON."""
    work, raw = shared_folder(spark, "spendgrain"), raw_tables(spark, folder)
    write_marts({"suppliers.csv": raw["suppliers"], "materials.csv": raw["materials"]}, work)
    write_marts({"purchase_orders.parquet": raw["purchase_orders"]}, work, "parquet")
    return _plain(normalize(load_folder(spark, work))[0].materials())


def _report_as_json(spark: SparkSession, folder: str) -> DataFrame:
    """Insights with their short texts, written as JSON lines and read again."""
    work = shared_folder(spark, "spendgrain")
    found = spend.category_share(StarTables(spark, folder))
    short = currency_short(F.col("total_spend_ngn"), F.lit("NGN")).alias("short")
    write_report(found.select("category", "total_spend_ngn", "pct_of_total", short), work, "category_share")
    return spark.read.schema("category string, total_spend_ngn double, pct_of_total double, short string").json(f"{work}/category_share")


def queries() -> dict[str, Query]:
    own = _own_queries()
    if llm is not None:
        own |= {name: _reachable(q) for name, q in (llm.queries() | {"pipeline": corpus_pipeline.run}).items()}
    return own


def _reachable(query: Query) -> Query:
    """The query, with this repository on the path of the Python workers of a local session."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        return query(spark, folder)

    return run


def _own_queries() -> dict[str, Query]:
    return {
        "executive_summary": _star(spend.executive_summary),
        "category_spend": _star(spend.category_spend),
        "supplier_concentration": _star(spend.supplier_concentration),
        "price_variance": _star(spend.price_variance),
        "price_variance_savings": _star(spend.price_variance, min_spread_pct=None),
        "price_overpayment": _star(spend.price_overpayment),
        "spend_trend": _star(spend.spend_trend),
        "monthly_spend_by_category": _star(spend.monthly_spend_by_category),
        "category_month": _star(marts.category_month),
        "supplier_performance": _star(marts.supplier_performance),
        "supplier_performance_compat": _star(marts.supplier_performance, compat=True),
        "supplier_scorecard": _star(suppliers.supplier_scorecard),
        "supplier_grade": _star(suppliers.supplier_grade),
        "grade_distribution": _star(suppliers.grade_distribution),
        "top_suppliers": _star(suppliers.top_suppliers),
        "late_delivery": _star(suppliers.late_delivery),
        "late_delivery_rate": _star(suppliers.late_delivery_rate),
        "payment_terms": _star(suppliers.payment_terms),
        "quality_cost": _star(suppliers.quality_cost),
        "fx_monthly": _star(risk.fx_monthly),
        "fx_exposure": _star(risk.fx_exposure),
        "fx_exposure_exact": _star(risk.fx_exposure, round_first=False),
        "maverick_suppliers": _star(risk.maverick_suppliers),
        "maverick_buyers": _star(lambda t: risk.maverick_buyers(t).withColumn("spend", F.col("spend").cast("double"))),
        "maverick_top_buyers": _star(risk.maverick_top_buyers),
        "maverick_total": _star(risk.maverick_total),
        "maverick_by_risk": _star(risk.maverick_by_risk),
        "savings_opportunities": _star(marts.savings_opportunities),
        "savings_summary": _star(savings.savings_summary),
        "action_items": _star(savings.action_items),
        "consolidation": _star(savings.consolidation),
        "performance_savings": _star(savings.performance_savings),
        "performance_savings_top10": _star(savings.performance_savings, limit=10),
        "savings_scenarios": _star(savings.savings_scenarios),
        "savings_scenarios_by_category": _star(savings.savings_scenarios, by_category=True),
        "savings_scenarios_top20": _star(savings.savings_scenarios, price_limit=20),
        "savings_scenarios_by_category_top20": _star(savings.savings_scenarios, by_category=True, price_limit=20),
        "price_distribution": _star(distribution.price_distribution),
        "price_distribution_approx": _star(distribution.approximate_price_distribution),
        "savings_bootstrap": _star(distribution.savings_bootstrap),
        "supplier_optimization": _star(sourcing.supplier_optimization),
        "optimization_savings": _star(sourcing.optimization_savings),
        "constrained_sourcing": _star(sourcing.constrained_sourcing),
        "constrained_sourcing_conservative": _star(sourcing.constrained_sourcing, PRESETS["conservative"]),
        "constrained_sourcing_aggressive": _star(sourcing.constrained_sourcing, PRESETS["aggressive"]),
        "constrained_sourcing_mixed": _star(sourcing.constrained_sourcing, MIXED),
        "constrained_sourcing_dual": _star(sourcing.constrained_sourcing, DUAL),
        "constrained_sourcing_strict_cap": _star(sourcing.constrained_sourcing, STRICT),
        "constrained_savings": _star(sourcing.constrained_savings),
        "constrained_savings_dual": _star(sourcing.constrained_savings, DUAL),
        "constrained_savings_strict_cap": _star(sourcing.constrained_savings, STRICT),
        "insights_summary": _insights(),
        "insights_summary_top20": _insights(price_limit=20),
        "insights_display": lambda spark, folder: summary.displayed(_insights()(spark, folder)),
        "filtered_kpis": _star(summary.filtered_kpis, FILTER_CATEGORIES, *FILTER_RANGE),
        "filtered_kpis_top20": _star(summary.filtered_kpis, FILTER_CATEGORIES, *FILTER_RANGE, price_limit=20),
        "filtered_category_spend": _filtered(spend.category_spend),
        "filtered_supplier_performance": _filtered(marts.supplier_performance),
        "filtered_price_variance": _filtered(spend.price_variance, min_spread_pct=None),
        "filtered_monthly_spend": _filtered(spend.monthly_spend_by_category),
        "filtered_supplier_optimization": _star(lambda t: summary.of_categories(sourcing.supplier_optimization(t), FILTER_CATEGORIES)),
        "filtered_constrained_sourcing": _star(lambda t: summary.of_categories(sourcing.constrained_sourcing(t, MIXED), FILTER_CATEGORIES)),
        "filtered_maverick_lines": _star(lambda t: _plain(summary.filtered_maverick_lines(t, FILTER_CATEGORIES, *PARTIAL_RANGE))),
        "filtered_by_table": _filtered_by_table,
        "partials_kpis": _partials(rollup.kpis, FILTER_CATEGORIES, *PARTIAL_RANGE),
        "partials_category_spend": _partials(lambda rows, t: rollup.category_spend(rows), FILTER_CATEGORIES, *PARTIAL_RANGE),
        "partials_price_variance": _partials(lambda rows, t: rollup.price_variance(rows), FILTER_CATEGORIES, *PARTIAL_RANGE),
        "partials_late_month": _late_month,
        "partials_distinct_orders": _partials(_estimated_orders),
        "sql_over_views": _star(_sql_over_views),
        "files_to_mart": _files_to_mart,
        "normalized_suppliers": _normalized(lambda t: _plain(t.suppliers())),
        "normalized_materials": _normalized(lambda t: _plain(t.materials())),
        "normalized_orders": _normalized(lambda t: _plain(t.orders())),
        "normalized_incidents": _normalized(lambda t: _plain(t.incidents())),
        "landing_variants": _landing_variants,
        "dq_row_counts": _reported(quality.row_counts),
        "dq_nulls": _reported(quality.null_cells),
        "dq_duplicates": _reported(quality.duplicate_rows),
        "dq_duplicate_keys": _reported(quality.duplicate_keys),
        "dq_unmapped": _unmapped,
        "dq_unreadable": lambda spark, folder: unreadable_cells(raw_tables(spark, folder)),
        "dq_malformed_rows": _malformed_rows,
        "landing_quarantine": _kept_suppliers,
        "normalized_orders_other_days": _other_days,
        "folder_scan": _folder_scan,
        "report_as_json": _report_as_json,
    }


def oracle_sql() -> dict[str, str]:
    own = oracle.oracle_sql()
    if llm is not None:
        own |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own


def entry(spark: SparkSession) -> DataFrame:
    """Spend per category with its share of the total."""
    return spend.category_spend(StarTables(spark, "/root/testdata/sf0.001"))
