"""From raw files to written marts in one batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendgrain.model import DateFormats
from spendgrain.operators import quality, savings, sourcing, spend, suppliers, summary
from spendgrain.params import PRESETS, Assumptions
from spendgrain.plans import marts
from spendgrain.sinks.writers import read_tables, write_marts, write_report, write_tables
from spendgrain.sources.normalize import cleaned_tables, infer_date_formats, normalize, unreadable_cells
from spendgrain.sources.readers import FAIL, QUARANTINE, landing_parts, load_landing, quarantined
from spendgrain.tables import Tables, WithBases


def build_marts(t: Tables, assumptions: Assumptions = Assumptions()) -> dict[str, DataFrame]:
    """The exported marts by name. Nothing runs until they are written."""
    rules = assumptions.presets.get("standard", PRESETS["standard"])
    policy = assumptions.policy
    # Export names.
    return {
        "procurement_insights_summary": summary.insights_summary(t, rules=rules, policy=policy),
        "category_spend": spend.category_share(t),
        "supplier_performance": suppliers.supplier_grade(t),
        "price_variance_top20": spend.price_variance(t, min_spread_pct=None, limit=20),
        "monthly_spend_by_category": spend.monthly_spend_by_category(t),
        "supplier_optimization_recommendations": sourcing.supplier_optimization(t, policy),
        "constrained_supplier_recommendations": sourcing.constrained_sourcing(t, rules),
        "savings_scenarios": savings.savings_scenarios(t, assumptions.scenarios),
    }


def store_bases(t: Tables, folder: str) -> Tables:
    """Write the base marts once; queries over the result read them instead of the lines."""
    write_marts({name: mart(t) for name, mart in marts.BASES.items()}, folder, "parquet")
    return WithBases(t, {name: t.spark.read.parquet(f"{folder}/{name}") for name in marts.BASES})


def run_batch(
    spark: SparkSession,
    landing: str,
    output: str,
    *,
    assumptions: Assumptions = Assumptions(),
    mart_format: str = "csv",
    keep_extra: bool = False,
    date_formats: DateFormats | None = None,
    multi_line: bool = False,
    malformed: str = FAIL,
) -> Tables:
    """Load, normalize, store and analyse a landing folder.

    The canonical tables are written before any mart is computed, and the base
    marts before those that build on them: parsing, joining and aggregating
    lines happen once, and a lost executor repeats only its own scan. The
    headers that were renamed, the quality report over the tables as given, the
    cells per column that could not be read, the normalized tables as CSV and
    the insights as JSON are written as well. Without ``date_formats`` the
    spelling of days that are not ISO ones follows from the cells of each column.
    With ``malformed="quarantine"`` rows with too many or too few cells are set
    aside in a table instead of stopping the run.
    """
    reading = {"multi_line": multi_line, "malformed": malformed}
    raw = load_landing(spark, landing, keep_extra=keep_extra, date_formats=date_formats, **reading)
    whole = infer_date_formats(raw) if date_formats is None else date_formats  # datasets in several parts are read already
    options = {"keep_extra": keep_extra, "date_formats": whole}
    if malformed == QUARANTINE:
        write_marts({"quarantine": quarantined(spark, landing, multi_line=multi_line)}, output, "parquet")
    clean, renames = normalize(raw, **options)
    write_tables(clean, f"{output}/tables")
    stored = store_bases(read_tables(spark, f"{output}/tables"), f"{output}/bases")
    write_marts(build_marts(stored, assumptions), f"{output}/marts", mart_format)
    write_marts(stored.frames(), f"{output}/normalized", "csv")
    summary_path = f"{output}/marts/procurement_insights_summary"
    reader = spark.read.schema("metric string, value double, unit string")
    insights = reader.option("header", True).format(mart_format).load(summary_path)
    write_report(insights, output, "insights_json")
    given, _ = cleaned_tables(raw, **options)
    reported = Tables(given.suppliers(), given.materials(), stored.orders(), given.incidents())
    write_report(quality.quality_report(reported), output, "quality_report_json")
    write_report(unreadable_cells(landing_parts(spark, landing, **reading), date_formats), output, "unreadable_cells_json")
    pairs = [(name, header, column) for name, found in renames.items() for header, column in found.items()]
    write_report(spark.createDataFrame(pairs, "dataset string, header string, column string"), output, "renames_json")
    return stored
