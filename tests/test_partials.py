"""Month partials against the lines they stand for, their refresh, and what is read."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from spendgrain.operators import rollup, spend, summary
from spendgrain.plans import partials
from spendgrain.sinks.writers import read_tables, replace_months, write_tables
from spendgrain.sources.star import StarTables
from tests.builders import one, order, rows, supplier, tables

FOLDER = "/root/testdata/sf0.001"
RANGES = [
    (None, None),
    (dt.date(1996, 1, 15), dt.date(1999, 11, 10)),
    (dt.date(1996, 1, 1), dt.date(1996, 1, 31)),
    (dt.date(1997, 2, 3), dt.date(1997, 2, 20)),
    (dt.date(1997, 2, 27), dt.date(1997, 3, 2)),
    (dt.date(1999, 1, 1), dt.date(1998, 1, 1)),
]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("partials"))
    write_tables(StarTables(spark, FOLDER), f"{folder}/tables")
    t = read_tables(spark, f"{folder}/tables")
    partials.write_partials(t, f"{folder}/partials")
    return t, f"{folder}/partials"


def test_split_range():
    day = dt.date
    assert partials.split_range(day(2024, 1, 1), day(2024, 2, 29)) == (("2024-01", "2024-02"), [])
    assert partials.split_range(day(2023, 12, 31), day(2024, 2, 28)) == (("2024-01", "2024-01"), ["2023-12", "2024-02"])
    assert partials.split_range(day(2024, 1, 2), day(2024, 1, 30)) == (None, ["2024-01"])
    assert partials.split_range(day(2024, 1, 31), day(2024, 2, 1)) == (None, ["2024-01", "2024-02"])


@pytest.mark.parametrize(("start", "end"), RANGES)
@pytest.mark.parametrize("categories", [(), ("PROMO", "LARGE"), ("none such",)])
def test_same_answers_as_from_lines(stored, start, end, categories):
    t, folder = stored
    view = partials.partial_view(t, folder, categories, start, end)
    lines = summary.filtered_view(t, categories, start, end)
    assert rows(rollup.category_spend(view)) == rows(spend.category_spend(lines))
    assert rows(rollup.monthly_spend(view)) == rows(spend.monthly_spend_by_category(lines))
    assert rows(rollup.price_variance(view, limit=None)) == rows(spend.price_variance(lines, min_spread_pct=None, limit=None))
    assert rows(rollup.kpis(view, t)) == rows(summary.filtered_kpis(t, categories, start, end))


def test_reads_whole_months_from_partials_only(stored):
    t, folder = stored
    whole = physical(rollup.monthly_spend(partials.partial_view(t, folder, (), dt.date(1996, 1, 1), dt.date(1996, 3, 31))))
    assert "unit_price_ngn" not in whole
    assert re.search(r"PartitionFilters: \[[^]]*po_month[^]]*>= 1996-01[^]]*po_month[^]]*<= 1996-03", whole)
    ends = physical(partials.partial_view(t, folder, (), dt.date(1996, 1, 15), dt.date(1996, 3, 2)))
    scans = re.findall(r"PartitionFilters: \[([^]]*)\]", ends)
    assert any(">= 1996-02" in s and "<= 1996-02" in s for s in scans)
    assert any("po_month" in s and "IN (1996-01,1996-03)" in s for s in scans)


def _files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/po_month=*/*.parquet")}


def test_a_late_month_is_replaced_alone(spark, tmp_path):
    folder = str(tmp_path)
    vendor = [supplier("S1")]
    first = [order("1", "S1", 1, 10, po_date=dt.date(2025, 1, 5)), order("2", "S1", 1, 20, po_date=dt.date(2025, 2, 5)), order("3", "S1", 1, 5, po_date=None)]
    partials.write_partials(tables(spark, vendor, first), folder)
    before = _files(folder)
    late = tables(spark, vendor, [*first, order("4", "S1", 2, 7, po_date=dt.date(2025, 2, 9)), order("5", "S1", 9, 9, po_date=dt.date(2025, 1, 9))])
    for _ in range(2):
        partials.refresh_partials(late, folder, ["2025-02"])
    found = {r["month"]: r["total_spend_ngn"] for r in rows(rollup.monthly_spend(partials.partial_view(late, folder)))}
    assert found == {"2025-01": 10.0, "2025-02": 34.0}
    assert {p: t for p, t in _files(folder).items() if "2025-02" not in p} == {p: t for p, t in before.items() if "2025-02" not in p}
    gone = tables(spark, vendor, [o for o in first if o["po_number"] != "2"])
    partials.refresh_partials(gone, folder, ["2025-02", "2030-01"])
    assert {r["po_month"] for r in spark.read.parquet(folder).select("po_month").distinct().collect()} == {"2025-01", "none"}


def test_refresh_reads_its_months_only(stored):
    t, _ = stored
    plan = physical(partials.month_partials(partials.months_of(t, ["1996-05"])))
    assert re.search(r"PartitionFilters: \[[^]]*po_month[^]]*1996-05", plan)


def test_stored_lines_of_a_month_are_replaced_alone(spark, tmp_path):
    folder, path = str(tmp_path), f"{tmp_path}/purchase_orders.parquet"
    vendor = [supplier("S1")]
    write_tables(tables(spark, vendor, [order("1", "S1", 1, 10, po_date=dt.date(2025, 1, 5)), order("2", "S1", 1, 20, po_date=dt.date(2025, 2, 5))]), folder)
    before = _files(path)
    late = tables(spark, vendor, [order("9", "S1", 1, 99, po_date=dt.date(2025, 1, 5)), order("3", "S1", 1, 7, po_date=dt.date(2025, 2, 6))])
    for _ in range(2):
        replace_months(late, folder, ["2025-02", "2025-03"])
    assert sorted(r["po_number"] for r in rows(read_tables(spark, folder).orders())) == ["1", "3"]
    assert {p: t for p, t in _files(path).items() if "2025-01" in p} == {p: t for p, t in before.items() if "2025-01" in p}
    replace_months(late, folder, ["2025-03"])
    replace_months(tables(spark, vendor, []), folder, ["2025-02"])
    assert [r["po_number"] for r in rows(read_tables(spark, folder).orders())] == ["1"]


def test_sketches_add_up_over_months(spark, tmp_path):
    folder = str(tmp_path)
    n = 40_000  # orders, each with lines in two months
    base = tables(spark, [supplier("S1")], [order("1", "S1", 1, 10)])
    lines = base.orders().drop("po_number", "po_date").crossJoin(spark.range(n).select(F.col("id").cast("string").alias("po_number")))
    months = F.explode(F.array(F.lit(dt.date(2025, 1, 5)), F.lit(dt.date(2025, 2, 5))))
    t = type(base)(base.suppliers(), base.materials(), lines.withColumn("po_date", months), base.incidents())
    partials.write_partials(t, folder)
    found = one(rollup.category_orders(partials.partial_view(t, folder)))
    assert abs(found["orders_estimate"] - n) <= 4 * partials.SKETCH_ERROR * n and found["unique_suppliers"] == 1
    activity = one(rollup.supplier_activity(partials.partial_view(t, folder)))
    assert activity["order_rows"] == 2 * n and activity["orders_estimate"] == found["orders_estimate"]
    assert activity["total_spend_ngn"] == 20.0 * n and activity["on_time_delivery_pct"] == 100.0


def test_empty(spark, tmp_path):
    t = tables(spark, [supplier("S1")])
    partials.write_partials(t, str(tmp_path))
    schema = partials.month_partials(t).schema
    view = spark.createDataFrame([], schema)
    assert one(rollup.kpis(view, t)) == one(summary.filtered_kpis(t))
    assert rows(rollup.category_spend(view)) == rows(rollup.monthly_spend(view)) == []


def test_filter_by_a_table(stored, spark):
    t, folder = stored
    wanted = spark.createDataFrame([("PROMO",), ("LARGE",), ("LARGE",), (None,)], "category string")
    for query in (spend.category_spend, spend.monthly_spend_by_category):
        assert rows(query(summary.filtered_view(t, wanted))) == rows(query(summary.filtered_view(t, ("PROMO", "LARGE"))))
    assert rows(rollup.category_spend(partials.partial_view(t, folder, wanted))) == rows(spend.category_spend(summary.filtered_view(t, ("PROMO", "LARGE"))))
    vendors = t.suppliers("supplier_id").limit(3)
    found = summary.filtered_view(t, vendors).orders("supplier_id").distinct().count()
    assert found == 3
    assert rows(summary.of_categories(spend.category_spend(t), wanted).select("category")) == [r for r in rows(spend.category_spend(t).select("category")) if r["category"] in ("PROMO", "LARGE")]


def test_months_of_a_table_prune_at_run_time(stored, spark, tmp_path):
    t, _ = stored
    spark.createDataFrame([(f"1996-{m:02d}", m % 2) for m in range(1, 13)], "po_month string, kind int").write.parquet(f"{tmp_path}/periods")
    months = spark.read.parquet(f"{tmp_path}/periods").where("kind = 0").select("po_month")
    result = summary.filtered_view(t, months).orders("category", "total_amount_ngn")
    assert re.search(r"PartitionFilters: \[[^]]*dynamicpruning", physical(result))
    assert result.count() == t.orders("po_date").where("year(po_date) = 1996 AND month(po_date) % 2 = 0").count()
