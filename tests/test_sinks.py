import datetime as dt
import json

import pytest
from builders import incident, one, order, rows, supplier, tables

from spendgrain.operators import spend
from spendgrain.plans.pipeline import build_marts, run_batch
from spendgrain.sinks import writers


@pytest.fixture(scope="module")
def small(spark):
    orders = [
        order(f"P{i}", f"S{i % 3}", 1 + i, 2.5, category=f"C{i % 2}", po_date=dt.date(2024, 1 + i % 3, 5)) for i in range(12)
    ]
    orders.append(order("P99", "S1", 1, 1, po_date=None))
    return tables(spark, [supplier(f"S{i}") for i in range(3)], orders, [incident("Q1", "P1", "S1", 3)])


def test_tables_survive_the_round_trip(spark, small, tmp_path):
    folder = str(tmp_path / "stored")
    writers.write_tables(small, folder)
    writers.write_tables(small, folder)  # replaces, does not append
    stored = writers.read_tables(spark, folder)
    columns = small.orders().columns
    key = lambda r: (r["po_number"], str(r))
    assert sorted(rows(stored.orders(*columns)), key=key) == sorted(rows(small.orders()), key=key)
    months = {p.name for p in (tmp_path / "stored" / "purchase_orders.parquet").iterdir() if p.is_dir()}
    assert months == {"po_month=2024-01", "po_month=2024-02", "po_month=2024-03", "po_month=none"}
    assert rows(spend.category_spend(stored)) == rows(spend.category_spend(small))


def test_catalog_tables_are_replaced(spark, small):
    spark.sql("CREATE DATABASE IF NOT EXISTS purchasing")
    writers.save_tables(small, "purchasing")
    writers.save_tables(small, "purchasing")
    assert one(spark.sql("SELECT count(*) AS n FROM purchasing.purchase_orders"))["n"] == 13


def test_views_answer_sql(spark, small):
    writers.register_views(small)
    found = one(spark.sql("SELECT sum(total_orders) AS n FROM vw_supplier_performance WHERE total_orders > 0"))
    assert found["n"] == 13
    assert spark.sql("SELECT * FROM vw_category_spend").columns == [
        "category", "year", "month", "total_orders", "total_spend_ngn", "avg_order_value", "unique_suppliers",
    ]
    assert spark.sql("SELECT * FROM vw_savings_opportunities").count() == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_marts_as_files(spark, small, tmp_path, fmt):
    writers.write_marts({"monthly": spend.monthly_spend_by_category(small)}, str(tmp_path), fmt)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    stored = reader.format(fmt).load(str(tmp_path / "monthly"))
    assert set(stored.columns) == {"month", "category", "total_spend_ngn"}
    assert stored.count() == spend.monthly_spend_by_category(small).count()


def test_batch_run_from_raw_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "vendor_master.csv").write_text(
        "vendor_id,vendor_name,supplier_category,risk\nS1,Acme,Packaging,high\nS2,Best,Packaging,low\n"
    )
    (landing / "item_master.csv").write_text("item_code,item_name,material_category\nM1,Bottle,Packaging\n")
    lines = ["po_id,order_date,vendor_id,sku,qty,unit_price,delivery_date"]
    lines += [f"P{i},2025-0{1 + i % 3}-11,S{1 + i % 2},M1,{10 + i},{5 + i % 4},2025-02-0{1 + i % 9}" for i in range(20)]
    (landing / "PO_LINES_2025.csv").write_text("\n".join(lines) + "\n")
    (landing / "non_conformance_log.csv").write_text("po_id,cost_impact\nP1,12.5\nP2,7\n")
    (landing / "accounts_receivable.csv").write_text("a\n1\n")
    stored = run_batch(spark, str(landing), str(tmp_path / "out"))
    assert stored.orders().count() == 20
    marts = tmp_path / "out" / "marts"
    assert {p.name for p in marts.iterdir()} == set(build_marts(stored))
    summary = spark.read.option("header", True).csv(str(marts / "procurement_insights_summary"))
    values = {r["metric"]: float(r["value"]) for r in rows(summary)}
    assert values["Total Spend"] == sum((10 + i) * (5 + i % 4) for i in range(20))
    assert values["Maverick Spend"] == sum((10 + i) * (5 + i % 4) for i in range(0, 20, 2))
    parts = (tmp_path / "out" / "quality_report_json").glob("part-*.json")
    checks = [json.loads(line) for part in parts for line in part.read_text().splitlines()]
    assert {"check": "row_counts", "dataset": "purchase_orders", "value": 20} in checks
