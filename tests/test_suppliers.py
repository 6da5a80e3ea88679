import pytest
from builders import incident, one, order, rows, supplier, tables
from pyspark.sql import functions as F

from spendgrain.operators import risk, spend, suppliers
from spendgrain.plans import marts


@pytest.fixture(scope="module")
def two_incidents(spark):
    orders = [order(f"PO{i}", "S1", 10, 10) for i in range(3)]
    return tables(
        spark, [supplier("S1"), supplier("S2")], orders, [incident("Q1", "PO0", "S1", 10), incident("Q2", "PO1", "S1", 10)]
    )


def test_orders_and_incidents_do_not_multiply(two_incidents):
    found = {r["supplier_id"]: r for r in rows(marts.supplier_performance(two_incidents))}
    assert (found["S1"]["total_spend_ngn"], found["S1"]["total_quality_cost"]) == (300.0, 20.0)
    assert (found["S1"]["total_orders"], found["S1"]["quality_incidents"]) == (3, 2)
    assert found["S1"]["on_time_delivery_pct"] == 100.0


def test_compat_repeats_the_plain_join(two_incidents):
    found = {r["supplier_id"]: r for r in rows(marts.supplier_performance(two_incidents, compat=True))}
    assert (found["S1"]["total_spend_ngn"], found["S1"]["total_quality_cost"]) == (600.0, 60.0)
    assert found["S1"]["avg_order_value"] == 100.0


def test_supplier_without_orders_stays(two_incidents):
    found = {r["supplier_id"]: r for r in rows(marts.supplier_performance(two_incidents))}["S2"]
    assert (found["total_orders"], found["total_spend_ngn"], found["on_time_delivery_pct"]) == (0, None, None)
    assert found["total_quality_cost"] == 0.0
    assert [r["supplier_id"] for r in rows(suppliers.supplier_grade(two_incidents))] == ["S1"]


@pytest.mark.parametrize(
    ("rate", "count", "letter", "step"),
    [
        (98.0, 0, "A", "A - Excellent"),
        (92.0, 2, "B", "B - Good"),
        (85.0, 3, "C", "C - Average"),
        (70.0, 6, "D", "C - Average"),
        (50.0, 10, "E", "D - Poor"),
        (None, 0, "E", "C - Average"),
    ],
)
def test_grades(spark, rate, count, letter, step):
    one_row = spark.range(1)
    on_time, incidents = F.lit(rate).cast("double"), F.lit(count)
    assert one_row.select(suppliers.letter_grade(on_time, incidents)).first()[0] == letter
    assert one_row.select(suppliers.scorecard_grade(on_time, incidents)).first()[0] == step


def test_late_delivery_counts_early_lines_as_negative(spark):
    orders = [order(f"PO{i}", "S1", 1, 1, days) for i, days in enumerate([5, 5, -2, -2, 0, 0, None])]
    found = one(suppliers.late_delivery(tables(spark, [supplier("S1")], orders)))
    assert (found["total_deliveries"], found["late_deliveries"], found["late_delivery_pct"]) == (6, 2, 33.33)
    assert found["avg_delay_days"] == 1.0


def test_quality_cost_share(two_incidents):
    found = one(suppliers.quality_cost(two_incidents))
    assert (found["incident_count"], found["high_severity_count"], found["quality_cost_pct_of_spend"]) == (2, 2, 6.67)


def test_maverick_lists_each_buyer_once(spark):
    members = [supplier("S1", is_approved=False), supplier("S2"), supplier("S3", risk_level="High")]
    orders = [order("P1", "S1", 1, 10, buyer="Zoe"), order("P2", "S1", 1, 5, buyer="Abe"), order("P3", "S1", 1, 5, buyer="Zoe"),
              order("P4", "S2", 1, 100), order("P5", "S3", 1, 30), order("P6", "S9", 1, 50)]
    t = tables(spark, members, orders)
    found = {r["supplier_name"]: r for r in rows(risk.maverick_suppliers(t))}
    assert set(found) == {"Supplier S1", "Supplier S3"}
    assert (found["Supplier S1"]["buyers"], found["Supplier S1"]["order_count"]) == ("Abe,Zoe", 3)
    total = one(risk.maverick_total(t))
    assert (total["maverick_spend_ngn"], total["maverick_pct_of_spend"]) == (50.0, 25.0)


def test_fx_volatility_with_and_without_rounding(spark):
    orders = [
        order("P1", "S1", 1, 1000, currency="USD", total_amount_usd=1.0),
        order("P2", "S1", 1, 1500, currency="USD", total_amount_usd=1.0),
        order("P3", "S1", 1, 999, currency="NGN", total_amount_usd=1.0),
        order("P4", "S1", 1, 999, currency="USD", total_amount_usd=0.0),
    ]
    t = tables(spark, [supplier("S1")], orders)
    assert one(risk.fx_exposure(t))["fx_volatility_pct"] == 50.0
    assert one(risk.fx_exposure(t, round_first=False))["total_usd_spend"] == 2.0
    none = tables(spark, [supplier("S1")], [order("P1", "S1", 1, 1)])
    assert one(risk.fx_exposure(none, round_first=False))["fx_volatility_pct"] == 0.0


def test_totals_agree(spark):
    orders = [order(f"P{i % 30}", f"S{i % 5}", 1 + i % 4, 3.33 + i, category=f"C{i % 3}") for i in range(60)]
    t = tables(spark, [supplier(f"S{i}") for i in range(5)], orders)
    exact = one(spend.executive_summary(t))
    rough = one(spend.executive_summary(t, approximate=True))
    assert rough["total_orders"] == pytest.approx(exact["total_orders"], rel=0.15)
    assert rough["total_spend_ngn"] == exact["total_spend_ngn"]
    total = exact["total_spend_ngn"]
    by_supplier = sum(r["total_spend_ngn"] for r in rows(marts.supplier_performance(t)))
    by_month = sum(r["total_spend_ngn"] for r in rows(spend.monthly_spend_by_category(t)))
    shares = sum(r["pct_of_total"] for r in rows(spend.category_spend(t)))
    assert by_supplier == pytest.approx(total, abs=1)
    assert by_month == pytest.approx(total, abs=1)
    assert shares == pytest.approx(100, abs=0.05)
