import pytest
from builders import incident, one, order, rows, supplier, tables

from spendgrain.operators import sourcing
from spendgrain.params import AllocationPolicy, SourcingRules

SUPPLIERS = [
    supplier("SUP1", risk_level="Low"),
    supplier("SUP2", risk_level="Medium"),
    supplier("SUP3", risk_level="High"),
]
RULES = dict(max_single_share=0.8, dual_source_spend=1000, min_on_time_pct=80, max_incidents=2, max_risk="Medium")


@pytest.fixture(scope="module")
def scored(spark):
    orders = [
        order("PO1", "SUP1", 100, 10, -1),
        order("PO2", "SUP2", 100, 12, 1),
        order("PO3", "SUP3", 100, 15, 4),
    ]
    return tables(spark, SUPPLIERS, orders, [incident("QI1", "PO3", "SUP3", 150)])


@pytest.fixture(scope="module")
def ruled(spark):
    orders = [
        order("PO1", "SUP1", 100, 10, -1),
        order("PO2", "SUP2", 120, 11, 0),
        order("PO3", "SUP3", 130, 13, 3),
        order("PO4", "SUP1", 140, 9, -1, material_id="M2", material_name="Cap"),
    ]
    return tables(spark, SUPPLIERS, orders, [incident("QI1", "PO3", "SUP3", 100)])


def test_allocation_by_score(scored):
    found = rows(sourcing.supplier_optimization(scored, AllocationPolicy(max_suppliers=2, min_share=0.2)))
    assert [r["supplier_id"] for r in found] == ["SUP1", "SUP2"]
    assert [r["composite_score"] for r in found] == [1.0, 0.48]
    assert [r["recommended_share"] for r in found] == [0.675676, 0.324324]
    assert [r["projected_spend_ngn"] for r in found] == [2027.0, 1168.0]
    assert [(r["cost_score"], r["delivery_score"], r["quality_score"], r["risk_score"]) for r in found] == [
        (1.0, 1.0, 1.0, 1.0),
        (0.6, 0.0, 1.0, 0.6),
    ]


def test_allocation_savings(scored):
    found = one(sourcing.optimization_savings(scored, AllocationPolicy(max_suppliers=2, min_share=0.2)))
    assert found["historical_spend_ngn"] == 3700.0
    assert found["optimized_spend_ngn"] == 3195.0
    assert found["optimization_savings_ngn"] == 505.0
    assert found["optimization_savings_pct"] == pytest.approx(13.6596, abs=1e-4)


def test_minimum_share_is_applied_once(scored):
    shares = [
        r["recommended_share"]
        for r in rows(sourcing.supplier_optimization(scored, AllocationPolicy(max_suppliers=3, min_share=0.3)))
    ]
    base = [1 / 1.5, 0.48 / 1.5, 0.02 / 1.5]
    raised = [max(b, 0.3) for b in base]
    assert shares == [pytest.approx(r / sum(raised), abs=1e-6) for r in raised]


def test_supplier_without_deliveries_is_not_ranked(spark):
    orders = [order("PO1", "SUP1", 10, 5, 0), order("PO2", "SUP2", 10, 6, 2), order("PO3", "SUP3", 10, 1, None)]
    found = rows(sourcing.supplier_optimization(tables(spark, SUPPLIERS, orders)))
    assert [r["supplier_id"] for r in found] == ["SUP1", "SUP2"]


def test_single_source_inside_the_price_band(ruled):
    rules = SourcingRules(**RULES, price_percentile=0.3)
    found = one(sourcing.constrained_sourcing(ruled, rules))
    assert (found["supplier_id"], found["constrained_share"], found["dual_sourced"]) == ("SUP1", 1.0, 0)
    assert found["avg_unit_cost_ngn"] == 9.4167
    assert found["projected_spend_ngn"] == 4614.0
    savings = one(sourcing.constrained_savings(ruled, rules))
    assert savings["constrained_savings_ngn"] == 656.0
    assert savings["constrained_savings_pct"] == pytest.approx(12.4443, abs=1e-4)
    assert savings["dual_sourced_categories"] == 0


def test_two_sources_when_the_band_is_wide(ruled):
    rules = SourcingRules(**RULES, price_percentile=1.0)
    found = rows(sourcing.constrained_sourcing(ruled, rules))
    assert [(r["supplier_id"], r["constrained_share"]) for r in found] == [("SUP1", 0.65), ("SUP2", 0.35)]
    # The flag is added up over rows.
    assert one(sourcing.constrained_savings(ruled, rules))["dual_sourced_categories"] == 2


def test_small_category_keeps_one_source(ruled):
    rules = SourcingRules(**{**RULES, "dual_source_spend": 1e9}, price_percentile=1.0)
    assert [r["supplier_id"] for r in rows(sourcing.constrained_sourcing(ruled, rules))] == ["SUP1"]


def test_cheapest_of_all_when_nobody_is_eligible(ruled):
    rules = SourcingRules(**{**RULES, "min_on_time_pct": 101}, price_percentile=0.5)
    found = one(sourcing.constrained_sourcing(ruled, rules))
    assert (found["supplier_id"], found["dual_sourced"]) == ("SUP1", 0)


def test_strict_cap_leaves_the_rest_at_its_cost(ruled):
    rules = SourcingRules(**RULES, price_percentile=0.3, strict_cap=True)
    assert one(sourcing.constrained_sourcing(ruled, rules))["constrained_share"] == 0.8
    after = 0.8 * 490 * 9.4167 + 0.2 * 5270
    assert one(sourcing.constrained_savings(ruled, rules))["constrained_spend_ngn"] == pytest.approx(after, abs=1)


def test_second_source_is_another_supplier(spark):
    """One supplier under two names must not fill both places."""
    orders = [
        order("PO1", "SUP1", 100, 10),
        order("PO2", "SUP1", 100, 11, supplier_name="Alias"),
        order("PO3", "SUP2", 100, 12),
    ]
    rules = SourcingRules(dual_source_spend=1, price_percentile=1.0)
    found = rows(sourcing.constrained_sourcing(tables(spark, SUPPLIERS, orders), rules))
    assert [(r["supplier_id"], r["constrained_share"]) for r in found] == [("SUP1", 0.65), ("SUP2", 0.35)]


def test_incidents_count_once_per_category(spark):
    """Two lines of one order must not double the order's incident."""
    orders = [order("PO1", "SUP1", 10, 5), order("PO1", "SUP1", 20, 5), order("PO1", "SUP2", 20, 5)]
    t = tables(spark, SUPPLIERS, orders, [incident("QI1", "PO1", "SUP1", 70), incident("QI2", "PO1", "SUP1", 30)])
    found = {r["supplier_id"]: r for r in rows(sourcing.marts.supplier_category(t))}
    assert (found["SUP1"]["total_quality_cost_ngn"], found["SUP1"]["quality_incident_count"]) == (100.0, 2)
    assert found["SUP1"]["total_orders"] == 1
    assert (found["SUP2"]["total_quality_cost_ngn"], found["SUP2"]["quality_incident_count"]) == (0.0, 0)


def test_shares_add_up_per_category(spark):
    suppliers = [supplier(f"S{i}", risk_level=("Low", "Medium", "High")[i % 3]) for i in range(12)]
    orders = [
        order(f"P{i}", f"S{i % 12}", 10 + i % 7, 5 + i % 11, (i * 5) % 9 - 4, category=f"C{i % 4}") for i in range(120)
    ]
    t = tables(spark, suppliers, orders)
    for frame, share in (
        (sourcing.supplier_optimization(t), "recommended_share"),
        (sourcing.constrained_sourcing(t, SourcingRules(dual_source_spend=1, price_percentile=0.9)), "constrained_share"),
    ):
        totals: dict[str, float] = {}
        for r in rows(frame):
            totals[r["category"]] = totals.get(r["category"], 0.0) + r[share]
        assert len(totals) == 4
        assert all(total == pytest.approx(1.0, abs=1e-5) for total in totals.values())


def test_empty_tables_give_empty_plans_and_zero_totals(spark):
    t = tables(spark)
    assert rows(sourcing.supplier_optimization(t)) == []
    assert rows(sourcing.constrained_sourcing(t)) == []
    assert one(sourcing.optimization_savings(t)) == {
        "historical_spend_ngn": 0.0,
        "optimized_spend_ngn": 0.0,
        "optimization_savings_ngn": 0.0,
        "optimization_savings_pct": 0.0,
    }
    assert one(sourcing.constrained_savings(t)) == {
        "constrained_spend_ngn": 0.0,
        "constrained_savings_ngn": 0.0,
        "constrained_savings_pct": 0.0,
        "dual_sourced_categories": 0,
    }
