import datetime as dt

import pytest
from builders import incident, one, order, rows, supplier, tables

from spendgrain.operators import savings, spend, summary
from spendgrain.params import SCENARIOS, parse_assumptions


@pytest.fixture(scope="module")
def market(spark):
    suppliers = [supplier(f"S{i}", category=f"C{i % 2}", risk_level="High" if i == 3 else "Low") for i in range(12)]
    orders = [
        order(f"P{i}", f"S{(i + i // 12) % 12}", 1 + i % 5, 10 + (i * 7) % 13, 1 if i % 3 else -1,
              category=f"C{i % 3}", material_name=f"M{i % 4}", po_date=dt.date(2024, 1 + i % 12, 3))
        for i in range(144)
    ]
    incidents = [incident(f"Q{i}", f"P{i}", f"S{(i + i // 12) % 12}", 5 + i) for i in range(0, 60, 3)]
    return tables(spark, suppliers, orders, incidents)


def test_price_variants(market):
    top = rows(spend.price_variance(market, min_spread_pct=None, limit=None))
    assert all(r["supplier_count"] > 1 and r["potential_savings_ngn"] > 0 for r in top)
    assert [r["potential_savings_ngn"] for r in top] == sorted((r["potential_savings_ngn"] for r in top), reverse=True)
    wide = rows(spend.price_variance(market, min_spread_pct=10, limit=None))
    assert all(r["price_variance_pct"] > 10 for r in wide)
    assert len(rows(spend.price_overpayment(market, limit=2))) == 2


def test_scenarios_scale_the_components(market):
    found = {r["scenario"]: r for r in rows(savings.savings_scenarios(market))}
    base = found["Base"]
    parts = ("price_standardization_savings_ngn", "performance_improvement_savings_ngn", "consolidation_savings_ngn")
    assert base["total_savings_ngn"] == pytest.approx(sum(base[p] for p in parts), abs=0.01)
    for name, factors in SCENARIOS.items():
        scaled = (factors.price, factors.performance, factors.consolidation)
        for part, factor in zip(parts, scaled, strict=True):
            assert found[name][part] == pytest.approx(base[part] * factor, abs=0.01)
    assert [r["scenario"] for r in rows(savings.savings_scenarios(market))] == ["Conservative", "Base", "Aggressive"]


def test_components_match_the_single_queries(market):
    base = {r["scenario"]: r for r in rows(savings.savings_scenarios(market))}["Base"]
    price = sum(r["potential_savings_ngn"] for r in rows(spend.price_variance(market, min_spread_pct=None)))
    weak = one(savings.performance_savings(market))["performance_improvement_savings_ngn"]
    merged = sum(r["consolidation_savings_ngn"] for r in rows(savings.consolidation(market)))
    assert base["price_standardization_savings_ngn"] == pytest.approx(price, abs=0.01)
    assert base["performance_improvement_savings_ngn"] == pytest.approx(weak, abs=0.01)
    assert base["consolidation_savings_ngn"] == pytest.approx(merged, abs=0.01)


def test_category_rows_add_up_to_the_scenario(market):
    found = rows(savings.savings_scenarios(market, by_category=True))
    for name in SCENARIOS:
        total = next(r["total_savings_ngn"] for r in found if r["scenario"] == name and r["category"] is None)
        parts = [r["total_savings_ngn"] for r in found if r["scenario"] == name and r["category"] is not None]
        assert total == pytest.approx(sum(parts), abs=0.05)


def test_summary_and_actions(market):
    kinds = [r["opportunity_type"] for r in rows(savings.savings_summary(market))]
    assert sorted(kinds) == ["Price Standardization", "Quality Cost Reduction", "Supplier Consolidation"]
    actions = rows(savings.action_items(market))
    assert {r["action_item"] for r in actions} <= {"Renegotiate Price", "Replace Supplier"}


def test_insights_agree_with_their_queries(market):
    found = {r["metric"]: r["value"] for r in rows(summary.insights_summary(market, replicates=20))}
    assert found["Total Spend"] == pytest.approx(one(spend.executive_summary(market))["total_spend_ngn"], abs=1)
    parts = ("Price Standardization Savings", "Supplier Performance Savings", "Supplier Consolidation Savings")
    assert found["Total Savings Potential"] == pytest.approx(sum(found[p] for p in parts), abs=0.05)
    assert found["Bootstrap P05 Price Savings"] <= found["Bootstrap Median Price Savings"]
    assert found["Bootstrap Median Price Savings"] <= found["Bootstrap P95 Price Savings"]
    display = {r["metric"]: r["display"] for r in rows(summary.displayed(summary.insights_summary(market)))}
    assert display["USD Spend"] == "$0"
    assert display["Savings Percentage"].endswith("%")


def test_insights_of_empty_tables_are_zero(spark):
    found = rows(summary.insights_summary(tables(spark)))
    assert len(found) == 13
    assert all(r["value"] == 0.0 for r in found)


def test_filtered_figures(market):
    everything = one(summary.filtered_kpis(market))
    assert everything["filtered_total_spend"] == pytest.approx(
        one(spend.executive_summary(market))["total_spend_ngn"], abs=1
    )
    some = one(summary.filtered_kpis(market, ["C0"], dt.date(2024, 1, 3), dt.date(2024, 6, 3)))
    lines = [
        r for r in rows(market.orders())
        if r["category"] == "C0" and dt.date(2024, 1, 3) <= r["po_date"] <= dt.date(2024, 6, 3)
    ]
    assert some["filtered_total_spend"] == pytest.approx(float(sum(r["total_amount_ngn"] for r in lines)))
    assert some["filtered_supplier_count"] == len({r["supplier_id"] for r in lines})
    half_open = one(summary.filtered_kpis(market, ["C0"], dt.date(2024, 1, 3)))
    assert half_open["filtered_total_spend"] > some["filtered_total_spend"]


def test_assumptions_from_configuration():
    parsed = parse_assumptions(
        {
            "constraints": {"tight": {"min_on_time_delivery_pct": 95, "max_risk_level": "Low"}},
            "supplier_optimization": {"max_suppliers_per_category": 2, "score_weights": {"unit_cost": 0.7}},
            "sensitivity_scenarios": {"Half": {"price_standardization": 0.5}},
        }
    )
    assert (parsed.presets["tight"].min_on_time_pct, parsed.presets["tight"].max_risk) == (95, "Low")
    assert (parsed.policy.max_suppliers, parsed.policy.unit_cost, parsed.policy.delivery) == (2, 0.7, 0.30)
    assert (parsed.scenarios["Half"].price, parsed.scenarios["Half"].consolidation) == (0.5, 1.0)
    assert parse_assumptions({}).presets["standard"].min_on_time_pct == 70
