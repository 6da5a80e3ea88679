"""Query parameters: sourcing rules, score weights and scenario factors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SourcingRules:
    """Eligibility floors and ceilings of the rule-constrained allocation.

    ``max_incidents`` is a total per supplier and category. ``strict_cap``
    also applies ``max_single_share`` to the secondary and to single sources.
    """

    max_single_share: float = 0.8
    dual_source_spend: float = 5e10
    min_on_time_pct: float = 0.0
    max_incidents: float = 5.0
    max_risk: str = "High"
    price_percentile: float = 0.0
    strict_cap: bool = False


@dataclass(frozen=True)
class AllocationPolicy:
    """Score weights and limits of the score-based allocation."""

    max_suppliers: int = 3
    min_share: float = 0.15
    unit_cost: float = 0.45
    delivery: float = 0.30
    quality: float = 0.15
    risk: float = 0.10


@dataclass(frozen=True)
class ScenarioFactors:
    """Multipliers of the three savings components."""

    price: float = 1.0
    performance: float = 1.0
    consolidation: float = 1.0


# The three published rule sets and scenarios.
PRESETS = {
    "standard": SourcingRules(0.8, 50_000_000_000, 70, 5, "High", 0.8),
    "conservative": SourcingRules(0.65, 30_000_000_000, 80, 3, "Medium", 0.9),
    "aggressive": SourcingRules(0.9, 100_000_000_000, 60, 10, "High", 0.7),
}
SCENARIOS = {
    "Conservative": ScenarioFactors(0.7, 0.65, 0.6),
    "Base": ScenarioFactors(1.0, 1.0, 1.0),
    "Aggressive": ScenarioFactors(1.2, 1.15, 1.25),
}


@dataclass(frozen=True)
class Assumptions:
    presets: dict[str, SourcingRules] = field(default_factory=lambda: dict(PRESETS))
    policy: AllocationPolicy = AllocationPolicy()
    scenarios: dict[str, ScenarioFactors] = field(default_factory=lambda: dict(SCENARIOS))


# Key names of the JSON parameter file.
_RULE_KEYS = {
    "max_single_supplier_share": "max_single_share",
    "min_dual_source_threshold": "dual_source_spend",
    "min_on_time_delivery_pct": "min_on_time_pct",
    "max_quality_incidents_per_order": "max_incidents",
    "max_risk_level": "max_risk",
    "min_price_percentile": "price_percentile",
}
_FACTOR_KEYS = {
    "price_standardization": "price",
    "performance_improvement": "performance",
    "consolidation": "consolidation",
}


def _pick(keys: dict[str, str], given: dict) -> dict:
    return {keys[name]: value for name, value in given.items() if name in keys}


def parse_assumptions(config: dict) -> Assumptions:
    """Build the parameters from a decoded JSON configuration; absent parts keep defaults."""
    base = Assumptions()
    allocation = config.get("supplier_optimization", {})
    weights = allocation.get("score_weights") or {}
    policy = AllocationPolicy(
        max_suppliers=int(allocation.get("max_suppliers_per_category", base.policy.max_suppliers)),
        min_share=float(allocation.get("min_supplier_share", base.policy.min_share)),
        **{name: float(value) for name, value in weights.items()},
    )
    presets = {n: SourcingRules(**_pick(_RULE_KEYS, c)) for n, c in config.get("constraints", {}).items()}
    scenarios = {
        n: ScenarioFactors(**_pick(_FACTOR_KEYS, c)) for n, c in config.get("sensitivity_scenarios", {}).items()
    }
    return Assumptions(presets or base.presets, policy, scenarios or base.scenarios)


def load_assumptions(path: str, spark: SparkSession | None = None) -> Assumptions:
    """Parameters from a JSON file: on the driver's disk, or with a session in any store that Spark reads."""
    if spark is not None:
        text = spark.read.option("wholetext", True).text(path).first().value
    else:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    return parse_assumptions(json.loads(text))
