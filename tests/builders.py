"""Small canonical tables for tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from spendgrain.model import DATASETS
from spendgrain.tables import Tables

DAY = dt.date(2025, 1, 1)


def _frame(spark: SparkSession, dataset: str, rows: list[dict]):
    schema = DATASETS[dataset].schema
    values = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        values.append(
            tuple(
                Decimal(str(row[f.name])) if "decimal" in f.dataType.simpleString() and row.get(f.name) is not None
                else row.get(f.name)
                for f in schema
            )
        )
    return spark.createDataFrame(values, schema)


def supplier(key: str, **changes) -> dict:
    base = {
        "supplier_id": key, "supplier_name": f"Supplier {key}", "category": "Packaging", "country": "Nigeria",
        "payment_terms": "Net 30", "currency": "NGN", "quality_rating": 4.0, "is_approved": True, "risk_level": "Low",
    }
    return base | changes


def order(number: str, key: str, quantity: float, price: float, late_days: int | None = 0, **changes) -> dict:
    """One order line; ``late_days`` None means not delivered."""
    base = {
        "po_number": number, "po_date": DAY, "supplier_id": key, "supplier_name": f"Supplier {key}",
        "material_id": "M1", "material_name": "Bottle", "category": "Packaging", "quantity": quantity,
        "unit_price_ngn": price, "total_amount_ngn": round(quantity * price, 2), "currency": "NGN",
        "expected_delivery_date": DAY + dt.timedelta(10),
        "actual_delivery_date": None if late_days is None else DAY + dt.timedelta(10 + late_days),
        "delivery_status": "Delivered", "payment_status": "Paid", "buyer": "Buyer", "plant_location": "Lagos",
    }
    return base | changes


def incident(key: str, number: str, supplier_id: str, cost: float, **changes) -> dict:
    base = {
        "incident_id": key, "po_number": number, "supplier_id": supplier_id, "incident_type": "Quality Defect",
        "severity": "High", "cost_impact_ngn": cost,
    }
    return base | changes


def tables(spark: SparkSession, suppliers=(), orders=(), incidents=(), materials=()) -> Tables:
    return Tables(
        _frame(spark, "suppliers", list(suppliers)),
        _frame(spark, "materials", list(materials)),
        _frame(spark, "purchase_orders", list(orders)),
        _frame(spark, "quality_incidents", list(incidents)),
    )


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def one(df) -> dict:
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
