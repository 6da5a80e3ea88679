"""Canonical tables: column types, required columns, defaults and header aliases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
QUANTITY = T.DecimalType(18, 3)


#: Patterns tried after ISO days: for all columns, or by dataset and column.
DateFormats = tuple[str, ...] | Mapping[str, Mapping[str, tuple[str, ...]]]


class SchemaError(ValueError):
    """The supplied tables cannot be mapped onto the canonical model."""


@dataclass(frozen=True)
class Dataset:
    """One canonical table.

    ``aliases`` lists, per canonical column, the accepted headers in order of
    preference. ``defaults`` fill a column only when the input lacks it.
    """

    types: dict[str, T.DataType]
    required: tuple[str, ...]
    defaults: dict[str, object]
    aliases: dict[str, tuple[str, ...]] = field(repr=False)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, kind) for name, kind in self.types.items()])


_TEXT = T.StringType()

# Column names, defaults and accepted header spellings.
SUPPLIERS = Dataset(
    types={
        "supplier_id": _TEXT,
        "supplier_name": _TEXT,
        "category": _TEXT,
        "country": _TEXT,
        "payment_terms": _TEXT,
        "currency": _TEXT,
        "quality_rating": T.DoubleType(),
        "is_approved": T.BooleanType(),
        "risk_level": _TEXT,
    },
    required=("supplier_id", "supplier_name"),
    defaults={
        "category": "Unclassified",
        "country": "Unknown",
        "payment_terms": "Net 30",
        "currency": "NGN",
        "quality_rating": 4.0,
        "is_approved": True,
        "risk_level": "Medium",
    },
    aliases={
        "supplier_id": ("supplier_id", "vendor_id", "vendor_code", "supplier_code", "id"),
        "supplier_name": ("supplier_name", "vendor_name", "name", "supplier", "vendor"),
        "category": ("category", "supplier_category", "spend_category"),
        "country": ("country", "supplier_country", "country_name"),
        "payment_terms": ("payment_terms", "payment_term", "terms"),
        "currency": ("currency", "invoice_currency", "po_currency"),
        "quality_rating": ("quality_rating", "quality_score", "supplier_score", "rating"),
        "is_approved": ("is_approved", "approved", "approved_flag", "is_active"),
        "risk_level": ("risk_level", "risk", "risk_rating", "vendor_risk"),
    },
)

MATERIALS = Dataset(
    types={
        "material_id": _TEXT,
        "material_name": _TEXT,
        "category": _TEXT,
        "unit_of_measure": _TEXT,
        "standard_price_ngn": MONEY,
        "lead_time_days": T.IntegerType(),
    },
    required=("material_id", "material_name"),
    defaults={
        "category": "Unclassified",
        "unit_of_measure": "PCS",
        "standard_price_ngn": 0.0,
        "lead_time_days": 30,
    },
    aliases={
        "material_id": ("material_id", "item_id", "sku", "material_code", "item_code"),
        "material_name": ("material_name", "item_name", "description", "material", "item_description"),
        "category": ("category", "material_category", "spend_category"),
        "unit_of_measure": ("unit_of_measure", "uom", "unit"),
        "standard_price_ngn": ("standard_price_ngn", "standard_cost", "std_price", "unit_standard_cost"),
        "lead_time_days": ("lead_time_days", "lead_time", "lead_days"),
    },
)

PURCHASE_ORDERS = Dataset(
    types={
        "po_number": _TEXT,
        "po_date": T.DateType(),
        "supplier_id": _TEXT,
        "supplier_name": _TEXT,
        "material_id": _TEXT,
        "material_name": _TEXT,
        "category": _TEXT,
        "quantity": QUANTITY,
        "unit_price_ngn": MONEY,
        "total_amount_ngn": MONEY,
        "total_amount_usd": MONEY,
        "currency": _TEXT,
        "expected_delivery_date": T.DateType(),
        "actual_delivery_date": T.DateType(),
        "delivery_status": _TEXT,
        "payment_status": _TEXT,
        "buyer": _TEXT,
        "plant_location": _TEXT,
    },
    required=("po_number", "po_date", "supplier_id", "material_id", "quantity"),
    # An absent category stays NULL so that it can still be filled from the
    # material or the supplier; 'Unclassified' is the last resort.
    defaults={
        "supplier_name": None,
        "material_name": None,
        "category": None,
        "unit_price_ngn": 0.0,
        "total_amount_ngn": None,
        "total_amount_usd": None,
        "currency": "NGN",
        "expected_delivery_date": None,
        "actual_delivery_date": None,
        "delivery_status": "Delivered",
        "payment_status": "Paid",
        "buyer": "Unassigned",
        "plant_location": "Unknown",
    },
    aliases={
        "po_number": ("po_number", "po_id", "purchase_order", "purchase_order_number", "order_id"),
        "po_date": ("po_date", "order_date", "document_date", "created_date"),
        "supplier_id": ("supplier_id", "vendor_id", "supplier_code", "vendor_code"),
        "supplier_name": ("supplier_name", "vendor_name", "supplier", "vendor"),
        "material_id": ("material_id", "item_id", "sku", "material_code", "item_code"),
        "material_name": ("material_name", "item_name", "description", "item_description"),
        "category": ("category", "spend_category", "material_category"),
        "quantity": ("quantity", "qty", "ordered_qty", "order_quantity"),
        "unit_price_ngn": ("unit_price_ngn", "unit_price", "unit_cost", "net_price"),
        "total_amount_ngn": ("total_amount_ngn", "total_amount", "line_amount", "extended_amount", "spend_ngn"),
        "total_amount_usd": ("total_amount_usd", "spend_usd", "amount_usd"),
        "currency": ("currency", "invoice_currency", "po_currency"),
        "expected_delivery_date": ("expected_delivery_date", "promised_delivery_date", "expected_receipt_date"),
        "actual_delivery_date": ("actual_delivery_date", "delivery_date", "receipt_date", "actual_receipt_date"),
        "delivery_status": ("delivery_status", "status", "receipt_status"),
        "payment_status": ("payment_status", "invoice_status", "payment_state"),
        "buyer": ("buyer", "purchaser", "requestor", "buyer_name"),
        "plant_location": ("plant_location", "plant", "site", "location"),
    },
)

QUALITY_INCIDENTS = Dataset(
    types={
        "incident_id": _TEXT,
        "po_number": _TEXT,
        "supplier_id": _TEXT,
        "incident_type": _TEXT,
        "severity": _TEXT,
        "cost_impact_ngn": MONEY,
    },
    required=(),
    defaults={
        "incident_id": None,
        "po_number": None,
        "supplier_id": None,
        "incident_type": "Quality Defect",
        "severity": "Medium",
        "cost_impact_ngn": 0.0,
    },
    aliases={
        "incident_id": ("incident_id", "quality_incident_id", "issue_id", "defect_id"),
        "po_number": ("po_number", "po_id", "purchase_order", "order_id"),
        "supplier_id": ("supplier_id", "vendor_id", "vendor_code"),
        "incident_type": ("incident_type", "issue_type", "defect_type", "non_conformance_type"),
        "severity": ("severity", "priority", "impact_level"),
        "cost_impact_ngn": ("cost_impact_ngn", "cost_impact", "impact_amount", "loss_amount"),
    },
)

DATASETS: dict[str, Dataset] = {
    "suppliers": SUPPLIERS,
    "materials": MATERIALS,
    "purchase_orders": PURCHASE_ORDERS,
    "quality_incidents": QUALITY_INCIDENTS,
}

# Words in a file name that tell which dataset it holds.
FILENAME_HINTS: dict[str, tuple[str, ...]] = {
    "suppliers": ("supplier", "vendor"),
    "materials": ("material", "item", "sku", "product"),
    "purchase_orders": ("purchase_order", "po", "order"),
    "quality_incidents": ("quality", "incident", "defect", "issue", "non_conformance"),
}

# Spellings of yes and no.
TRUE_WORDS = ("1", "true", "yes", "y", "approved", "active")
FALSE_WORDS = ("0", "false", "no", "n", "rejected", "inactive")

# Risk scores and ranks; the last entry of each is for other levels.
RISK_SCORES = {"Low": 1.0, "Medium": 0.6, "High": 0.2}
RISK_SCORE_OTHER = 0.4
RISK_RANKS = {"Low": 0, "Medium": 1, "High": 2}
RISK_RANK_OTHER = 3

# Cell texts that pandas reads as missing by default.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
