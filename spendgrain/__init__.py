"""Purchasing-spend analytics as plain Spark DataFrame queries."""

from spendgrain.model import SchemaError
from spendgrain.tables import Tables

__all__ = ["SchemaError", "Tables"]
