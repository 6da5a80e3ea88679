"""The four canonical tables as one argument for every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

# Orders stored by month have this column besides the canonical ones.
MONTH_COLUMN = "po_month"


class Tables:
    """Canonical DataFrames, read column by column.

    Queries ask for the columns they use. A plain table answers with a
    ``select``; a mapped source (see ``sources.star``) adds only the joins
    those columns need.
    """

    #: Base marts that were stored, by name; none for plain tables.
    bases: dict[str, DataFrame] = {}

    def __init__(
        self,
        suppliers: DataFrame,
        materials: DataFrame,
        purchase_orders: DataFrame,
        quality_incidents: DataFrame,
    ) -> None:
        self._suppliers = suppliers
        self._materials = materials
        self._orders = purchase_orders
        self._incidents = quality_incidents

    @property
    def spark(self) -> SparkSession:
        return self._suppliers.sparkSession

    def suppliers(self, *columns: str) -> DataFrame:
        return self._suppliers.select(*columns) if columns else self._suppliers

    def materials(self, *columns: str) -> DataFrame:
        return self._materials.select(*columns) if columns else self._materials

    def orders(self, *columns: str) -> DataFrame:
        return self._orders.select(*columns) if columns else self._orders

    def incidents(self, *columns: str) -> DataFrame:
        return self._incidents.select(*columns) if columns else self._incidents

    def order_columns(self) -> list[str]:
        return self.orders().columns

    def frames(self) -> dict[str, DataFrame]:
        return {
            "suppliers": self.suppliers(),
            "materials": self.materials(),
            "purchase_orders": self.orders(),
            "quality_incidents": self.incidents(),
        }

    def preview(self, name: str, rows: int = 200) -> DataFrame:
        """Some rows of a table, for a look at its contents."""
        return self.frames()[name].limit(rows)

    def where_orders(self, condition: Column, *uses: str) -> Tables:
        """The same tables with the order lines filtered on the named columns."""
        return _FilteredTables(self, condition, uses)

    def matching_orders(self, keys: DataFrame) -> Tables:
        """The same tables with the order lines whose values appear in a table of keys.

        The columns of ``keys`` are order columns. It may be of any size: lines
        are semi-joined, and months of stored lines that no key names are not read.
        """
        return _FilteredTables(self, keys, tuple(keys.columns))


class WithBases(Tables):
    """Tables together with stored base marts, which queries read instead of aggregating lines again."""

    def __init__(self, tables: Tables, bases: dict[str, DataFrame]) -> None:
        self._tables = tables
        self.bases = bases

    @property
    def spark(self) -> SparkSession:
        return self._tables.spark

    def suppliers(self, *columns: str) -> DataFrame:
        return self._tables.suppliers(*columns)

    def materials(self, *columns: str) -> DataFrame:
        return self._tables.materials(*columns)

    def orders(self, *columns: str) -> DataFrame:
        return self._tables.orders(*columns)

    def incidents(self, *columns: str) -> DataFrame:
        return self._tables.incidents(*columns)


class _FilteredTables(Tables):
    def __init__(self, base: Tables, condition: Column | DataFrame, uses: tuple[str, ...]) -> None:
        self._base = base
        self._condition = condition
        self._uses = uses

    @property
    def spark(self) -> SparkSession:
        return self._base.spark

    def suppliers(self, *columns: str) -> DataFrame:
        return self._base.suppliers(*columns)

    def materials(self, *columns: str) -> DataFrame:
        return self._base.materials(*columns)

    def incidents(self, *columns: str) -> DataFrame:
        return self._base.incidents(*columns)

    def order_columns(self) -> list[str]:
        return self._base.order_columns()

    def orders(self, *columns: str) -> DataFrame:
        if not columns:
            return self._kept(self._base.orders())
        extra = [c for c in self._uses if c not in columns]
        return self._kept(self._base.orders(*columns, *extra)).select(*columns)

    def _kept(self, lines: DataFrame) -> DataFrame:
        if isinstance(self._condition, DataFrame):
            return lines.join(self._condition, list(self._uses), "left_semi")
        return lines.where(self._condition)
