"""Canonical view of an order/line-item star schema stored as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.session import bounded_tasks
from spendgrain.tables import Tables

# Columns of the star tables. Given schemas spare a look into the files.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def _cents(value: str) -> str:
    """A double as money, rounded half up."""
    return f"cast(floor({value} * 100 + 0.5) / 100 AS decimal(18,2))"


_CURRENCY = "CASE WHEN v_region = 'AFRICA' THEN 'NGN' ELSE 'USD' END"

# Canonical columns by the joins each needs and its expression.
_SUPPLIER_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "supplier_id": ((), "s_suppkey"),
    "supplier_name": ((), "s_name"),
    "category": (("v_nation", "v_region"), "v_region"),
    "country": (("v_nation",), "v_nation"),
    "payment_terms": (
        (),
        "CASE s_suppkey % 3 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'Net 45' ELSE 'Net 60' END",
    ),
    "currency": (("v_nation", "v_region"), _CURRENCY),
    "quality_rating": ((), "3.0D + (s_suppkey % 21) / 10.0D"),
    "is_approved": ((), "s_acctbal >= 0"),
    "risk_level": (
        (),
        "CASE WHEN s_acctbal < 1000 THEN 'High' WHEN s_acctbal < 5000 THEN 'Medium' ELSE 'Low' END",
    ),
}

_MATERIAL_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "material_id": ((), "p_partkey"),
    "material_name": ((), "p_name"),
    "category": ((), "p_type"),
    "unit_of_measure": (
        (),
        "CASE p_size % 4 WHEN 0 THEN 'PCS' WHEN 1 THEN 'KG' WHEN 2 THEN 'LTR' ELSE 'BOX' END",
    ),
    "standard_price_ngn": ((), "cast(p_retailprice AS decimal(18,2))"),
    "lead_time_days": ((), "p_size"),
}

_VENDOR_REGION = ("supplier", "v_nation", "v_region")

_ORDER_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "po_number": ((), "l_orderkey"),
    "po_date": (("orders",), "cast(o_orderdate AS date)"),
    "supplier_id": ((), "l_suppkey"),
    "supplier_name": (("supplier",), "s_name"),
    "material_id": ((), "l_partkey"),
    "material_name": (("part",), "p_name"),
    "category": (("part",), "p_type"),
    "quantity": ((), "cast(l_quantity AS decimal(18,3))"),
    "unit_price_ngn": ((), _cents("l_extendedprice / nullif(l_quantity, 0)")),
    "total_amount_ngn": ((), "cast(l_extendedprice AS decimal(18,2))"),
    "total_amount_usd": (
        _VENDOR_REGION,
        f"CASE WHEN {_CURRENCY} = 'USD' THEN {_cents('l_extendedprice / (800 + l_orderkey % 801)')} END",
    ),
    "currency": (_VENDOR_REGION, _CURRENCY),
    "expected_delivery_date": (("orders", "part"), "date_add(cast(o_orderdate AS date), p_size)"),
    "actual_delivery_date": ((), "CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS date) END"),
    "delivery_status": ((), "CASE WHEN l_linestatus = 'F' THEN 'Delivered' ELSE 'Pending' END"),
    "payment_status": (
        ("orders",),
        "CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Overdue' END",
    ),
    "buyer": (("orders", "customer"), "c_mktsegment"),
    "plant_location": (("orders", "customer", "c_nation", "c_region"), "c_region"),
}

_INCIDENT_COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "incident_id": ((), "concat_ws('-', 'QI', l_orderkey, l_partkey, l_suppkey)"),
    "po_number": ((), "l_orderkey"),
    "supplier_id": ((), "l_suppkey"),
    "incident_type": (
        (),
        "CASE l_linenumber % 3 WHEN 0 THEN 'Quality Defect' WHEN 1 THEN 'Contamination' ELSE 'Wrong Spec' END",
    ),
    "severity": (
        (),
        "CASE WHEN l_discount >= 0.07 THEN 'High' WHEN l_discount >= 0.03 THEN 'Medium' ELSE 'Low' END",
    ),
    "cost_impact_ngn": ((), _cents("l_extendedprice * l_discount")),
}

# Joins in the order they are made: the table, its columns, and the condition. Orders, the largest, come after the
# dimensions whose filters leave fewer lines to be moved to them.
_JOINS = {
    "part": ("part", ("*",), "l_partkey = p_partkey"),
    "supplier": ("supplier", ("*",), "l_suppkey = s_suppkey"),
    "v_nation": (
        "nation",
        ("n_nationkey AS v_nationkey", "n_name AS v_nation", "n_regionkey AS v_nation_region"),
        "s_nationkey = v_nationkey",
    ),
    "v_region": ("region", ("r_regionkey AS v_regionkey", "r_name AS v_region"), "v_nation_region = v_regionkey"),
    "orders": ("orders", ("*",), "l_orderkey = o_orderkey"),
    "customer": ("customer", ("*",), "o_custkey = c_custkey"),
    "c_nation": (
        "nation",
        ("n_nationkey AS c_nation_key", "n_regionkey AS c_nation_region"),
        "c_nationkey = c_nation_key",
    ),
    "c_region": ("region", ("r_regionkey AS c_regionkey", "r_name AS c_region"), "c_nation_region = c_regionkey"),
}


class StarTables(Tables):
    """Line items as order lines, joined only to the dimensions a query asks for.

    Every join is a left join on the dimension's key, so leaving one out
    never changes the rows. Dimensions are joined one table at a time: each
    is then judged by the size of its own files, and Spark broadcasts it
    only when that is below the configured threshold. With ``whole``, for
    questions that leave out no lines by a dimension, orders are joined first,
    while the lines that move to them hold no names yet.
    """

    def __init__(self, spark: SparkSession, folder: str, *, whole: bool = False) -> None:
        bounded_tasks(spark)
        self._joins = {"orders": _JOINS["orders"]} | _JOINS if whole else _JOINS
        self._session = spark
        self._folder = folder
        self._read: dict[str, DataFrame] = {}

    @property
    def spark(self) -> SparkSession:
        return self._session

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self._session.read.schema(STAR_SCHEMAS[name])
            self._read[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._read[name]

    def _view(self, base: DataFrame, expressions: dict[str, tuple[tuple[str, ...], str]], columns) -> DataFrame:
        names = columns or tuple(expressions)
        needed = {join for name in names for join in expressions[name][0]}
        for join, (table, shown, condition) in self._joins.items():
            if join in needed:
                base = base.join(self.table(table).selectExpr(*shown), F.expr(condition), "left")
        return base.selectExpr(*(f"{expressions[name][1]} AS {name}" for name in names))

    def suppliers(self, *columns: str) -> DataFrame:
        return self._view(self.table("supplier"), _SUPPLIER_COLUMNS, columns)

    def materials(self, *columns: str) -> DataFrame:
        return self._view(self.table("part"), _MATERIAL_COLUMNS, columns)

    def orders(self, *columns: str) -> DataFrame:
        return self._view(self.table("lineitem"), _ORDER_COLUMNS, columns)

    def incidents(self, *columns: str) -> DataFrame:
        returned = self.table("lineitem").where("l_returnflag = 'R' AND l_tax >= 0.08")
        return self._view(returned, _INCIDENT_COLUMNS, columns)
