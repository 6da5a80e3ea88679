"""Tasks of bounded size, and rows that are joined once however often they are used."""

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import functions as F

from spendgrain.operators import quality, summary
from spendgrain.plans import marts, partials
from spendgrain.session import TASK_BYTES, bounded_tasks
from spendgrain.sinks.writers import write_marts
from spendgrain.sources.normalize import infer_date_formats, normalize
from spendgrain.sources.readers import load_landing
from spendgrain.sources.star import STAR_SCHEMAS, StarTables
from spendgrain.tables import Tables


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def small_star(spark, folder) -> str:
    """Three lines of two orders, the last of them without an order."""
    day = dt.datetime(1996, 1, 20)
    found = {
        "region": [(1, "AFRICA")],
        "nation": [(1, "KENYA", 1)],
        "customer": [(1, "C1", 1, 1.0, "AUTO")],
        "supplier": [(1, "S1", 1, 10.0), (2, "S2", 1, 6000.0)],
        "part": [(1, "bolt", "B", "PROMO", 3, 2.0)],
        "orders": [(1, 1, "F", 30.0, day, "1")],
        "lineitem": [(o, 1, s, 1, 2.0, x, 0.1, 0.0, "N", "F", day) for o, s, x in ((1, 1, 20.0), (1, 2, 10.0), (2, 1, 5.0))],
    }
    for name, given in found.items():
        spark.createDataFrame(given, STAR_SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def raw(spark, lines):
    orders = "po_number string, po_date string, supplier_id string, material_id string, quantity string"
    return {
        "suppliers": spark.createDataFrame([("S1", "One")], "supplier_id string, supplier_name string"),
        "materials": spark.createDataFrame([("M1", "Bolt")], "material_id string, material_name string"),
        "purchase_orders": spark.createDataFrame(lines, orders),
    }


def test_tasks_stay_small_unless_the_session_says_otherwise(spark):
    key, parts = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    plain, own = spark.newSession(), spark.newSession()
    plain.conf.set("spark.sql.shuffle.partitions", "200")
    own.conf.set(key, "1000000")
    own.conf.set(parts, "7")
    for session in (plain, own):
        bounded_tasks(session)
    assert plain.conf.get(key) == f"{TASK_BYTES}b" and int(plain.conf.get(parts)) > 200
    assert own.conf.get(key) == "1000000" and own.conf.get(parts) == "7"


def test_copies_are_looked_for_in_rows_that_were_computed_once(spark):
    df = spark.range(6).select((F.col("id") % 4).cast("string").alias("a"), F.lit(None).alias("nothing"))
    found = quality.suspected_copies(df)
    assert sorted(r["a"] for r in found.collect()) == ["0", "0", "1", "1"]
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"rows", "repeated"}


def test_every_spelling_of_a_day_is_tried_once(spark, monkeypatch):
    frame = raw(spark, [("P", d, "S1", "M1", "1") for d in ("1/20/2024", "1/20/2024", "2/3/2024", None, "2024-01-02")])
    kind = type(frame["purchase_orders"])
    counted, grouped = [], kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda df, *c: (counted.append(c), grouped(df, *c))[1])
    assert infer_date_formats(frame) == {"purchase_orders": {"po_date": ("M/d/yyyy",)}}
    assert ("column", "cell") in counted


def test_small_dimensions_do_not_move_the_lines(spark):
    orders = normalize(raw(spark, [("P", "2024-01-02", "S1", "M1", "2"), ("Q", None, "S9", None, "1")]))[0].orders()
    plan = physical(orders)
    assert "vendors-" in plan and "items-" in plan and "SortMergeJoin" not in plan
    assert {(r["po_number"], r["supplier_name"], r["material_name"]) for r in orders.collect()} == {("P", "One", "Bolt"), ("Q", None, None)}


def test_filtered_figures_join_their_lines_once(spark, tmp_path):
    star = StarTables(spark, small_star(spark, tmp_path))
    found = summary.filtered_kpis(star, ("PROMO",), dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    assert "o_orderdate" not in physical(found)
    row = found.first()
    assert (row["filtered_total_spend"], row["filtered_maverick_spend"], row["filtered_supplier_count"]) == (30.0, 20.0, 2)


def test_edges_of_a_range_are_kept(spark, tmp_path):
    star = StarTables(spark, small_star(spark, tmp_path / "star"))
    partials.write_partials(star, str(tmp_path / "partials"))
    span = (dt.date(1996, 1, 15), dt.date(1996, 2, 29))
    kept = partials.partial_view(star, str(tmp_path / "partials"), ("PROMO",), *span, keep_edges=True)
    assert "o_orderdate" not in physical(kept)
    lazy = partials.partial_view(star, str(tmp_path / "partials"), ("PROMO",), *span)
    assert sorted(map(str, kept.drop("orders").collect())) == sorted(map(str, lazy.drop("orders").collect())) != []


def test_lines_are_cut_by_small_dimensions_before_orders_are_joined(spark, tmp_path):
    star = StarTables(spark, small_star(spark, tmp_path))
    plan = star.orders("po_date", "category")._jdf.queryExecution().analyzed().toString()
    assert plan.index("o_orderkey") < plan.index("p_partkey")


def test_lines_move_to_orders_before_they_get_names(spark, tmp_path):
    star = StarTables(spark, small_star(spark, tmp_path), whole=True)
    plan = star.orders("po_date", "material_name", "supplier_name")._jdf.queryExecution().analyzed().toString()
    assert plan.index("s_suppkey") < plan.index("p_partkey") < plan.index("o_orderkey")
    plain = StarTables(spark, str(tmp_path)).orders()
    assert sorted(map(str, star.orders().collect())) == sorted(map(str, plain.collect()))


def sums_by(plan: str, *keys: str) -> list[str]:
    """The aggregates of a plan that add something up by all of these keys, and others."""
    found = re.findall(r"HashAggregate\(keys=\[(.*?)\], functions=\[(.*?)\]", plan)
    return [names for names, sums in found if sums and all(re.search(rf"\b{k}#", names) for k in keys)]


def odd_tables(spark) -> Tables:
    """Orders that come in several lines, with nulls in every key; incidents of two orders of one supplier."""
    day = dt.date(2024, 1, 2)
    rows = [
        ("A", 1, "S1", "bolt", "P1", 1), ("A", 1, "S1", "bolt", "P1", 2), ("A", 1, "S1", "nut", "P2", 3), ("A", 1, None, "nut", "P1", 4),
        ("A", 1, "S1", None, None, 5), ("A", None, None, "bolt", "P3", 6), (None, 1, "S1", "bolt", "P1", 7), ("B", 2, "S2", None, None, 8),
    ]
    found = [(c, s, n, m, p, Decimal(q), Decimal(q), Decimal(10 * q), day, day, day) for c, s, n, m, p, q in rows]
    orders = (
        "category string, supplier_id int, supplier_name string, material_name string, po_number string, quantity decimal(18,3), "
        "unit_price_ngn decimal(18,2), total_amount_ngn decimal(18,2), po_date date, actual_delivery_date date, expected_delivery_date date"
    )
    suppliers = [(k, f"S{k}", "R", "C", "Low", 4.0) for k in (1, 2)]
    incidents = [("I1", "P1", 1, Decimal(5)), ("I2", "P1", 1, Decimal(6)), ("I3", "P2", 1, Decimal(7)), ("I4", None, 1, Decimal(9))]
    return Tables(
        spark.createDataFrame(suppliers, "supplier_id int, supplier_name string, category string, country string, risk_level string, quality_rating double"),
        spark.createDataFrame([], "material_id int"),
        spark.createDataFrame(found, orders),
        spark.createDataFrame(incidents, "incident_id string, po_number string, supplier_id int, cost_impact_ngn decimal(18,2)"),
    )


def test_sums_do_not_travel_with_what_is_counted(spark):
    t = odd_tables(spark)
    assert not sums_by(physical(marts.supplier_orders(t)), "po_number")
    assert not sums_by(physical(marts.price_stats(t)), "supplier_id")
    lines = physical(marts.supplier_category(t))
    assert re.search(r"Exchange hashpartitioning\(po_number#\d+, supplier_id#\d+, \d+\), REPARTITION_BY_COL", lines)
    assert not re.search(r"Exchange hashpartitioning\(category#\d+, supplier_id#\d+, supplier_name#\d+, po_number", lines)
    assert not sums_by(physical(marts.category_month(t)), "po_number", "supplier_id")


def test_counts_and_sums_meet_again_with_nulls_and_repeats(spark):
    t = odd_tables(spark)
    rows = {(r["category"], r["supplier_id"], r["supplier_name"]): r for r in marts.supplier_category(t).collect()}
    shown = ("total_quantity", "total_spend_ngn", "quality_incident_count", "total_quality_cost_ngn", "total_orders")
    assert {k: tuple(r[c] for c in shown) for k, r in rows.items()} == {
        ("A", 1, "S1"): (11.0, 110.0, 3, 18.0, 2),
        ("A", 1, None): (4.0, 40.0, 2, 11.0, 1),
        ("B", 2, "S2"): (8.0, 80.0, 0, 0.0, 0),
    }
    found = {r["supplier_id"]: (r["total_orders"], r["order_rows"], r["spend"], r["on_time"]) for r in marts.supplier_orders(t).collect()}
    assert found == {1: (2, 6, 220, 6), 2: (0, 1, 80, 1), None: (1, 1, 60, 1)}
    found = {(r["material_name"], r["category"]): (r["supplier_count"], r["min_price"], r["max_price"]) for r in marts.price_stats(t).collect()}
    assert found == {("bolt", "A"): (1, 1.0, 6.0), ("nut", "A"): (1, 3.0, 4.0), (None, "A"): (1, 5.0, 5.0), ("bolt", None): (1, 7.0, 7.0), (None, "B"): (1, 8.0, 8.0)}
    found = {r["category"]: (r["total_orders"], r["total_spend_ngn"], r["unique_suppliers"]) for r in marts.category_month(t).collect()}
    assert found == {"A": (3, 210.0, 1), None: (1, 70.0, 1), "B": (0, 80.0, 1)}


def test_lines_move_once_to_where_their_partials_are_stored(spark, tmp_path):
    t = odd_tables(spark)
    plan = physical(partials.month_partials(t))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    partials.write_partials(t, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    assert sorted((r["lines"], r["spend"]) for r in stored.collect()) == [(1, 30), (1, 40), (1, 50), (1, 60), (1, 70), (1, 80), (2, 30)]
    assert "part" not in stored.columns and len(stored.inputFiles()) <= partials.PARTS


def test_lines_move_to_materials_before_they_get_names_of_suppliers(spark):
    orders = normalize(raw(spark, [("P", "2024-01-02", "S1", "M1", "2"), ("Q", None, "S9", None, "1")]))[0].orders()
    plan = orders._jdf.queryExecution().optimizedPlan().toString()
    outer, inner = (part.split("\n")[0] for part in plan.split("Join LeftOuter")[1:])
    assert "supplier_id" in outer and "material_id" in inner


def test_landed_files_may_be_compressed(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("Vendor ID"), F.lit("a, b").alias("Vendor Name")).coalesce(1)
    write_marts({"vendors.csv": rows}, str(tmp_path), compression="gzip", maxRecordsPerFile=2)
    files = [f.name for f in (tmp_path / "vendors.csv").iterdir() if f.name.endswith(".csv.gz") and f.name.startswith("part")]
    assert len(files) == 3
    assert sorted(map(tuple, load_landing(spark, str(tmp_path))["suppliers"].collect())) == sorted(map(tuple, rows.collect()))
