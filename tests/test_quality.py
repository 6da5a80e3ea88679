from builders import incident, one, order, rows, supplier, tables

from spendgrain.operators import quality


def report(spark):
    orders = [order("P1", "S1", 1, 1), order("P1", "S1", 1, 1), order("P1", "S1", 1, 1), order("P2", "S9", 1, 1, None)]
    orders.append(order("P3", None, 2, 2, material_id="M9"))
    incidents = [incident("Q1", "P1", "S1", 1), incident("Q2", None, "S1", 1), incident("Q3", "P7", "S1", 1)]
    materials = [{"material_id": "M1", "material_name": "Bottle", "category": "Packaging"}]
    return tables(spark, [supplier("S1"), supplier("S2", country=None)], orders, incidents, materials)


def test_counts(spark):
    t = report(spark)
    assert {r["dataset"]: r["row_count"] for r in rows(quality.row_counts(t))} == {
        "suppliers": 2, "materials": 1, "purchase_orders": 5, "quality_incidents": 3,
    }
    # Every line lacks its dollar amount, two lack a date or a supplier.
    assert {r["dataset"]: r["null_cells"] for r in rows(quality.null_cells(t))} == {
        "suppliers": 1, "materials": 3, "purchase_orders": 5 + 2, "quality_incidents": 1,
    }
    assert {r["dataset"]: r["duplicate_rows"] for r in rows(quality.duplicate_rows(t))} == {
        "suppliers": 0, "materials": 0, "purchase_orders": 2, "quality_incidents": 0,
    }


def test_unmapped_keys_count_rows_and_nulls(spark):
    found = {r["check"]: r["unmapped"] for r in rows(quality.unmapped_keys(report(spark)))}
    assert found == {
        "unmapped_supplier_ids": 2, "unmapped_material_ids": 1, "quality_incidents_without_po": 2,
        "incidents_with_ambiguous_supplier": 0,
    }


def test_duplicates_are_seen_before_rows_are_merged(spark):
    suppliers = [supplier("S1"), supplier("S1"), supplier("S1", country=None)]
    t = tables(spark, suppliers, [order("P1", "S1", 1, 1), order("P1", "S2", 1, 1)], [incident("Q", "P1", None, 1)])
    assert {r["dataset"]: r["duplicate_keys"] for r in rows(quality.duplicate_keys(t))} == {
        "suppliers": 2, "materials": 0, "quality_incidents": 0,
    }
    assert {r["dataset"]: r["duplicate_rows"] for r in rows(quality.duplicate_rows(t))}["suppliers"] == 1
    found = {r["check"]: r["unmapped"] for r in rows(quality.unmapped_keys(t))}
    assert found["incidents_with_ambiguous_supplier"] == 1


def test_report_is_long(spark):
    found = rows(quality.quality_report(report(spark)))
    assert len(found) == 4 * 3 + 3 + 4
    assert {r["check"] for r in found} >= {"row_counts", "null_cells", "duplicate_rows", "unmapped_supplier_ids"}


def test_empty_tables(spark):
    t = tables(spark)
    assert all(r["duplicate_rows"] == 0 for r in rows(quality.duplicate_rows(t)))
    assert all(r["unmapped"] == 0 for r in rows(quality.unmapped_keys(t)))
    assert one(t.orders().selectExpr("count(*) AS n"))["n"] == 0
