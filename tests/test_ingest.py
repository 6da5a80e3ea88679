import datetime as dt
import os
from decimal import Decimal
from pathlib import Path

import pytest
from builders import one, rows

from spendgrain.model import DATASETS, SchemaError
from spendgrain.operators import quality
from spendgrain.sources.normalize import clean_table, normalize, rename_columns, unique_by
from spendgrain.sources.readers import load_folder, load_landing, read_csv, route_dataset


def text_frame(spark, header: str, *lines: tuple):
    names = header.split(",")
    return spark.createDataFrame([tuple(line) for line in lines], ", ".join(f"`{n}` string" for n in names))


@pytest.fixture()
def foreign(spark):
    return {
        "suppliers": text_frame(
            spark, "vendor_id,vendor_name,supplier_category,country_name", ("SUP1", "Acme Supplies", "Packaging", "Nigeria")
        ),
        "materials": text_frame(
            spark, "item_code,item_name,material_category,std_price", ("MAT1", "Bottle", "Packaging", "1250")
        ),
        "purchase_orders": text_frame(
            spark,
            "purchase_order_number,order_date,vendor_id,item_code,qty,unit_price,invoice_currency",
            ("PO1", "2025-01-01", "SUP1", "MAT1", "100", "1300", "ngn"),
        ),
    }


def test_foreign_headers(foreign):
    t, renames = normalize(foreign)
    found = one(t.orders())
    assert found["total_amount_ngn"] == Decimal("130000.00")
    assert (found["supplier_name"], found["material_name"], found["category"]) == ("Acme Supplies", "Bottle", "Packaging")
    assert found["expected_delivery_date"] == dt.date(2025, 1, 31)
    assert (found["currency"], found["delivery_status"], found["buyer"]) == ("NGN", "Delivered", "Unassigned")
    assert renames["suppliers"]["vendor_id"] == "supplier_id"
    assert renames["quality_incidents"] == {}
    found = one(t.suppliers())
    assert (found["payment_terms"], found["quality_rating"], found["is_approved"]) == ("Net 30", 4.0, True)


def test_canonical_types(foreign):
    t, _ = normalize(foreign)
    for name, frame in t.frames().items():
        assert dict(frame.dtypes) == {c: k.simpleString() for c, k in DATASETS[name].types.items()}


def test_missing_incidents_give_an_empty_table(foreign):
    t, _ = normalize(foreign)
    assert t.incidents().columns == DATASETS["quality_incidents"].columns
    assert t.incidents().count() == 0


def test_missing_dataset(foreign):
    del foreign["materials"]
    with pytest.raises(SchemaError, match="Missing required dataset: materials"):
        normalize(foreign)


def test_missing_column(foreign):
    foreign["purchase_orders"] = foreign["purchase_orders"].drop("vendor_id")
    with pytest.raises(SchemaError, match="missing required columns after normalization: supplier_id"):
        normalize(foreign)


def test_first_listed_header_wins_and_others_stay(spark):
    df = text_frame(spark, "vendor_id,Supplier ID,note", ("V", "S", "n"))
    renamed, renames = rename_columns(df, "suppliers")
    assert renames == {"Supplier ID": "supplier_id"}
    assert one(renamed) == {"vendor_id": "V", "supplier_id": "S", "note": "n"}


def test_extra_columns_on_request(spark):
    df = text_frame(spark, "supplier_id,supplier_name,cost centre", ("S", "N", "42"))
    assert "cost centre" not in clean_table(df, "suppliers")[0].columns
    assert one(clean_table(df, "suppliers", keep_extra=True)[0])["cost centre"] == "42"


def test_dirty_cells(spark):
    suppliers = text_frame(
        spark,
        "supplier_id,supplier_name,is_approved,risk_level,quality_rating",
        ("S1", "One", "Rejected", "", "n/a"),
        ("S2", "Two", "maybe", "HIGH", "3.5"),
        ("S3", "Three", None, None, None),
        ("S1", "One again", "yes", "low", "1"),
    )
    materials = text_frame(
        spark, "material_id,material_name,standard_price_ngn,lead_time_days", ("M1", "Cap", "free", "12.9"), ("M2", "Lid", "1.005", "soon")
    )
    orders = text_frame(
        spark,
        "po_number,po_date,supplier_id,material_id,quantity,unit_price_ngn,total_amount_ngn,category",
        ("P1", "2024-13-40", "S1", "M1", "abc", "5", None, ""),
        ("P2", "2024-01-31", "S9", "M9", "2", "1.5", None, None),
        ("P3", "2024-02-01", "S2", "M2", "2", "bad", "7.77", "Own"),
    )
    incidents = text_frame(
        spark, "po_number,supplier_id,severity,cost_impact_ngn", ("P1", None, "HIGH", "x"), (None, "S2", None, "10.5")
    )
    t, _ = normalize(
        {"suppliers": suppliers, "materials": materials, "purchase_orders": orders, "quality_incidents": incidents}
    )
    by_id = {r["supplier_id"]: r for r in rows(t.suppliers())}
    assert len(by_id) == 3
    assert (by_id["S1"]["supplier_name"], by_id["S1"]["is_approved"], by_id["S1"]["risk_level"]) == ("One", False, "Medium")
    assert (by_id["S2"]["is_approved"], by_id["S2"]["risk_level"], by_id["S2"]["quality_rating"]) == (True, "High", 3.5)
    assert (by_id["S3"]["is_approved"], by_id["S3"]["risk_level"], by_id["S3"]["quality_rating"]) == (True, "Medium", 4.0)
    prices = {r["material_id"]: (r["standard_price_ngn"], r["lead_time_days"]) for r in rows(t.materials())}
    assert prices == {"M1": (Decimal("0.00"), 12), "M2": (Decimal("1.01"), 30)}
    lines = {r["po_number"]: r for r in rows(t.orders())}
    assert (lines["P1"]["po_date"], lines["P1"]["quantity"], lines["P1"]["total_amount_ngn"]) == (None, 0, 0)
    assert lines["P1"]["category"] == "Unclassified"  # the material's own default
    assert (lines["P2"]["supplier_name"], lines["P2"]["category"]) == (None, "Unclassified")
    assert lines["P2"]["total_amount_ngn"] == Decimal("3.00")
    assert (lines["P3"]["unit_price_ngn"], lines["P3"]["total_amount_ngn"]) == (Decimal("0.00"), Decimal("7.77"))
    assert lines["P3"]["category"] == "Own"
    faults = sorted(rows(t.incidents()), key=lambda r: r["incident_id"])
    assert all(r["incident_id"].startswith("QI") for r in faults)
    assert len({r["incident_id"] for r in faults}) == 2
    by_supplier = {r["supplier_id"]: r for r in faults}
    assert (by_supplier["S1"]["severity"], by_supplier["S1"]["cost_impact_ngn"]) == ("High", 0)
    assert (by_supplier["S2"]["severity"], by_supplier["S2"]["cost_impact_ngn"]) == ("Medium", Decimal("10.50"))
    unmapped = {r["check"]: r["unmapped"] for r in rows(quality.unmapped_keys(t))}
    assert unmapped == {
        "unmapped_supplier_ids": 1, "unmapped_material_ids": 1, "quality_incidents_without_po": 1,
        "incidents_with_ambiguous_supplier": 0,
    }


def test_incident_numbers_start_at_one_and_yield_to_given_ids(spark, foreign):
    foreign["quality_incidents"] = text_frame(spark, "po_number,cost_impact_ngn", ("PO1", "1"), ("PO1", "2")).coalesce(1)
    t, _ = normalize(foreign)
    assert sorted(r["incident_id"] for r in rows(t.incidents())) == ["QI00001", "QI00002"]
    assert {r["supplier_id"] for r in rows(t.incidents())} == {"SUP1"}
    foreign["quality_incidents"] = text_frame(spark, "issue_id,po_number", ("A", "PO1"), (None, "PO1"))
    t, _ = normalize(foreign)
    assert {r["incident_id"] for r in rows(t.incidents())} == {"A", None}


def test_known_suppliers_of_incidents_do_not_multiply(spark, foreign):
    """An incident without a supplier takes the only supplier of its order, or stays without one."""
    foreign["purchase_orders"] = text_frame(
        spark, "po_number,po_date,supplier_id,material_id,quantity",
        ("PO1", "2025-01-01", "SUP1", "MAT1", "1"), ("PO1", "2025-01-01", "SUP2", "MAT1", "1"),
        ("PO2", "2025-01-01", "SUP2", "MAT1", "1"), ("PO2", "2025-01-01", "SUP2", "MAT1", "2"),
    )
    foreign["quality_incidents"] = text_frame(
        spark, "incident_id,po_number,supplier_id", ("A", "PO1", "SUP1"), ("B", "PO1", None), ("C", "PO2", None)
    )
    t, _ = normalize(foreign)
    pairs = sorted((r["incident_id"], r["supplier_id"]) for r in rows(t.incidents()))
    assert pairs == [("A", "SUP1"), ("B", None), ("C", "SUP2")]


def test_unique_by_keeps_one_whole_row(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 9), ("j", "z", 0)], "id string, x string, y int")
    assert sorted(map(tuple, unique_by(df.repartition(3), "id").collect())) == [("j", "z", 0), ("k", "a", 9)]


def test_unique_by_prefers_the_fullest_row(spark):
    df = spark.createDataFrame([("1", None), ("1", "Acme"), ("1", "Zeta")], "id string, x string")
    assert [tuple(r) for r in unique_by(df, "id").collect()] == [("1", "Acme")]


def test_incident_numbers_do_not_depend_on_splits(spark, foreign):
    cells = [("PO1", str(i % 7)) for i in range(40)]
    found = []
    for parts in (1, 5):
        foreign["quality_incidents"] = text_frame(spark, "po_number,cost_impact_ngn", *cells).repartition(parts)
        found.append(sorted((r["incident_id"], r["cost_impact_ngn"]) for r in rows(normalize(foreign)[0].incidents())))
    assert found[0] == found[1]
    assert [i for i, _ in found[0]] == [f"QI{i:05d}" for i in range(1, 41)]


def test_amounts_beyond_the_money_type_become_null(spark, foreign):
    foreign["purchase_orders"] = text_frame(
        spark, "po_number,po_date,supplier_id,material_id,quantity,unit_price_ngn",
        ("PO1", "2025-01-01", "SUP1", "MAT1", "999999999999999", "9999999999999999"),
    )
    assert one(normalize(foreign)[0].orders())["total_amount_ngn"] is None


@pytest.mark.parametrize(
    ("name", "dataset"),
    [
        ("vendor_master_extract.csv", "suppliers"),
        ("PO_LINES_2025.csv", "purchase_orders"),
        ("item_master.csv", "materials"),
        ("non_conformance_log.csv", "quality_incidents"),
        ("accounts_receivable.csv", None),
        ("suppliers.csv", "suppliers"),
        ("purchase_order_items.csv", "purchase_orders"),
        ("monthly report.csv", None),
        ("Quality-Incidents.parquet", "quality_incidents"),
    ],
)
def test_routing(name, dataset):
    assert route_dataset(name) == dataset


def write(path, text: str) -> None:
    path.write_text(text, encoding="utf-8")


def test_csv_cells_that_mean_missing(spark, tmp_path):
    write(tmp_path / "a.csv", 'id,name,note\n1,NA,"said ""hi"", twice"\n2,,null\n')
    found = rows(read_csv(spark, str(tmp_path / "a.csv")))
    assert found == [
        {"id": "1", "name": None, "note": 'said "hi", twice'},
        {"id": "2", "name": None, "note": None},
    ]


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    write(tmp_path / "materials.csv", 'material_id,material_name\nm1,"two\nlines"\n')
    found = load_folder(spark, str(tmp_path), multi_line=True)["materials"]
    assert rows(found) == [{"material_id": "m1", "material_name": "two\nlines"}]


def test_relative_folders(spark, tmp_path, monkeypatch):
    home = Path.cwd()
    write(tmp_path / "suppliers.csv", "supplier_id,supplier_name\nS1,One\n")
    relative = os.path.relpath(tmp_path, home)
    assert set(load_folder(spark, relative)) == set(load_landing(spark, relative)) == {"suppliers"}


def test_parts_of_a_dataset_are_cleaned_before_the_union(spark, tmp_path):
    write(tmp_path / "po_a.csv", "po_number,po_date,supplier_id,material_id,quantity,buyer\nP1,2025-01-01,S1,M1,abc,Ann\n")
    write(tmp_path / "po_b.csv", "po_number,po_date,supplier_id,material_id,quantity\nP2,2025-01-02,S1,M1,4\n")
    spark.createDataFrame([("P3", "01/31/2024", "S1", "M1", 2.5)], "po_number string, po_date string, supplier_id string, material_id string, quantity double").write.parquet(str(tmp_path / "po_c.parquet"))
    found = {r["po_number"]: r for r in rows(load_landing(spark, str(tmp_path), date_formats=("MM/dd/yyyy",))["purchase_orders"])}
    assert [found[p]["buyer"] for p in ("P1", "P2", "P3")] == ["Ann", "Unassigned", "Unassigned"]
    assert found["P1"]["quantity"] is None and float(found["P3"]["quantity"]) == 2.5
    assert str(found["P3"]["po_date"]) == "2024-01-31"
    write(tmp_path / "po_d.csv", "po_number,po_date,material_id,quantity\nP4,2025-01-02,M1,4\n")
    with pytest.raises(SchemaError, match="supplier_id"):
        load_landing(spark, str(tmp_path))


def test_folder_with_some_datasets(spark, tmp_path):
    write(tmp_path / "suppliers.csv", "supplier_id,supplier_name\nS1,One\n")
    spark.createDataFrame([("M1", "Cap")], "material_id string, material_name string").write.parquet(
        str(tmp_path / "materials.parquet")
    )
    write(tmp_path / "other.csv", "a\n1\n")
    found = load_folder(spark, str(tmp_path))
    assert set(found) == {"suppliers", "materials"}
    assert one(found["materials"]) == {"material_id": "M1", "material_name": "Cap"}


def test_folder_without_datasets(spark, tmp_path):
    write(tmp_path / "other.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError):
        load_folder(spark, str(tmp_path))
    with pytest.raises(SchemaError, match="No supported files"):
        load_landing(spark, str(tmp_path))


def test_landing_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "vendor_a.csv", "vendor_id,vendor_name\nS1,One\n")
    write(tmp_path / "vendor_b.csv", "vendor_id,vendor_name\nS2,Two\n")
    write(tmp_path / "supplier_c.csv", "Supplier Name,Supplier ID\nThree,S3\n")
    found = load_landing(spark, str(tmp_path))
    clean, _ = clean_table(found["suppliers"], "suppliers")
    assert sorted((r["supplier_id"], r["supplier_name"]) for r in rows(clean)) == [
        ("S1", "One"),
        ("S2", "Two"),
        ("S3", "Three"),
    ]
