"""Malformed CSV rows, days in other spellings, and cells that cannot be read."""

import pytest
from builders import rows
from pyspark.sql import functions as F

from spendgrain.model import SchemaError
from spendgrain.plans.pipeline import run_batch
from spendgrain.sources.normalize import clean_table, infer_date_formats, unreadable_cells
from spendgrain.sources.readers import load_landing, malformed_rows, quarantined, read_csv

RAGGED = 'a,b\n1,2\n3,4,5\n6\n"x, ""y""",7\n"p,q",8,"r,s"\n,\n'


def lay(folder, **files) -> str:
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_a_row_with_more_cells_stops_the_query(spark, tmp_path):
    path = f"{lay(tmp_path, t=RAGGED)}/t.csv"
    for columns in (["a", "b"], ["b"]):
        with pytest.raises(Exception, match="more than 2 cells"):
            read_csv(spark, path).select(*columns).collect()
    with pytest.raises(Exception, match="more than 2 cells"):
        read_csv(spark, path).count()
    with pytest.raises(ValueError, match="'ignore'"):
        read_csv(spark, path, malformed="ignore")


def test_short_rows_are_filled_as_before(spark, tmp_path):
    path = f"{lay(tmp_path, t='a,b,c\n1,2,3\n4\n5,6\n')}/t.csv"
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [("1", "2", "3"), ("4", None, None), ("5", "6", None)]


@pytest.mark.parametrize("multi_line", [False, True])
def test_quarantine(spark, tmp_path, multi_line):
    path = f"{lay(tmp_path, t=RAGGED)}/t.csv"
    kept = read_csv(spark, path, malformed="quarantine", multi_line=multi_line)
    assert sorted(map(str, kept.collect())) == sorted(["Row(a='1', b='2')", "Row(a='x, \"y\"', b='7')", "Row(a=None, b=None)"])
    assert kept.select("b").count() == kept.count() == 3
    found = malformed_rows(spark, path, multi_line=multi_line)
    assert sorted((r["cells"], r["expected"], r["record"].strip()) for r in found.collect()) == [(1, 2, "6"), (3, 2, '"p,q",8,"r,s"'), (3, 2, "3,4,5")]
    assert found.count() == 3 and found.select("cells").distinct().count() == 2
    assert all(r["file"].endswith("t.csv") for r in found.collect())


def test_clean_files_have_no_malformed_rows(spark, tmp_path):
    assert malformed_rows(spark, f"{lay(tmp_path, t='a,b\n1,2\n')}/t.csv").collect() == []
    assert quarantined(spark, str(tmp_path)).collect() == []


SPELLINGS = {
    "M/d/yyyy": ["01/31/2024", "2/3/2024"],
    "d/M/yyyy": ["31/01/2024", "03/02/2024"],
    "d.M.yyyy": ["31.01.2024", "3.2.2024"],
    "d-M-yyyy": ["31-01-2024", "3-2-2024"],
    "yyyy/M/d": ["2024/01/31", "2024/2/3"],
    "MMM d, yyyy": ["Jan 31, 2024", "Feb 3, 2024"],
    "MMMM d, yyyy": ["January 31, 2024", "February 3, 2024"],
    "d MMM yyyy": ["31 Jan 2024", "3 Feb 2024"],
}


def orders_with(spark, days, dtype="string"):
    data = [(f"P{i}", d, "S1", "M1", "1") for i, d in enumerate(days)]
    return spark.createDataFrame(data, f"po_number string, `Order Date` {dtype}, supplier_id string, material_id string, quantity string")


@pytest.mark.parametrize("pattern", SPELLINGS)
def test_spelling_by_evidence(spark, pattern):
    raw = orders_with(spark, [*SPELLINGS[pattern], "soon", None, "", "2024-05-06"])
    formats = infer_date_formats({"purchase_orders": raw})
    assert formats == {"purchase_orders": {"po_date": (pattern,)}}
    clean, _ = clean_table(raw, "purchase_orders", date_formats=formats)
    assert [str(r[0]) for r in clean.orderBy("po_number").select("po_date").collect()] == ["2024-01-31", "2024-02-03", "None", "None", "None", "2024-05-06"]
    cells = {r["column"]: (r["present"], r["unreadable"]) for r in unreadable_cells({"purchase_orders": raw}, formats).collect()}
    assert cells == {"po_date": (4, 1), "quantity": (6, 0)}


def test_ambiguous_days_are_refused(spark):
    with pytest.raises(SchemaError, match="purchase_orders.po_date can be read as M/d/yyyy or d/M/yyyy"):
        infer_date_formats({"purchase_orders": orders_with(spark, ["01/02/2024", "03/04/2024", None])})


def test_spellings_that_agree_are_not_ambiguous(spark):
    assert infer_date_formats({"purchase_orders": orders_with(spark, ["02/02/2024", "05/05/2024"])}) == {"purchase_orders": {"po_date": ("M/d/yyyy",)}}


def test_iso_days_and_junk_need_no_pattern(spark):
    assert infer_date_formats({"purchase_orders": orders_with(spark, ["2024-01-02", "soon", "2024-13-40", None])}) == {}
    assert infer_date_formats({"purchase_orders": orders_with(spark, [])}) == {}
    days = orders_with(spark, ["2024-01-02"]).withColumn("Order Date", F.col("Order Date").cast("date"))
    assert infer_date_formats({"purchase_orders": days, "suppliers": spark.range(1)}) == {}


SUPPLIERS = "vendor id,vendor name,approved\nS1,One,yes\nS2,Two,perhaps\n"
ITEMS = "sku,item name,lead time\nM1,Bolt,soon\n"


def test_parts_of_a_dataset_have_spellings_of_their_own(spark, tmp_path):
    folder = lay(
        tmp_path,
        suppliers=SUPPLIERS,
        items=ITEMS,
        po_a="po_id,order date,vendor id,sku,qty\n1,01/31/2024,S1,M1,2\n",
        po_b="po number,order date,vendor code,item code,qty\n2,31.01.2024,S1,M1,x\n",
    )
    orders = load_landing(spark, folder, date_formats=None)["purchase_orders"]
    assert {str(r["po_date"]) for r in orders.collect()} == {"2024-01-31"}


def test_batch_run_reports_what_it_could_not_read(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    lay(
        landing,
        suppliers=SUPPLIERS + "S3,Three,yes,extra\n",
        items=ITEMS,
        po_a="po_id,order date,vendor id,sku,qty\n1,01/31/2024,S1,M1,2\n3,later,S1,M1,1\n",
        po_b="po number,order date,vendor code,item code,qty\n2,31.01.2024,S1,M1,x\n4,2024-02-01\n",
    )
    with pytest.raises(Exception, match="more than 3 cells"):
        run_batch(spark, str(landing), f"{tmp_path}/failed")
    stored = run_batch(spark, str(landing), f"{tmp_path}/out", malformed="quarantine")
    assert sorted((r["po_number"], str(r["po_date"])) for r in stored.orders().collect()) == [("1", "2024-01-31"), ("2", "2024-01-31"), ("3", "None")]
    assert sorted((r["dataset"], r["record"]) for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()) == [("purchase_orders", "4,2024-02-01"), ("suppliers", "S3,Three,yes,extra")]
    cells = {(r["dataset"], r["column"]): r["unreadable"] for r in rows(spark.read.json(f"{tmp_path}/out/unreadable_cells_json"))}
    assert cells == {("suppliers", "is_approved"): 1, ("materials", "lead_time_days"): 1, ("purchase_orders", "po_date"): 1, ("purchase_orders", "quantity"): 1}
