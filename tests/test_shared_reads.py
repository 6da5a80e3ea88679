"""What is moved and how often lines are read: duplicates by digest, bounded buyers, lines read once."""

import re

from builders import one, order, rows, supplier, tables
from pyspark.sql import functions as F

from spendgrain.operators import quality, risk, summary
from spendgrain.plans.shared import read_once
from spendgrain.sources.star import StarTables

FOLDER = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def duplicates(t, dataset="purchase_orders") -> int:
    return {r["dataset"]: r["duplicate_rows"] for r in rows(quality.duplicate_rows(t))}[dataset]


def test_duplicates(spark):
    same = [order("1", "S1", 1, 5)] * 4 + [order("1", "S1", 1, 6)] * 2 + [order("2", "S1", 1, 5), order("3", None, 1, 5, buyer=None)]
    shifted = [order("4", "S1", 1, 5, buyer=None, plant_location="Buyer"), order("4", "S1", 1, 5, buyer="Buyer", plant_location=None)]
    assert duplicates(tables(spark, [supplier("S1"), supplier("S1")], same + shifted)) == 4
    assert duplicates(tables(spark, [supplier("S1"), supplier("S1")], same), "suppliers") == 1
    assert duplicates(tables(spark, [supplier("S1")])) == 0


def test_only_suspected_rows_are_moved_whole(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    df = df.unionByName(df.where("id < 3") if "id" in df.columns else df.where("a IN ('0', '1', '2')"))
    found = quality.suspected_copies(df)
    assert sorted(r["a"] for r in found.collect()) == ["0", "0", "1", "1", "2", "2"]
    assert "Exchange hashpartitioning" not in physical(found)


def test_unlucky_digests_do_not_count(spark, monkeypatch):
    """Rows that only share a digest are compared whole."""
    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: real(F.lit(0)))
    assert duplicates(tables(spark, [supplier("S1")], [order(str(i), "S1", 1, 5) for i in range(20)] + [order("3", "S1", 1, 5)])) == 1


def test_top_buyers(spark):
    vendors = [supplier("S1", risk_level="High"), supplier("S2", is_approved=False), supplier("S3")]
    spent = {"ann": 50, "bob": 70, "cat": 70, "dan": 5, "eve": 1}
    orders = [order(f"{b}{i}", "S1", 1, x / 2, buyer=b) for b, x in spent.items() for i in range(2)]
    orders += [order("n", "S1", 1, 1000, buyer=None), order("x", "S2", 1, 3, buyer=None), order("y", "S3", 1, 9)]
    found = {r["supplier_name"]: r for r in rows(risk.maverick_top_buyers(tables(spark, vendors, orders), limit=3))}
    assert set(found) == {"Supplier S1", "Supplier S2"}
    own = found["Supplier S1"]
    assert (own["top_buyers"], own["other_buyers"], own["other_spend"], own["order_count"], own["total_spend"]) == ("bob,cat,ann", 2, 6.0, 11, 1196.0)
    other = found["Supplier S2"]
    assert (other["top_buyers"], other["other_buyers"], other["other_spend"]) == ("", 0, 0.0)


def test_buyers_are_cut_before_they_are_moved(spark):
    plan = physical(risk.maverick_top_buyers(StarTables(spark, FOLDER)))
    assert "collect_set" not in plan and re.search(r"WindowGroupLimit .* Partial", plan)


def test_summary_reads_its_lines_once(spark, tmp_path):
    star = StarTables(spark, FOLDER)
    once = read_once(star)
    result = summary.insights_summary(once)
    assert rows(result) == rows(summary.insights_summary(star))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan
    assert one(result.where("metric = 'Total Spend'"))["value"] > 0
