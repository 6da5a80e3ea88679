"""Properties every registered plan must keep."""

import datetime as dt
import re

import pytest

import __spark_entry__ as entry
from spendgrain.operators import sourcing, spend
from spendgrain.operators.summary import filtered_view
from spendgrain.sinks.writers import read_tables, write_tables
from spendgrain.sources.star import StarTables

FOLDER = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: physical(query(spark, FOLDER)) for name, query in entry._own_queries().items()}


def test_no_python_in_any_plan(plans):
    for name, plan in plans.items():
        assert not re.search(r"Python|Pandas|Arrow", plan), name


def test_no_cross_or_nested_loop_join(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_window_over_everything(plans):
    for name, plan in plans.items():
        for window in re.findall(r"\+- Window \[.*", plan):
            assert re.search(r"\], \[[a-z_]+#", window), (name, window[:300])


def test_no_whole_table_in_one_partition(plans):
    """Single-partition exchanges may only follow a partial aggregate."""
    for name, plan in plans.items():
        lines = plan.splitlines()
        for above, below in zip(lines, lines[1:], strict=False):
            if "Exchange SinglePartition" in above:
                assert "Aggregate" in below or "TakeOrdered" in below, (name, below[:200])


def test_scans_read_only_what_is_asked(spark):
    plan = physical(StarTables(spark, FOLDER).orders("category", "total_amount_ngn"))
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == ["l_partkey:bigint,l_extendedprice:double", "p_partkey:bigint,p_type:string"]


def test_unneeded_dimensions_are_not_joined(spark):
    assert "Join" not in physical(StarTables(spark, FOLDER).orders("supplier_id", "total_amount_ngn"))
    assert "Join" not in physical(StarTables(spark, FOLDER).suppliers("supplier_id", "risk_level"))


def test_month_filter_prunes_files(spark, tmp_path):
    write_tables(StarTables(spark, FOLDER), str(tmp_path))
    plan = physical(read_tables(spark, str(tmp_path)).orders("po_month", "category").where("po_month = '1996-03'"))
    assert re.search(r"PartitionFilters: \[.*po_month.* = 1996-03", plan)


def test_incident_filter_reaches_the_scan(spark):
    plan = physical(StarTables(spark, FOLDER).incidents())
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThanOrEqual(l_tax,0.08)" in plan


def test_top_n_needs_no_full_sort(spark):
    plan = physical(spend.supplier_concentration(StarTables(spark, FOLDER)))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_lines_are_shuffled_once_for_both_uses(spark, tmp_path):
    """Scores and the bounds they are measured against share the shuffle of the lines."""
    write_tables(StarTables(spark, FOLDER), str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    for query in (sourcing.supplier_optimization, sourcing.constrained_sourcing):
        result = query(stored)
        result.collect()
        final = physical(result).split("Initial Plan")[0]
        assert len(re.findall(r"FileScan parquet \[po_number[^\]]*quantity", final)) == 1


def test_group_limits_run_before_the_shuffle(spark):
    star = StarTables(spark, FOLDER)
    for query, limits in ((sourcing.constrained_sourcing, 2), (sourcing.supplier_optimization, 1)):
        assert len(re.findall(r"WindowGroupLimit .* Partial", physical(query(star)))) == limits


def test_same_rows_without_any_broadcast(spark):
    """The plans must also be right when no side is small enough to broadcast."""
    names = ("supplier_concentration", "constrained_sourcing", "price_distribution", "normalized_incidents", "dq_unmapped")
    queries = entry._own_queries()
    expected = {n: sorted(map(str, queries[n](spark, FOLDER).collect())) for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            assert sorted(map(str, queries[n](spark, FOLDER).collect())) == expected[n], n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_filtered_view_reads_the_months_of_its_range_only(spark, tmp_path):
    write_tables(StarTables(spark, FOLDER), str(tmp_path))
    view = filtered_view(read_tables(spark, str(tmp_path)), (), dt.date(1996, 1, 15), dt.date(1996, 3, 2))
    plan = physical(view.orders("category", "total_amount_ngn"))
    assert re.search(r"PartitionFilters: \[[^]]*po_month[^]]*>= 1996-01[^]]*po_month[^]]*<= 1996-03", plan)
    assert "po_month" not in view.orders("category").columns
