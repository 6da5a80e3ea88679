import glob
import os
import random

import numpy as np
import pytest
from builders import one, order, rows, supplier, tables
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import connect, differences
from spendgrain.operators import distribution
from spendgrain.operators.distribution import PERCENTILES


def skewed_values() -> list[tuple[str, float]]:
    """One group with most rows, many equal values, a long tail and tiny groups."""
    rng = random.Random(5)
    values = [("hot", round(rng.lognormvariate(3, 2), 2)) for _ in range(3000)]
    values += [("hot", 7.0)] * 1500
    values += [(f"g{i % 40}", round(rng.random() * 100, 2)) for i in range(300)]
    values += [("single", 3.25), ("pair", 1.0), ("pair", 2.0), ("flat", 5.0), ("flat", 5.0), ("flat", 5.0)]
    rng.shuffle(values)
    return values


def test_exact_percentiles(spark):
    values = skewed_values()
    df = spark.createDataFrame(values, "g string, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    found = {r["g"]: r for r in rows(distribution.distribution(df.repartition(5), ["g"], "v"))}
    groups: dict[str, list[float]] = {}
    for g, v in values:
        groups.setdefault(g, []).append(v)
    assert set(found) == set(groups)
    for g, members in groups.items():
        assert found[g]["line_count"] == len(members)
        assert found[g]["mean"] == pytest.approx(np.mean(members), abs=1e-4)
        assert found[g]["stddev"] == pytest.approx(np.std(members), abs=1e-3)
        for name, p in PERCENTILES.items():
            assert found[g][name] == pytest.approx(np.percentile(members, p * 100), abs=1e-3), (g, name)


def test_null_values_are_left_out(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("b", None)], "g string, v double")
    df = df.withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert [(r["g"], r["line_count"]) for r in rows(distribution.distribution(df, ["g"], "v"))] == [("a", 1)]


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(3)
    orders = [
        order(f"P{i}", f"S{rng.randrange(5)}", rng.randrange(1, 9), round(5 + rng.random() * 20, 2),
              material_name="hot" if i % 3 else f"m{i % 5}", material_id=f"M{i % 7}")
        for i in range(400)
    ]
    orders.append(order("Q", "S1", 1, 50, material_name="one supplier only"))
    return tables(spark, [supplier(f"S{i}") for i in range(5)], orders)


def test_bootstrap_matches_a_direct_computation(market):
    """Savings per replicate, recomputed row by row from the weighted lines."""
    weighted = rows(distribution.resampled_lines(market, 12, 50))
    assert {r["material_name"] for r in weighted} == {"hot", *(f"m{i}" for i in range(5))}
    expected: dict[int, float] = {}
    cells: dict[tuple, list] = {}
    for r in weighted:
        cells.setdefault((r["replicate"], r["material_name"]), []).append(r)
    for (replicate, _), lines in cells.items():
        weight = sum(r["weight"] for r in lines)
        average = float(sum(r["weight"] * r["price"] for r in lines)) / weight
        spend = float(sum(r["weight"] * r["amount"] for r in lines))
        lowest = float(min(r["price"] for r in lines))
        expected[replicate] = expected.get(replicate, 0.0) + max(0.0, spend * (average - lowest) / average)
    found = {r["replicate"]: r["savings"] for r in rows(distribution.savings_replicates(market, 12, rows_per_part=50))}
    assert set(found) == set(expected) == set(range(12))
    for replicate, value in expected.items():
        assert found[replicate] == pytest.approx(value, abs=0.005 * 6)


def test_equal_lines_draw_for_themselves(spark):
    """Three equal lines do not share their weights; weights above 7 are possible."""
    orders = [order("P1", "S1", 1, 5)] * 3 + [order("P2", "S2", 1, 6)]
    found = rows(distribution.resampled_lines(tables(spark, [supplier("S1"), supplier("S2")], orders), 200, 50))
    per_replicate: dict[int, list[int]] = {}
    for r in found:
        if float(r["price"]) == 5:
            per_replicate.setdefault(r["replicate"], []).append(r["weight"])
    assert any(len(w) != 3 or len(set(w)) > 1 for w in per_replicate.values())
    total = sum(sum(w) for w in per_replicate.values())
    assert abs(total - 600) < 120
    assert len(distribution.POISSON) > 15


def test_bootstrap_does_not_depend_on_the_layout(market):
    small_parts = one(distribution.savings_bootstrap(market, 30, rows_per_part=20))
    whole = one(distribution.savings_bootstrap(market, 30))
    assert small_parts == pytest.approx(whole, rel=1e-9)


def test_bootstrap_interval_is_ordered(market):
    found = one(distribution.savings_bootstrap(market, 40))
    ordered = [found[name] for name in ("p05", "p25", "median", "p75", "p95")]
    assert ordered == sorted(ordered)
    assert found["interval_width"] == pytest.approx(found["p95"] - found["p05"], abs=0.011)


def test_weights_follow_the_poisson_law(spark):
    uniform = (F.col("id") + 0.5) / 100_000
    counts = {
        r["w"]: r["n"]
        for r in rows(
            spark.range(100_000).select(distribution._poisson(uniform).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        )
    }
    assert counts[0] == pytest.approx(36788, abs=2)
    assert counts[1] == pytest.approx(36788, abs=2)
    assert counts[2] == pytest.approx(18394, abs=2)
    assert sum(w * n for w, n in counts.items()) == pytest.approx(100_000, rel=1e-3)


def test_one_outlier_does_not_put_all_values_into_one_slice(spark):
    """Every slice of a hot group holds a bounded share of its distinct values, however far one value lies off."""
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id")).cast("decimal(18,2)").alias("v"))
    found = one(distribution.distribution(df, ["g"], "v"))
    assert (found["line_count"], found["median"]) == (4000, pytest.approx(2000.5))
    cuts = df.select(F.percentile_approx(F.col("v").cast("double"), [k / 64 for k in range(1, 64)], 6400).alias("cuts"))
    sliced = df.crossJoin(cuts).select(F.size(F.filter("cuts", lambda c: c < F.col("v").cast("double"))).alias("slice"))
    assert max(r["count"] for r in rows(sliced.groupBy("slice").count())) <= 2 * 4000 / 64


def test_cells_keep_the_order(spark):
    values = [0, 1, -1, 9, 10, 9999, 10_000, 10_001, 99_999_999, 100_000_000, 123_456_789_012_345_678, -9999, -10_000, -123_456_789, 10**18 - 1, -(10**18) + 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    first, second, least = distribution._cells(F.col("x"))
    found = rows(df.select("x", first.alias("a"), second.alias("b"), least.alias("l")).orderBy("x"))
    cells = [(r["a"], r["b"]) for r in found]
    assert cells == sorted(cells)
    assert all(abs(r["l"]) <= abs(r["x"]) and (r["x"] == 0 or (r["l"] > 0) == (r["x"] > 0)) for r in found)


def test_values_of_all_sizes(spark):
    rng = random.Random(8)
    values = [rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 15)) / 100 for _ in range(2000)]
    values += [123_456_789.01 + k / 100 for k in range(300)]  # alike in their first eight digits
    df = spark.createDataFrame([(None, v) for v in values] + [("g", 1.0)], "g string, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    found = {r["g"]: r for r in rows(distribution.distribution(df.repartition(3), ["g"], "v"))}
    assert found["g"]["line_count"] == 1 and found["g"]["stddev"] == 0.0
    own = found[None]
    assert own["line_count"] == len(values)
    assert own["mean"] == pytest.approx(np.mean(values), rel=1e-12)
    assert own["stddev"] == pytest.approx(np.std(values), rel=1e-9)
    for name, p in PERCENTILES.items():
        assert own[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-3), name


def test_a_hot_group_is_split_over_tasks(spark):
    """The rows that find ranks are dealt by cell, not by group."""
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 37 % 20_000).cast("decimal(18,2)").alias("v"))
    result = distribution.distribution(df, ["g"], "v")
    assert one(result)["median"] == 9999.5
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    first, _, _ = distribution._cells((F.col("v") * 100).cast("long"))
    assert max(r["count"] for r in rows(df.groupBy(first).count())) <= 20_000 / 80


@pytest.mark.parametrize("n", [2, 3, 10, 63, 64, 1000, 40_000])
def test_weights_of_equal_lines_follow_the_poisson_law(spark, n):
    draws = 20_000
    low, least = distribution._poisson_start(F.col("n"))
    df = spark.range(draws).select(F.lit(n).cast("long").alias("n"), ((F.col("id") + 0.5) / draws).alias("u"))
    df = df.limit(200 if n > 10_000 else draws).select("u", "n", low.alias("low"), least.alias("least"))
    weight = distribution._poisson_many(F.col("u"), F.col("n"), F.col("low"), F.col("least"))
    found = rows(df.select("u", weight.alias("w")).orderBy("u"))
    k = np.arange(0, n + int(12 * n**0.5) + 60)
    logs = k * np.log(n) - n - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    cumulative = np.cumsum(np.exp(logs))
    wanted = np.searchsorted(cumulative, [r["u"] for r in found], side="right")
    assert (wanted == [r["w"] for r in found]).all()


def test_equal_lines_are_not_repeated(spark):
    """Five thousand equal lines are one row per replicate, whose weight is near their number."""
    vendors = [supplier("S1"), supplier("S2")]
    t = tables(spark, vendors, [order("P1", "S1", 1, 5), order("P2", "S2", 1, 6)])
    lines = t.orders().where("po_number = 'P1'").crossJoin(spark.range(5000).select()).unionByName(t.orders())
    many = type(t)(t.suppliers(), t.materials(), lines, t.incidents())
    found = [r for r in rows(distribution.resampled_lines(many, 50, 100)) if float(r["price"]) == 5]
    assert len(found) == 50 and len({r["weight"] for r in found}) > 10
    assert all(abs(r["weight"] - 5001) < 6 * 5001**0.5 for r in found)


def test_equal_lines_agree_with_the_reference_statement(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for path in glob.glob(f"{folder}/*.parquet"):
        if "lineitem" not in path:
            os.symlink(path, f"{tmp_path}/{os.path.basename(path)}")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    times = F.when(F.col("l_orderkey") % 7 == 0, 1 + F.col("l_partkey") % 4).otherwise(1)
    lines.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("copy").coalesce(1).write.parquet(f"{tmp_path}/lines")
    os.rename(glob.glob(f"{tmp_path}/lines/part-*.parquet")[0], f"{tmp_path}/lineitem.parquet")
    wanted = connect(str(tmp_path)).execute(entry.oracle_sql()["savings_bootstrap"])
    assert differences(entry.queries()["savings_bootstrap"](spark, str(tmp_path)), wanted) == []
