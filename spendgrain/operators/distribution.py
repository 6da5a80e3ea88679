"""Distribution summaries with exact percentiles, and bootstrap intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spendgrain.functions.numeric import as_double, half_up, ratio
from spendgrain.tables import Tables

# The percentiles reported.
PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}

CELL_DIGITS = 4


def _cells(x: Column) -> tuple[Column, Column, Column]:
    """Ordered cells of whole numbers: by the length and first digits, and by the digits after these; and the first number of the first cell, off zero."""
    size = F.abs(x)
    length = F.length(size.cast("string"))

    def unit(digits: int) -> Column:
        """One in the last of so many leading digits."""
        return F.pow(F.lit(10), F.greatest(length - digits, F.lit(0))).cast("bigint")

    def whole(by: Column) -> Column:
        return F.call_function("div", size, by)

    sign = F.when(x < 0, -1).otherwise(1)
    least = whole(unit(CELL_DIGITS)) * unit(CELL_DIGITS)
    lead = length * 10**CELL_DIGITS + whole(unit(CELL_DIGITS))
    return sign * lead, sign * (whole(unit(2 * CELL_DIGITS)) % 10**CELL_DIGITS), sign * least


def _matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULL keys equal each other; the right side brings its other columns."""
    names = {c: f"{c}__right" for c in on}
    right = right.withColumnsRenamed(names)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(names[c])) for c in on))
    return left.join(right, same).drop(*names.values())


def distribution(df: DataFrame, keys: list[str], value: str, *, digits: int = 4) -> DataFrame:
    """Count, mean, population deviation and exact interpolated percentiles of a decimal column per group.

    A group may hold most of the rows, so no task ever sees a whole group:
    equal values are counted; the counts are added up by leading digits, then by
    the digits after those, and at each level only cells that hold a wanted rank
    are looked into. Values in the last cells agree in eight digits; they are
    ordered. Mean and deviation follow from sums per cell. NULL keys make a group
    as any other; NULL values are left out.
    """
    scale = 10 ** df.schema[value].dataType.scale
    given = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value) * F.lit(scale)).cast("bigint").alias("x"))
    first, second, least = _cells(F.col("x"))
    counts = given.groupBy(*keys, "x").agg(F.count("*").alias("n"))
    celled = counts.select(*keys, "x", "n", first.alias("first"), second.alias("second"))

    off, n = F.col("x") - F.col("least"), F.col("n")
    cells = (
        counts.select(*keys, "x", "n", first.alias("first"), least.alias("least"))
        .groupBy(*keys, "first", "least")
        .agg(
            F.sum("n").alias("size"),
            F.sum(F.col("x").cast("decimal(19,0)") * n.cast("decimal(18,0)")).alias("total"),
            F.sum(as_double(off) * n).alias("off"),
            F.sum(as_double(off) * off * n).alias("squares"),
        )
    )
    group = Window.partitionBy(*keys)

    def before(window: WindowSpec, size: str) -> Column:
        return F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    placed = cells.select(
        *keys, "first", "least", "size", "off", "squares",
        F.sum("size").over(group).alias("rows"),
        ratio(F.sum("total").over(group), F.sum("size").over(group)).alias("average"),
        before(group.orderBy("first"), "size").alias("before"),
    )
    away = F.col("least") - F.col("average")
    around = F.col("squares") + 2 * away * F.col("off") + away * away * F.col("size")
    moments = placed.groupBy(*keys, "rows", "average").agg(F.sum(around).alias("squares"))

    # Zero-based ranks on both sides of every percentile.
    positions = {name: (F.col("rows") - 1) * F.lit(p) for name, p in PERCENTILES.items()}
    ranks = F.array_distinct(F.array(*(f(p) for p in positions.values() for f in (F.floor, F.ceil))))

    def covering(start: Column, size: Column) -> Column:
        return F.filter(ranks, lambda r: (r >= start) & (r < start + size))

    def holding(rows: DataFrame) -> DataFrame:
        return rows.where(F.size(covering(F.col("before"), F.col("size"))) > 0)

    wanted = holding(placed).select(*keys, "first", "rows", "before")
    inner = _matched(celled, wanted, [*keys, "first"]).groupBy(*keys, "first", "second", "rows", "before").agg(F.sum("n").alias("size"))
    within = F.col("before") + before(Window.partitionBy(*keys, "first").orderBy("second"), "size")
    last = holding(inner.withColumn("before", within)).select(*keys, "first", "second", "rows", "before")
    ordered = Window.partitionBy(*keys, "first", "second").orderBy("x")
    start = F.col("before") + before(ordered, "n")
    found = _matched(celled, last, [*keys, "first", "second"]).withColumn("start", start)
    found = found.select(*keys, "x", F.explode(covering(F.col("start"), F.col("n"))).alias("rank"))
    at_ranks = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("values"))
    joined = _matched(moments, at_ranks, keys)

    def shown(number: Column) -> Column:
        return half_up(number, digits)

    def percentile(name: str) -> Column:
        position = positions[name]
        lower, upper = (as_double(F.col("values")[f(position)]) / scale for f in (F.floor, F.ceil))
        return shown(lower + (upper - lower) * (position - F.floor(position))).alias(name)

    return joined.select(
        *keys,
        F.col("rows").alias("line_count"),
        shown(F.col("average") / scale).alias("mean"),
        shown(F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / F.col("rows")) / scale).alias("stddev"),
        *(percentile(name) for name in PERCENTILES),
    )


def price_distribution(t: Tables, *, digits: int = 4) -> DataFrame:
    """Spread of the unit price per material and category."""
    keys = ["material_name", "category"]
    return distribution(t.orders(*keys, "unit_price_ngn"), keys, "unit_price_ngn", digits=digits)


def approximate_price_distribution(t: Tables, accuracy: int = 10_000) -> DataFrame:
    """Cheaper variant with approximate percentiles in one pass."""
    keys = ["material_name", "category"]
    return (
        t.orders(*keys, "unit_price_ngn")
        .groupBy(*keys)
        .agg(
            F.count("unit_price_ngn").alias("line_count"),
            F.percentile_approx(
                as_double(F.col("unit_price_ngn")), list(PERCENTILES.values()), accuracy
            ).alias("values"),
        )
        .select(*keys, "line_count", *(F.col("values")[i].alias(name) for i, name in enumerate(PERCENTILES)))
    )


def _poisson(uniform: Column) -> Column:
    """Poisson(1) count of a uniform number, by inversion, up to the resolution of doubles."""
    count = F.when(uniform < POISSON[0], 0)
    for k, below in enumerate(POISSON[1:], 1):
        count = count.when(uniform < below, k)
    return count.otherwise(len(POISSON))


def _poisson_many(uniform: Column, n: Column, low: Column, least: Column) -> Column:
    """Poisson(n) count of a uniform number, by inversion: probabilities are added up from the smallest count worth it."""
    high = n + F.ceil(9 * F.sqrt(n)) + 32
    start = F.struct(least.alias("p"), F.lit(0.0).alias("sum"), low.alias("x"))

    def step(state: Column, k: Column) -> Column:
        total = state["sum"] + state["p"]
        return F.struct((state["p"] * n / (k + 1)).alias("p"), total.alias("sum"), (state["x"] + (total <= uniform).cast("bigint")).alias("x"))

    return F.aggregate(F.sequence(low, high), start, step)["x"]


def _poisson_start(n: Column) -> tuple[Column, Column]:
    """The smallest count of Poisson(n) worth adding up, below which lies less than a double holds, and its probability.

    The probability of the mode n is a product, or a series where that would
    be long; from there ratios of neighbours lead down.
    """
    low = F.greatest(F.lit(0), n - F.ceil(9 * F.sqrt(n)) - 9).cast("bigint")
    x = as_double(n)
    product = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), F.lit(1.0), lambda p, i: p * (x / i) * math.exp(-1))
    series = F.exp(-F.log(x * (2 * math.pi)) / 2 - 1 / (12 * x) + 1 / (360 * x * x * x) - 1 / (1260 * x * x * x * x * x))
    mode = F.when(n < 64, product).otherwise(series)
    return low, F.aggregate(F.sequence(low + 1, n), mode, lambda p, k: p * k / n)


def _cumulative_poisson() -> tuple[float, ...]:
    """Probabilities of at most 0, 1, ... until the rest is too small for a double to hold."""
    term, total, found = math.exp(-1), 0.0, []
    while total + term > total:
        total += term
        found.append(total)
        term /= len(found)
    return tuple(p for p in found if p < 1)


POISSON = _cumulative_poisson()

# A prime and two factors of known generators that stay below it.
PRIME, FACTORS = 2**31 - 1, (16807, 48271)
LINE = ("po_number", "supplier_id", "material_id", "quantity", "unit_price_ngn", "total_amount_ngn")


def _starts(digest: Column) -> list[Column]:
    """Two numbers below the prime, cut from a digest."""
    cut = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(len(FACTORS))]
    return [(c % (PRIME - 1) + 1).alias(f"start{k}") for k, c in enumerate(cut)]


def _replicates(number: int) -> Column:
    """For each replicate its number and its powers of the factors, as one literal."""
    rows = []
    for r in range(number):
        powers = ", ".join(f"'power{k}', {pow(f, r + 1, PRIME)}L" for k, f in enumerate(FACTORS))
        rows.append(f"named_struct('replicate', {r}, {powers})")
    return F.expr(f"array({', '.join(rows)})")


def _uniform(powers: list[Column]) -> Column:
    """52 random bits of a line in a replicate, as a number in [0, 1).

    The line's two numbers are multiplied by the replicate's powers, so a line
    is hashed once for all replicates.
    """
    parts = [F.shiftright(F.col(f"start{k}") * power % PRIME, 5) for k, power in enumerate(powers)]
    return (parts[0] * 2**26 + parts[1]) / F.lit(2.0**52)


def _cents(name: str) -> Column:
    return (F.col(name) * 100).cast("bigint")


def resampled_lines(t: Tables, replicates: int, rows_per_part: int) -> DataFrame:
    """Lines of materials with several suppliers, equal ones once, repeated per replicate with their weight.

    Equal lines together weigh what as many single ones would: a Poisson count
    of their number. It depends only on the line, that number and the replicate.
    Lines are moved together by material before they are repeated; a material
    with more than ``rows_per_part`` different lines is moved in several parts.
    """
    keys = ["material_name", "category"]
    lines = t.orders(*keys, *LINE).groupBy(*keys, *LINE).agg(F.count("*").alias("copies"))
    several = (
        lines.groupBy(*keys)
        .agg(F.min("supplier_id").alias("least"), F.max("supplier_id").alias("most"), F.count("*").alias("lines"))
        .where("least < most")
        .drop("least", "most")
    )
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *LINE, "copies")))
    marked = lines.join(several, keys).select(
        *keys,
        *_starts(F.md5(text)),
        F.col("unit_price_ngn").alias("price"),
        F.col("total_amount_ngn").alias("amount"),
        _cents("unit_price_ngn").alias("price_cents"),
        _cents("total_amount_ngn").alias("amount_cents"),
        "copies",
        F.ceil(F.col("lines") / rows_per_part).alias("parts"),
    )
    dealt = marked.withColumn("part", F.pmod("start0", F.col("parts"))).repartition(*keys, "part")
    many, all_replicates = F.col("copies") > 1, _replicates(replicates)
    low, least = _poisson_start(F.col("copies"))

    def all_copies(r: Column) -> Column:
        return _poisson_many(_uniform([r[f"power{k}"] for k in range(len(FACTORS))]), F.col("copies"), F.col("low"), F.col("least"))

    # Weights of equal lines are drawn for all replicates before the lines are repeated.
    dealt = dealt.withColumns({"low": F.when(many, low), "least": F.when(many, least)})
    repeated = dealt.withColumn("drawn", F.when(many, F.transform(all_replicates, all_copies))).select("*", F.inline(all_replicates))
    repeated = repeated.withColumn("uniform", _uniform([F.col(f"power{k}") for k in range(len(FACTORS))]))
    together = F.col("drawn")[F.col("replicate")]
    kept = repeated.where(F.when(many, together > 0).otherwise(F.col("uniform") >= POISSON[0]))
    return kept.withColumn("weight", F.when(many, together).otherwise(_poisson(F.col("uniform"))))


LIMB = 24


def savings_replicates(t: Tables, replicates: int = 100, *, rows_per_part: int = 200_000) -> DataFrame:
    """Price-standardization savings of each bootstrap replicate.

    All sums are exact: cents are added up in two halves of whole numbers,
    which become one decimal per material.
    """
    keys = ["material_name", "category"]
    w = F.col("weight")
    lines = resampled_lines(t, replicates, rows_per_part)
    halves = {
        f"{name}_{half}": w * part
        for name in ("price", "amount")
        for half, part in (
            ("high", F.shiftright(f"{name}_cents", LIMB)),
            ("low", F.col(f"{name}_cents").bitwiseAND(F.lit((1 << LIMB) - 1).cast("bigint"))),
        )
    }
    per_part = lines.groupBy(*keys, "part", "replicate").agg(
        F.sum(w).alias("weight"), *(F.sum(expr).alias(name) for name, expr in halves.items()), F.min("price_cents").alias("lowest")
    )

    def whole(name: str) -> Column:
        high, low = (F.sum(F.col(f"{name}_{half}").cast("decimal(19,0)")) for half in ("high", "low"))
        return (high * F.lit(1 << LIMB).cast("decimal(9,0)") + low) / 100

    per_material = per_part.groupBy(*keys, "replicate").agg(
        F.sum("weight").alias("weight"), whole("price").alias("price"), whole("amount").alias("amount"), F.min("lowest").alias("lowest")
    )
    average = ratio(F.col("price"), F.col("weight"))
    saved = as_double(F.col("amount")) * (average - as_double(F.col("lowest")) / 100) / F.nullif(average, F.lit(0.0))
    return (
        per_material.withColumn("saved", half_up(F.greatest(saved, F.lit(0.0)), 2).cast("decimal(28,2)"))
        .groupBy("replicate")
        .agg(as_double(F.sum("saved")).alias("savings"))
    )


def savings_bootstrap(t: Tables, replicates: int = 100, *, rows_per_part: int = 200_000) -> DataFrame:
    """Bootstrap interval of the price-standardization savings over all such materials.

    Each line, equal ones included, gets a Poisson(1) weight of its own per
    replicate. The percentiles run over the replicates, whose number is a parameter.
    """
    per_replicate = savings_replicates(t, replicates, rows_per_part=rows_per_part)
    quantile = {name: F.percentile("savings", F.lit(p)) for name, p in PERCENTILES.items()}
    return per_replicate.agg(
        F.count("*").alias("replicates"),
        half_up(ratio(F.sum(F.col("savings").cast("decimal(28,2)")), F.count("savings")), 2).alias("mean"),
        half_up(F.stddev_pop("savings"), 2).alias("stddev"),
        *(half_up(q, 2).alias(name) for name, q in quantile.items()),
        half_up(quantile["p95"] - quantile["p05"], 2).alias("interval_width"),
    )
