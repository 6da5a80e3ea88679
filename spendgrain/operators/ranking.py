"""Ordering, top-n with a unique tie-break, and values per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_first(df: DataFrame, measure: str, *keys: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_last(), *keys)


def top_n(df: DataFrame, n: int | None, measure: str, *keys: str) -> DataFrame:
    """The n largest rows, or all of them in order when ``n`` is None."""
    ordered = largest_first(df, measure, *keys)
    return ordered if n is None else ordered.limit(n)


def join_group_values(
    rows: DataFrame, values: DataFrame, keys: list[str], spread_by: str, parts: int = 32
) -> DataFrame:
    """Join one row of ``values`` per group back onto the rows of the group.

    The few group values are repeated ``parts`` times and the rows of a group
    are spread over as many parts, so that a group holding most of the rows
    is joined by many tasks. Meant for groups far fewer than rows.

    The join keeps all rows: an inner join would push a test of its salted
    key down to the scan and keep Spark from reusing the shuffle that rows
    and values have in common.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(parts))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    repeated = values.withColumn("group_part", each)
    return rows.withColumn("group_part", part).join(repeated, [*keys, "group_part"], "left").drop("group_part")


def first_per_group(df: DataFrame, groups: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group with their ``position``.

    Spark keeps n rows per group and task before the shuffle, so a group
    that holds most of the rows does not land in one task.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)
