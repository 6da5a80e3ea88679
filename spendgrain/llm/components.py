"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spendgrain.llm.common import stored


def _measured(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and a count and checksum taken while they were."""
    seen = Observation()
    both = F.xxhash64("u", "v").cast("decimal(38,0)")
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(both).alias("sum")), "links")
    return out, (seen.get["n"], seen.get["sum"])


def _to_minimum(pairs: DataFrame, chosen: Column, keep_self: bool) -> DataFrame:
    """Link the chosen neighbours v of each u to the smallest one of u and its neighbours.

    Minima are combined before the shuffle, so a node with a third of all
    links costs a task one row; the join back splits it where it is skewed.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("w")).where(chosen)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``links(u, v)``.

    Alternates between sending larger and smaller neighbours to the smallest
    one until nothing changes, in a number of rounds that grows with the
    logarithm of the longest chain. Nulls and loops link nothing; repeated
    links count once; no links give no rows. Nodes without links are absent.
    Each round is written to the shared folder. Only a count and a checksum
    reach the driver.
    """
    edges = links.select("u", "v").where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = _measured(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, F.col("v") > F.col("u"), False)
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges, now = _measured(_to_minimum(small, F.lit(True), True).distinct())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
