"""Data-quality report over the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.session import shared_folder
from spendgrain.sources.normalize import order_suppliers
from spendgrain.tables import Tables


def _per_dataset(t: Tables, name: str, measure) -> DataFrame:
    """One row per dataset with a value from ``measure(frame)``."""
    rows = [
        measure(frame).select(F.lit(dataset).alias("dataset"), F.col("value").cast("bigint").alias(name))
        for dataset, frame in t.frames().items()
    ]
    return reduce(DataFrame.unionByName, rows)


def row_counts(t: Tables) -> DataFrame:
    return _per_dataset(t, "row_count", lambda df: df.agg(F.count("*").alias("value")))


def null_cells(t: Tables) -> DataFrame:
    """Empty cells over all columns, in one pass per table."""

    def count(df: DataFrame) -> DataFrame:
        cells: Column = reduce(
            lambda a, b: a + b, (F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in df.columns)
        )
        return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("value"))

    return _per_dataset(t, "null_cells", count)


# So many digests of repeated rows are sent to all tasks; more of them are joined by a shuffle.
FEW_DIGESTS = 4 << 20


def suspected_copies(df: DataFrame) -> DataFrame:
    """The rows whose 64-bit digest another row shares, digests included: copies, and rarely others.

    The rows are computed once and written. Only digests are shuffled and
    counted; those that occur twice are written as well, so that their number
    is known when the rows are looked up: up to FEW_DIGESTS are sent to the
    rows, and only rows that match are moved.
    """
    folder, spark = shared_folder(df.sparkSession, "digests"), df.sparkSession
    void = {c for c, kind in df.dtypes if kind == "void"}
    df = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in void else F.col(f"`{c}`") for c in df.columns))
    df.write.parquet(f"{folder}/rows")
    cells = [F.col(f"`{c}`") for c in df.columns]
    # A NULL leaves the hash as it is, so the pattern of NULLs is hashed as well.
    empty = F.concat(F.lit(""), *(F.when(c.isNull(), "1").otherwise("0") for c in cells))
    stored = spark.read.schema(df.schema).parquet(f"{folder}/rows").select("*", F.xxhash64(*cells, empty).alias("_digest"))
    digests = stored.groupBy("_digest").agg(F.count("*").alias("n"))
    digests.where("n > 1").select("_digest").write.parquet(f"{folder}/repeated")
    repeated = spark.read.schema("_digest bigint").parquet(f"{folder}/repeated")
    few = repeated.limit(FEW_DIGESTS + 1).count() <= FEW_DIGESTS
    return stored.join(F.broadcast(repeated) if few else repeated, "_digest", "left_semi")


def duplicate_rows(t: Tables) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Digests tell which rows can have a copy; those are compared whole. Equal
    rows are combined before the shuffle, so a row with very many copies costs
    no more than any other.
    """

    def count(df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns]
        copies = suspected_copies(df).groupBy(*columns).agg(F.count("*").alias("copies"))
        return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("value"))

    return _per_dataset(t, "duplicate_rows", count)


# The key of each table whose rows have one.
KEYS = {"suppliers": "supplier_id", "materials": "material_id", "quality_incidents": "incident_id"}


def duplicate_keys(t: Tables) -> DataFrame:
    """Rows beyond the first of each known key."""
    rows = []
    for dataset, key in KEYS.items():
        copies = t.frames()[dataset].where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"))
        extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint")
        rows.append(copies.agg(F.lit(dataset).alias("dataset"), extra.alias("duplicate_keys")))
    return reduce(DataFrame.unionByName, rows)


def unmapped_keys(t: Tables) -> DataFrame:
    """Lines whose supplier or material is unknown, and incidents without an order or with several suppliers to choose from.

    Lines are counted per key before the anti join. Of the orders only those
    that incidents name are looked at.
    """

    def unknown(rows: DataFrame, known: DataFrame, key: str, label: str) -> DataFrame:
        counted = rows.groupBy(key).agg(F.count("*").alias("rows"))
        return counted.join(known, key, "left_anti").agg(
            F.lit(label).alias("check"), F.coalesce(F.sum("rows"), F.lit(0)).alias("unmapped")
        )

    named = t.incidents("po_number").distinct()
    orders = t.orders("po_number").join(named, "po_number", "left_semi").distinct()
    several = order_suppliers(t.incidents("po_number", "supplier_id"), t.orders("po_number", "supplier_id"))
    open_ = t.incidents("po_number", "supplier_id").where("supplier_id IS NULL")
    ambiguous = open_.join(several.where("_supplier < _last"), F.col("po_number") == F.col("_po"), "left_semi")
    return (
        unknown(t.orders("supplier_id"), t.suppliers("supplier_id"), "supplier_id", "unmapped_supplier_ids")
        .unionByName(
            unknown(t.orders("material_id"), t.materials("material_id"), "material_id", "unmapped_material_ids")
        )
        .unionByName(unknown(t.incidents("po_number"), orders, "po_number", "quality_incidents_without_po"))
        .unionByName(
            ambiguous.agg(F.lit("incidents_with_ambiguous_supplier").alias("check"), F.count("*").alias("unmapped"))
        )
    )


def quality_report(t: Tables) -> DataFrame:
    """The whole report in long form: check, dataset and value. Give it the cleaned tables, before rows are merged."""

    def long_form(df: DataFrame, check: str) -> DataFrame:
        return df.select(F.lit(check).alias("check"), "dataset", F.col(check).alias("value"))

    return (
        long_form(row_counts(t).withColumnRenamed("row_count", "row_counts"), "row_counts")
        .unionByName(long_form(null_cells(t), "null_cells"))
        .unionByName(long_form(duplicate_rows(t), "duplicate_rows"))
        .unionByName(long_form(duplicate_keys(t), "duplicate_keys"))
        .unionByName(
            unmapped_keys(t).select("check", F.lit(None).cast("string").alias("dataset"), F.col("unmapped").alias("value"))
        )
    )
