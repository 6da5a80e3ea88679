"""From raw tables with arbitrary headers and dirty cells to the canonical model."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendgrain.functions.dates import DATE_FORMATS, parse_date
from spendgrain.functions.text import filled, slug, yes_no
from spendgrain.model import DATASETS, MONEY, QUALITY_INCIDENTS, QUANTITY, DateFormats, SchemaError
from spendgrain.session import shared_folder
from spendgrain.tables import Tables


def rename_columns(df: DataFrame, dataset: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename accepted headers to their canonical names; other columns stay.

    Returns the frame and the map of renamed headers. Among several accepted
    headers of one column the first listed wins.
    """
    by_slug = {slug(column): column for column in df.columns}
    renames: dict[str, str] = {}
    for canonical, accepted in DATASETS[dataset].aliases.items():
        header = next((by_slug[slug(a)] for a in accepted if slug(a) in by_slug), None)
        if header is not None:
            renames[header] = canonical
    taken = {canonical.lower() for canonical in renames.values()}
    keep = [c for c in df.columns if c in renames or c.lower() not in taken]
    return df.select(*(F.col(f"`{c}`").alias(renames.get(c, c)) for c in keep)), renames


def apply_defaults(df: DataFrame, dataset: str) -> DataFrame:
    """Add absent columns with their defaults, then check the required ones."""
    spec = DATASETS[dataset]
    present = set(df.columns)
    added = {c: F.lit(v).cast(spec.types[c]) for c, v in spec.defaults.items() if c not in present}
    missing = [c for c in spec.required if c not in present and c not in added]
    if missing:
        raise SchemaError(f"{dataset} is missing required columns after normalization: {', '.join(missing)}")
    return df.withColumns(added) if added else df


def _number(name: str) -> Column:
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def _formats(dataset: str, column: str, formats: DateFormats) -> tuple[str, ...]:
    return formats.get(dataset, {}).get(column, ()) if isinstance(formats, Mapping) else tuple(formats)


DAYS = ("po_date", "expected_delivery_date", "actual_delivery_date")


def readings(df: DataFrame, dataset: str, formats: DateFormats = ()) -> dict[str, Column]:
    """For each column that is not text, its typed cells: NULL where a cell is empty or cannot be read."""
    kinds = dict(df.dtypes)

    def amount(name: str) -> Column:
        return F.col(name).try_cast(MONEY)

    def day(name: str) -> Column:
        return parse_date(F.col(name), _formats(dataset, name, formats)) if kinds[name] == "string" else F.col(name).cast("date")

    typed = {
        "suppliers": {"quality_rating": _number("quality_rating"), "is_approved": yes_no(F.col("is_approved"))},
        "materials": {"standard_price_ngn": amount("standard_price_ngn"), "lead_time_days": _number("lead_time_days").try_cast("int")},
        "purchase_orders": {
            "quantity": F.col("quantity").try_cast(QUANTITY),
            **{c: amount(c) for c in ("unit_price_ngn", "total_amount_ngn", "total_amount_usd")},
        },
        "quality_incidents": {"cost_impact_ngn": amount("cost_impact_ngn")},
    }[dataset]
    return typed | ({c: day(c) for c in DAYS if c in kinds} if dataset == "purchase_orders" else {})


def _otherwise(dataset: str) -> dict[str, Column]:
    """What stands in for cells that are empty or cannot be read."""
    return {
        "suppliers": {"quality_rating": F.lit(4.0), "is_approved": F.lit(True)},
        "materials": {"standard_price_ngn": F.lit(0).cast(MONEY), "lead_time_days": F.lit(30)},
        "purchase_orders": {},
        "quality_incidents": {"cost_impact_ngn": F.lit(0).cast(MONEY)},
    }[dataset]


def _words(dataset: str) -> dict[str, Column]:
    """Text columns that are brought to one spelling or filled."""
    return {
        "suppliers": {"risk_level": F.coalesce(F.initcap(filled(F.col("risk_level"))), F.lit("Medium"))},
        "materials": {},
        "purchase_orders": {
            "currency": F.coalesce(F.upper(filled(F.col("currency"))), F.lit("NGN")),
            "delivery_status": F.coalesce(F.col("delivery_status"), F.lit("Delivered")),
            "payment_status": F.coalesce(F.col("payment_status"), F.lit("Paid")),
        },
        "quality_incidents": {"severity": F.coalesce(F.initcap(filled(F.col("severity"))), F.lit("Medium"))},
    }[dataset]


def coercions(df: DataFrame, dataset: str, formats: DateFormats = ()) -> dict[str, Column]:
    """Typed and filled columns of a table with canonical names."""
    instead = _otherwise(dataset)
    typed = {c: F.coalesce(x, instead[c]) if c in instead else x for c, x in readings(df, dataset, formats).items()}
    return typed | _words(dataset)


def unreadable_cells(raw: Mapping[str, DataFrame | list[DataFrame]], date_formats: DateFormats | None = ()) -> DataFrame:
    """``dataset, column, present, unreadable``: cells that hold something, and those of them that the column's type cannot hold.

    One pass per table; a dataset may come in several tables, which are added
    up. Columns that a table lacks have no cells. With ``date_formats=None`` days
    are read as the cells of each table show.
    """
    tables = [(name, part) for name, found in raw.items() for part in (found if isinstance(found, list) else [found])]
    parts = []
    for name, frame in tables:
        formats = infer_date_formats({name: frame}) if date_formats is None else date_formats
        given, _ = rename_columns(frame, name)
        full = apply_defaults(given, name)
        shown = []
        for column, value in readings(full, name, formats).items():
            if column in given.columns:
                held = F.trim(F.col(column).cast("string")) != ""
                counts = (F.count_if(held).alias("present"), F.count_if(held & value.isNull()).alias("unreadable"))
                shown.append(F.struct(F.lit(name).alias("dataset"), F.lit(column).alias("column"), *counts))
        if shown:
            parts.append(full.agg(F.array(*shown).alias("cells")).select(F.inline("cells")))
    added = reduce(DataFrame.unionByName, parts).groupBy("dataset", "column")
    return added.agg(F.sum("present").alias("present"), F.sum("unreadable").alias("unreadable"))


def infer_date_formats(raw: Mapping[str, DataFrame], known: tuple[str, ...] = DATE_FORMATS) -> dict[str, dict[str, tuple[str, ...]]]:
    """By dataset and column, the pattern that reads most of the days that are not ISO ones.

    Equal cells of each text column of days are counted first, so a spelling is
    tried once however many lines have it; the counts tell how many such cells
    each known pattern reads: a pattern is ruled out by what it cannot be, such
    as a thirteenth month. Columns of ISO days, or of none that any pattern
    reads, get no pattern. Where several read equally many and do not agree on all
    days, the column is refused: a SchemaError names it and the patterns.
    """
    found: dict[str, dict[str, tuple[str, ...]]] = {}
    for name, frame in raw.items():
        given, _ = rename_columns(frame, name)
        columns = [c for c, kind in given.dtypes if c in DAYS and kind == "string" and name == "purchase_orders"]
        if not columns:
            continue
        held = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in columns))
        cells = given.select(F.inline(held)).groupBy("column", "cell").agg(F.count("*").alias("n"))
        odd = F.try_to_timestamp("cell").isNull()
        read = {f: F.when(odd, F.try_to_timestamp("cell", F.lit(f)).cast("date")) for f in known}
        sums = (F.sum(F.when(day.isNotNull(), F.col("n")).otherwise(0)).alias(f) for f, day in read.items())
        counts = {row["column"]: row for row in cells.groupBy("column").agg(*sums).collect()}
        for c in columns:
            if c not in counts:
                continue
            most = max(counts[c][f] for f in known)
            best = [f for f in known if most and counts[c][f] == most]
            if len(best) > 1:
                differ = reduce(Column.__or__, (~read[best[0]].eqNullSafe(read[f]) for f in best[1:]))
                if cells.where((F.col("column") == c) & differ).limit(1).count():
                    raise SchemaError(f"Days in {name}.{c} can be read as {' or '.join(best)}; say which")
            if best:
                found.setdefault(name, {})[c] = (best[0],)
    return found


def clean_table(
    df: DataFrame, dataset: str, *, keep_extra: bool = False, date_formats: DateFormats = ()
) -> tuple[DataFrame, dict[str, str]]:
    """Rename, fill absent columns and coerce types of one table."""
    renamed, renames = rename_columns(df, dataset)
    full = apply_defaults(renamed, dataset)
    columns = DATASETS[dataset].columns
    extra = [F.col(f"`{c}`") for c in full.columns if c not in columns] if keep_extra else []
    coerced = coercions(full, dataset, date_formats)
    return full.select(*(coerced.get(c, F.col(c)).alias(c) for c in columns), *extra), renames


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """One whole row per key, the same one on every run.

    The fullest row is kept, and of equally full ones the smallest. ``min``
    combines before the shuffle, so a key with very many copies stays cheap.
    """
    rest = [c for c in df.columns if c != key]
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in rest), F.lit(0))
    best = F.min(F.struct(empty.alias("_empty"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row")))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best._row.*")


def enrich_orders(orders: DataFrame, suppliers: DataFrame, materials: DataFrame) -> DataFrame:
    """Fill names, categories, amounts and expected dates of the order lines.

    No join is hinted: Spark broadcasts a dimension when its size allows and
    otherwise moves both sides, splitting hot keys at run time. What the lines
    need of a dimension is written first, so that its size is known when joins
    are chosen and a small one does not move the lines. Materials, which are more,
    come first: lines that move to them hold no names of suppliers yet.
    """

    def sized(dimension: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(dimension.sparkSession, name)
        dimension.write.parquet(folder)
        return dimension.sparkSession.read.schema(dimension.schema).parquet(folder)

    vendor = sized(
        suppliers.select("supplier_id", F.col("supplier_name").alias("_vendor"), F.col("category").alias("_vendor_category")),
        "vendors",
    )
    item = sized(
        materials.select("material_id", F.col("material_name").alias("_item"), F.col("category").alias("_item_category")),
        "items",
    )
    quantity = F.coalesce("quantity", F.lit(0).cast(QUANTITY))
    price = F.coalesce("unit_price_ngn", F.lit(0).cast(MONEY))
    filled_columns = {
        "supplier_name": F.coalesce("supplier_name", "_vendor"),
        "category": F.coalesce("category", "_vendor_category", F.lit("Unclassified")),
        "quantity": quantity,
        "unit_price_ngn": price,
        "total_amount_ngn": F.coalesce("total_amount_ngn", (quantity * price).try_cast(MONEY)),
        "expected_delivery_date": F.coalesce("expected_delivery_date", F.date_add("po_date", 30)),
    }
    of_items = {
        "material_name": F.coalesce("material_name", "_item"),
        "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), "_item_category"),
    }
    joined = orders.join(item, "material_id", "left").withColumns(of_items).join(vendor, "supplier_id", "left")
    return joined.select(*(filled_columns.get(c, F.col(c)).alias(c) for c in orders.columns))


NUMBER_RANGES = 4096


def _numbered(incidents: DataFrame) -> DataFrame:
    """Incidents numbered from 1 by their contents, whatever the input splits.

    Equal rows are counted first and take numbers in a row. Ranges of hash
    values are counted next, so no task orders more than a range.
    """
    columns = [c for c in incidents.columns if c != "incident_id"]
    copies = incidents.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias("_copies"))
    hashed = copies.withColumn("_hash", F.xxhash64(*(F.col(f"`{c}`") for c in columns)))
    hashed = hashed.withColumn("_range", F.pmod("_hash", F.lit(NUMBER_RANGES)))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hashed.groupBy("_range").agg(F.sum("_copies").alias("_held"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_outer"))
    order = Window.partitionBy("_range").orderBy("_hash", *(F.col(f"`{c}`") for c in columns))
    inside = F.coalesce(F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hashed.withColumn("_inner", inside).join(ranges, "_range")
    first = F.col("_outer") + F.col("_inner")
    rows = rows.withColumn("_number", F.explode(F.sequence(first + 1, first + F.col("_copies"))))
    number = F.format_string("QI%05d", "_number")
    return rows.select(*(number.alias(c) if c == "incident_id" else F.col(f"`{c}`") for c in incidents.columns))


def complete_incidents(incidents: DataFrame, orders: DataFrame) -> DataFrame:
    """Number incidents when none has an id, and fill unknown suppliers through the order.

    A supplier is filled only where the order has exactly one; otherwise it
    stays unknown, so an incident remains one row. The quality report counts
    such incidents.
    """
    any_id = incidents.select((F.count("incident_id") > 0).alias("any_id")).scalar()
    numbered = incidents.where(any_id).unionByName(_numbered(incidents.where(~any_id)))
    bridge = order_suppliers(incidents, orders).where("_supplier = _last")
    open_row = F.col("supplier_id").isNull() & (F.col("po_number") == F.col("_po"))
    return numbered.join(bridge, open_row, "left").select(
        *(
            F.coalesce("supplier_id", "_supplier").alias(c) if c == "supplier_id" else F.col(f"`{c}`")
            for c in incidents.columns
        )
    )


def order_suppliers(incidents: DataFrame, orders: DataFrame) -> DataFrame:
    """Smallest and largest supplier of each order that an incident without supplier names."""
    orphans = incidents.where("supplier_id IS NULL AND po_number IS NOT NULL").select("po_number").distinct()
    named = orders.select("po_number", "supplier_id").where("supplier_id IS NOT NULL")
    return (
        named.join(orphans, "po_number", "left_semi")
        .groupBy(F.col("po_number").alias("_po"))
        .agg(F.min("supplier_id").alias("_supplier"), F.max("supplier_id").alias("_last"))
    )


def cleaned_tables(
    raw: Mapping[str, DataFrame], *, keep_extra: bool = False, date_formats: DateFormats = ()
) -> tuple[Tables, dict[str, dict[str, str]]]:
    """The tables as given, with canonical columns and types, before any row is merged or filled.

    The quality report reads these. Suppliers, materials and orders are
    required, incidents are optional.
    """
    clean: dict[str, DataFrame] = {}
    renames: dict[str, dict[str, str]] = {}
    for name in DATASETS:
        if name in raw:
            clean[name], renames[name] = clean_table(
                raw[name], name, keep_extra=keep_extra, date_formats=date_formats
            )
        elif name == "quality_incidents":
            clean[name], renames[name] = empty_incidents(clean["suppliers"].sparkSession), {}
        else:
            raise SchemaError(f"Missing required dataset: {name}")
    return Tables(*(clean[n] for n in ("suppliers", "materials", "purchase_orders", "quality_incidents"))), renames


def normalize(
    raw: Mapping[str, DataFrame], *, keep_extra: bool = False, date_formats: DateFormats = ()
) -> tuple[Tables, dict[str, dict[str, str]]]:
    """Map raw tables onto the canonical model.

    Suppliers, materials and orders are required, incidents are optional.
    Returns the tables and, per dataset, the headers that were renamed.
    """
    clean, renames = cleaned_tables(raw, keep_extra=keep_extra, date_formats=date_formats)
    suppliers = unique_by(clean.suppliers(), "supplier_id")
    materials = unique_by(clean.materials(), "material_id")
    orders = enrich_orders(clean.orders(), suppliers, materials)
    incidents = complete_incidents(clean.incidents(), clean.orders())
    return Tables(suppliers, materials, orders, incidents), renames


def empty_incidents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUALITY_INCIDENTS.schema)
