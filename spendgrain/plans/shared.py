"""Order lines read once for a report that asks many questions of them."""

from __future__ import annotations

from spendgrain.plans import marts
from spendgrain.session import shared_folder
from spendgrain.tables import Tables, WithBases

# Order columns that the measures of the summary use.
SUMMARY_COLUMNS = (
    "po_number", "supplier_id", "supplier_name", "material_name", "category", "quantity", "unit_price_ngn",
    "total_amount_ngn", "total_amount_usd", "currency", "expected_delivery_date", "actual_delivery_date",
)


def keep_lines(t: Tables, *columns: str) -> Tables:
    """The tables with the given columns of the lines written to the shared folder: what joins the lines need is made once."""
    folder = f"{shared_folder(t.spark, 'shared')}/lines"
    t.orders(*columns).write.parquet(folder)
    return Tables(t.suppliers(), t.materials(), t.spark.read.parquet(folder), t.incidents())


def read_once(t: Tables, *columns: str) -> Tables:
    """The tables with the given columns of the lines, and the base marts that build on them, written to the shared folder.

    What joins the lines need is made once; a mart that several measures use is
    aggregated once. Everything else reads narrow files, and a lost executor
    repeats only its scan of them.
    """
    folder, once = shared_folder(t.spark, "shared"), keep_lines(t, *(columns or SUMMARY_COLUMNS))
    for name, mart in marts.BASES.items():
        mart(once).write.parquet(f"{folder}/{name}")
    return WithBases(once, {name: t.spark.read.parquet(f"{folder}/{name}") for name in marts.BASES})
