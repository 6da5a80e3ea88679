"""Reading canonical datasets from folders, landing areas and single paths."""

from __future__ import annotations

import csv
import logging
from collections import defaultdict
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrain.functions.text import slug
from spendgrain.model import DATASETS, FILENAME_HINTS, MISSING_WORDS, DateFormats, SchemaError

log = logging.getLogger(__name__)


#: What becomes of rows that have more or fewer cells than their header.
FAIL, QUARANTINE = "fail", "quarantine"
_RECORD = "_malformed_record"


def _parsed(spark: SparkSession, paths: list[str], multi_line: bool) -> tuple[DataFrame, list[str]]:
    """Cells as text, the text of malformed rows besides (empty for others), and the names of the header."""
    header = spark.read.option("header", True).csv(paths[0]).schema
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)  # cells are counted whichever of them are asked for
    )
    raw = reader.schema(T.StructType(header.fields).add(_RECORD, "string")).csv(paths)
    # Spark refuses to read the text of malformed rows without any cell, so nothing of the first one is added to it.
    nothing = F.substring(F.coalesce(F.col(f"`{header.names[0]}`"), F.lit("")), 1, 0)
    return raw.withColumn(_RECORD, F.concat(F.coalesce(_RECORD, F.lit("")), nothing)), header.names


def _cell_count() -> Column:
    """Cells of a malformed row: commas outside of quotes, and one."""
    bare = F.regexp_replace(_RECORD, r'"([^"]|"")*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_csv(spark: SparkSession, paths: str | list[str], *, multi_line: bool = False, malformed: str = FAIL) -> DataFrame:
    """CSV with a header, every column as text, missing-value words as NULL.

    All files of one call must share their header; Spark checks each of them.
    ``multi_line`` allows line breaks in quoted cells; a file is then one task.
    With ``malformed="fail"`` a row with more cells than the header stops the
    query that reads it, and the cells a short row lacks are NULL. With
    ``malformed="quarantine"`` rows of both kinds are left out; ``malformed_rows``
    has them.
    """
    raw, names = _parsed(spark, [paths] if isinstance(paths, str) else paths, multi_line)
    bad = F.char_length(_RECORD) > 0
    if malformed == QUARANTINE:
        raw = raw.where(~bad)
    elif malformed == FAIL:
        text = F.concat(F.lit(f"A row has more than {len(names)} cells: "), F.substring(_RECORD, 1, 200))
        raw = raw.where(F.when(bad & (_cell_count() > len(names)), F.raise_error(text).cast("boolean")).otherwise(True))
    else:
        raise ValueError(f"malformed rows cannot be treated as {malformed!r}")
    return raw.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in names))


def malformed_rows(spark: SparkSession, paths: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """``file, cells, expected, record`` of the rows with more or fewer cells than their header."""
    raw, names = _parsed(spark, [paths] if isinstance(paths, str) else paths, multi_line)
    rows = raw.select(F.input_file_name().alias("file"), _RECORD).where(F.char_length(_RECORD) > 0)
    return rows.select("file", _cell_count().alias("cells"), F.lit(len(names)).alias("expected"), F.col(_RECORD).alias("record"))


def read_path(spark: SparkSession, path: str, *, multi_line: bool = False, malformed: str = FAIL) -> DataFrame:
    """One file or folder: Parquet by its suffix, CSV otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, multi_line=multi_line, malformed=malformed)


def _folder(spark: SparkSession, folder: str):
    """File system and path of a folder, whatever store it is in and whether it is given relative or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_entries(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly below a folder, but for hidden ones."""
    files, path = _folder(spark, folder)
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Header of a CSV file or folder of files, from the first line of its first file; no job is run for plain files."""
    files, at = _folder(spark, path)
    while files.getFileStatus(at).isDirectory():
        inner = list_entries(spark, at.toString())
        if not inner:
            return ()
        at = spark._jvm.org.apache.hadoop.fs.Path(at, inner[0])
    if not at.getName().endswith(".csv"):
        return tuple(spark.read.option("header", True).csv(path).columns)
    stream = spark._jvm.java.io.InputStreamReader(files.open(at), "UTF-8")
    lines = spark._jvm.java.io.BufferedReader(stream)
    try:
        return tuple(next(csv.reader([lines.readLine() or ""]), ()))
    finally:
        lines.close()


def load_folder(spark: SparkSession, folder: str, *, multi_line: bool = False, malformed: str = FAIL) -> dict[str, DataFrame]:
    """Load whichever canonical datasets the folder holds, as ``<name>.csv`` or ``<name>.parquet``."""
    base = folder.rstrip("/")
    entries = set(list_entries(spark, base))
    tables = {}
    for name in DATASETS:
        for suffix in (".parquet", ".csv"):
            if name + suffix in entries:
                tables[name] = read_path(spark, f"{base}/{name}{suffix}", multi_line=multi_line, malformed=malformed)
                break
    if not tables:
        raise FileNotFoundError(f"No canonical datasets found in {folder}")
    return tables


def _has_word(tokens: list[str], hint: str) -> bool:
    """Whether the hint appears as whole words, singular or plural."""
    words = hint.split("_")
    for start in range(len(tokens) - len(words) + 1):
        window = tokens[start : start + len(words)]
        if window[:-1] == words[:-1] and window[-1] in (words[-1], words[-1] + "s"):
            return True
    return False


def route_dataset(filename: str) -> str | None:
    """Dataset a file belongs to, judged by the words of its name.

    Two-word hints are tried before single words, so that a file of order
    items counts as orders.
    """
    tokens = slug(PurePosixPath(filename).stem).split("_")
    for many in (True, False):
        for name, hints in FILENAME_HINTS.items():
            if any(_has_word(tokens, hint) for hint in hints if ("_" in hint) == many):
                return name
    return None


def _routed(spark: SparkSession, folder: str) -> tuple[dict[str, dict[tuple[str, ...], list[str]]], dict[str, list[str]]]:
    """CSV paths by dataset and header, and Parquet paths by dataset, of a landing folder's direct children."""
    base = folder.rstrip("/")
    groups: dict[str, dict[tuple[str, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    parquet: dict[str, list[str]] = defaultdict(list)
    for entry in list_entries(spark, base):
        name = route_dataset(entry)
        path = f"{base}/{entry}"
        if name is None:
            log.warning("Skipping unrecognised file: %s", entry)
        elif entry.endswith(".parquet"):
            parquet[name].append(path)
        else:
            groups[name][csv_header(spark, path)].append(path)
    return groups, parquet


def quarantined(spark: SparkSession, folder: str, *, multi_line: bool = False) -> DataFrame:
    """``dataset, file, cells, expected, record`` of all malformed rows of a landing folder."""
    groups, _ = _routed(spark, folder)
    found = [
        malformed_rows(spark, paths, multi_line=multi_line).select(F.lit(name).alias("dataset"), "*")
        for name in DATASETS
        for paths in groups[name].values()
    ]
    empty = spark.createDataFrame([], "dataset string, file string, cells int, expected int, record string")
    return reduce(DataFrame.unionByName, found, empty)


def landing_parts(spark: SparkSession, folder: str, *, multi_line: bool = False, malformed: str = FAIL) -> dict[str, list[DataFrame]]:
    """The tables of a landing folder as they are, by dataset: one for each header, and one for each Parquet child."""
    groups, parquet = _routed(spark, folder)
    parts = {}
    for name in DATASETS:
        parts[name] = [read_csv(spark, paths, multi_line=multi_line, malformed=malformed) for paths in groups[name].values()]
        parts[name] += [spark.read.parquet(path) for path in parquet[name]]
    return {name: found for name, found in parts.items() if found}


def load_landing(
    spark: SparkSession,
    folder: str,
    *,
    keep_extra: bool = False,
    date_formats: DateFormats | None = (),
    multi_line: bool = False,
    malformed: str = FAIL,
) -> dict[str, DataFrame]:
    """Load a landing folder: route each direct child by its name and union those of one dataset.

    Children with the same header are read by one scan. Unknown names are
    skipped. Where a dataset comes in several parts, each is cleaned by itself
    before the union: it gets its own defaults, must have the required columns,
    and its dirty cells become NULL. With ``date_formats=None`` each such part
    also gets the spelling of days that its own cells show.
    """
    tables = {}
    for name, parts in landing_parts(spark, folder, multi_line=multi_line, malformed=malformed).items():
        if len(parts) > 1:
            from spendgrain.sources.normalize import clean_table, infer_date_formats

            chosen = [infer_date_formats({name: part}) if date_formats is None else date_formats for part in parts]
            parts = [clean_table(part, name, keep_extra=keep_extra, date_formats=own)[0] for part, own in zip(parts, chosen, strict=True)]
        tables[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not tables:
        raise SchemaError(
            "No supported files were detected. Supply supplier, material, order and optional quality files."
        )
    return tables
