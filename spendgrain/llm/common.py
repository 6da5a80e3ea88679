"""Helpers shared by the operators: stored tables, Arrow batches, byte positions of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendgrain.session import shared_folder


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows written to the shared folder, with options of the writer, and read again.

    Cuts the lineage: a lost executor repeats the reading task, never the work
    before it.
    """
    folder = f"{shared_folder(df.sparkSession, 'llm')}/{name}"
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold at most BATCH_BYTES, as whole texts pass between Spark and Python.

    By default they hold 64 MB, and both sides keep a few of them per task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(1 << 30)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def within(df: DataFrame, rows: int) -> DataFrame:
    """The same rows, marked for a broadcast only if so few were counted; else joins shuffle both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the offsets of each; null is empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


# The bytes of \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text; between: which bytes part words."""
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_RNG = np.random.default_rng(20240229)
_LETTER = _odd(_RNG, 256)
_LETTER[65:91] = _LETTER[97:123]
_STEP = int(_odd(_RNG, 1)[0])
_BACK = pow(_STEP, -1, 2**64)
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_STEP, _BLOCK), _powers(_BACK, _BLOCK)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, whatever stands around it.

    Reads blocks that end between words, so memory beyond the answer is a
    block, or the longest word where that is longer.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        n = int(ends[j - 1] - low)
        up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_STEP, n), _powers(_BACK, n))
        sums = np.zeros(n + 1, np.uint64)
        values = _LETTER[data[low : low + n]]
        values *= up[:n]
        np.cumsum(values, out=sums[1:])
        a = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[a]) * down[a]
        i = j
    return mixed(out ^ (ends - starts).astype(np.uint64))


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts_of(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about so many bytes of text; memory no slice needs is given back in the end."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        if not len(batch):
            yield batch
        for i, j in pieces(offsets, size):
            yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()
