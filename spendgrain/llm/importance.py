"""Target-distribution importance resampling with bit-sliced sums.

Runs of one to three words are hashed into buckets. A bucket's gain says how
much more common it is in the target than in the corpus. A document's bucket
counts are cut into bit planes: plane j holds, for every bucket, bit j of its
count. Gains become planes as well, positive and negative ones apart. The
weight of a document is then the sum over pairs of planes of a power of two
times the number of buckets set in both, which is exact. Gumbel noise from a
hash of the id turns weights into scores; the highest scores are the sample.

Corpus and target are counted in one map pass each, with one number per bucket
and task; documents are weighed in a second pass. Ranks come from ranges of
scores, so nothing is ordered in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import fresh, parts_of, stored, text_bytes, word_spans

BUCKETS = 10_000
DOCUMENTS = 256  # weighed together
WORDS = 1 << 18  # hashed together
LONGEST = 64  # bytes of a word that the tables of shifts reach

# Words are runs of ASCII digits, letters and all bytes of other characters.
BREAK = np.ones(256, bool)
BREAK[0x30:0x3A] = BREAK[0x41:0x5B] = BREAK[0x61:0x7B] = BREAK[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

ALL = np.uint32(0xFFFFFFFF)
_8, _255 = np.uint32(8), np.uint32(255)


def _byte_table() -> np.ndarray:
    """What a byte does to a CRC-32, by the reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


TABLE = _byte_table()


def _zero_bytes(crc: np.ndarray, n: int = 1) -> np.ndarray:
    """CRCs as n zero bytes leave them, but for the inversion at both ends."""
    for _ in range(n):
        crc = TABLE[crc & _255] ^ (crc >> _8)
    return crc


def _parts(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear step given for each value of each of the four bytes."""
    return step[0][crc & _255] ^ step[1][(crc >> _8) & _255] ^ step[2][(crc >> np.uint32(16)) & _255] ^ step[3][crc >> np.uint32(24)]


_UNIT = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * _8)[:, None]


def _shift_tables() -> np.ndarray:
    out = [_UNIT]
    for _ in range(LONGEST):
        out.append(_zero_bytes(out[-1]))
    return np.stack(out)


SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved by its own number of bytes."""
    short = np.minimum(lengths, LONGEST)
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= SHIFT[short, k, (crc >> np.uint32(8 * k)) & _255]
    over = np.flatnonzero(lengths > LONGEST)
    if len(over):
        left, step = lengths[over] - LONGEST, SHIFT[1]
        while left.any():
            odd = (left & 1).astype(bool)
            out[over[odd]] = _parts(step, out[over[odd]])
            left, step = left >> 1, np.stack([_parts(step, row) for row in step])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: all words byte by byte together, long ones by themselves."""
    clipped = np.minimum(ends - starts, LONGEST + 1)
    order = np.argsort(-clipped, kind="stable")
    at = starts[order]
    as_long = np.cumsum(np.bincount(clipped, minlength=LONGEST + 2)[::-1])[::-1]
    crc = np.full(len(at), ALL)
    for i in range(LONGEST):
        live = as_long[i + 1]
        if not live:
            break
        crc[:live] = TABLE[(crc[:live] ^ data[at[:live] + i]) & _255] ^ (crc[:live] >> _8)
    out = np.empty_like(crc)
    out[order] = crc ^ ALL
    for k in order[: as_long[LONGEST + 1]]:
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more byte, a space."""
    inner = crc ^ ALL
    return TABLE[(inner ^ np.uint32(32)) & _255] ^ (inner >> _8) ^ ALL


def features(column: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and, block by block, text and bucket of every run of one to three words, ordered by text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, BREAK)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(starts), WORDS):
            a, b = starts[i : i + WORDS + 2], ends[i : i + WORDS + 2]
            owner = np.searchsorted(before, np.arange(i, i + len(a)), side="right") - 1
            single = run = word_crcs(data, a, b)
            owners, found = [owner[:WORDS]], [run[:WORDS]]
            for more in (1, 2):
                run = _shifted(_spaced(run[:-1]), (b - a)[more:]) ^ single[more:]
                whole = (owner[: len(run)] == owner[more:])[:WORDS]
                owners.append(owner[: len(run)][:WORDS][whole])
                found.append(run[:WORDS][whole])
            every = np.concatenate(owners)
            order = np.argsort(every, kind="stable")
            yield every[order], (np.concatenate(found) % np.uint32(BUCKETS))[order].astype(np.int64)

    return np.diff(before), blocks()


def runs(words: np.ndarray) -> np.ndarray:
    """How many features so many words have."""
    return words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows of ``docs(text)``; a task sends at most one row per bucket. Null texts count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for part in parts_of(batches, "text"):
            for _, buckets in features(part.column(0))[1]:
                held += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Per bucket: floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))."""
    all_s, all_t = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    ratio = ((target.get(b, 0) + 1.0) * all_s / ((corpus.get(b, 0) + 1.0) * all_t) for b in range(BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


WIDTH = -(-BUCKETS // 64)  # numbers of 64 bits in a plane


def _plane(buckets: np.ndarray) -> np.ndarray:
    """Set bits as 64-bit numbers, from ascending places without repeats."""
    number = buckets >> 6
    first = np.flatnonzero(np.diff(number, prepend=-1))
    bits = np.uint64(1) << (buckets & 63).astype(np.uint64)
    return number[first], np.bitwise_or.reduceat(bits, first)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A factor, plus or minus a power of two, and the plane of the buckets whose gain has it."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gain, 0)
        for bit in range(int(size.max(initial=0)).bit_length()):
            plane = np.zeros(WIDTH, np.uint64)
            at, numbers = _plane(np.flatnonzero(size >> bit & 1)) if (size >> bit & 1).any() else (np.empty(0, np.int64), 0)
            plane[at] = numbers
            out.append((sign << bit, plane))
    return out


def count_planes(counts: np.ndarray) -> list[np.ndarray]:
    """Plane j of every document (rows of counts, columns are buckets): bit j of its counts."""
    flat = np.pad(counts, ((0, 0), (0, 64 * WIDTH - counts.shape[1]))).ravel()
    at = np.flatnonzero(flat)
    own = flat[at]
    planes = []
    while len(at):
        plane = np.zeros(len(counts) * WIDTH, np.uint64)
        odd = at[(own & 1).astype(bool)]
        if len(odd):
            places, numbers = _plane(odd)
            plane[places] = numbers
        planes.append(plane.reshape(len(counts), WIDTH))
        at, own = at[own > 1], own[own > 1] >> 1
    return planes


def bit_sliced(counts: np.ndarray, gain: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The exact sum of counts times gains for each document."""
    weights = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(count_planes(counts)):
        for factor, other in gain:
            weights += np.bitwise_count(plane & other).sum(1, dtype=np.int64) * (factor << j)
    return weights


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` per row of ``docs(doc_id, text)``.

    DOCUMENTS rows are weighed together; a long text is hashed in blocks of
    words, so beside the text itself memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_planes(gain)
        for part in parts_of(batches, "text"):
            words, blocks = features(part.column("text"))
            weights = np.zeros(len(words), np.int64)
            group, counts = -1, np.empty((0, BUCKETS), np.int64)
            for owners, buckets in blocks:
                groups, first = np.unique(owners // DOCUMENTS, return_index=True)
                for g, low, high in zip(groups.tolist(), first, [*first[1:], len(owners)], strict=True):
                    at = g * DOCUMENTS
                    n = min(DOCUMENTS, len(words) - at)
                    found = np.bincount((owners[low:high] - at) * BUCKETS + buckets[low:high], minlength=n * BUCKETS).reshape(n, BUCKETS)
                    counts = counts + found if g == group else found
                    group = g
                    # A group that the next block goes on with is weighed again then.
                    weights[at : at + n] = bit_sliced(counts, planes)
            columns = [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(runs(words), pa.int64()), pa.array(weights)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _chosen(df: DataFrame, number: str, wanted: int, most: int, least: int, bins: int = 4096) -> int:
    """A value that at least ``wanted`` rows reach, near the largest such one: from counts in ranges of equal width."""
    width = max(1, -(-(most - least + 1) // bins))
    at = F.floor((F.lit(most) - F.col(number)) / F.lit(width))
    total = 0
    for row in sorted(df.groupBy(at.alias("bin")).count().collect()):
        total += row["count"]
        if total >= wanted:
            return most - (row["bin"] + 1) * width + 1
    return least


def draw(scored: DataFrame, percent: int = 5) -> DataFrame:
    """Ranks of the highest scores: ``doc_id, n_features, weight, score, rank`` for all rows of ``scored`` with ``eligible``.

    floor(percent * N / 100) of the N eligible rows are drawn; ties go to
    smaller doc_ids, null last, then to higher weights; rows alike in all of
    these are drawn in any order. Counts of score ranges say below which score no row is drawn; the
    others are dealt into ranges, and a rank is the number of rows in higher
    ranges plus the place in its own.
    """
    row, part, before = fresh(scored, "row", "part", "before")
    kept = stored(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    usable = kept.where("eligible")
    n, most, least = usable.agg(F.count(F.lit(1)), F.max("score"), F.min("score")).head()
    wanted = n * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return kept.select(*names, none)
    reaches = F.col("eligible") & (F.col("score") >= _chosen(usable, "score", wanted, most, least))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col(row)]
    dealt = stored(kept.where(reaches).repartitionByRange(*order).select(*names, row, F.spark_partition_id().alias(part)), "ranges")
    above = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part).count().select(F.col(part).alias(part), F.coalesce(F.sum("count").over(above), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before)
    ranked = dealt.join(F.broadcast(sizes), part).select(*names, place.cast("long").alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return kept.where(~reaches).select(*names, none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs(doc_id, text)``; rank is null for rows not drawn.

    target: a table with ``text`` whose distribution is wanted. Null and empty
    texts have no features, weight 0 and a score, and are not drawn. A null
    doc_id gets the noise of an empty id. Repeated rows stand for themselves;
    rows with one id share their noise. An empty table gives no rows, an empty
    target gains from counts of 0. Other columns are not read.
    """
    corpus, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(d).collect()} for d in (docs, target))
    weighed = weigh(docs, gains(corpus, wanted))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return draw(scored, percent)
