"""Quality of texts by ordinal regression: one weight per hashed word, ordered thresholds between grades.

The chance of a grade of at most j is the logistic function of threshold j
minus the text's score. One score serves all grades. It gives the expected
grade and the chance of reaching each grade, by which texts are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import mixed, pieces, stored, text_bytes, word_hashes, word_spans

BUCKETS = 1 << 16

# Classes of bytes at the ends of a word.
_CLASS = np.zeros(256, np.uint64)
_CLASS[[*range(65, 91)]], _CLASS[[*range(97, 123)]], _CLASS[[*range(48, 58)]] = 1, 2, 3
_CLASS[128:] = 4
_CLASS[[*b".,"]] = 5
_KINDS = np.zeros((4, 256), bool)
_KINDS[0, 65:91], _KINDS[1, 48:58], _KINDS[3, 10] = True, True, True
_KINDS[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """The chance of at least grade 1, 2, ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text laid end to end, and where each text's begin.

    A word falls into a bucket by its letters, whatever their case, and into
    another by its shape: the kinds of its first two and last bytes and its
    length. A text with words falls into buckets by its shares, in steps: of
    capitals, digits, other signs and line ends among its bytes, and of distinct
    ones among its words.
    """
    starts, ends, counts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = ends - starts
    second = data[np.minimum(starts + 1, ends - 1)] if len(starts) else data[:0]
    shape = _CLASS[data[starts]] * np.uint64(1000) + _CLASS[second] * np.uint64(100) + _CLASS[data[ends - 1]] * np.uint64(10)
    shape = mixed(shape + np.minimum(n, 24).astype(np.uint64) * np.uint64(10007) + np.uint64(1))
    own = np.concatenate([words, shape]) % np.uint64(BUCKETS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(counts)).astype(np.uint64)
    text = np.tile(owner, 2)
    keys = np.unique(text * np.uint64(BUCKETS) + own)
    some = np.flatnonzero(np.diff(counts))
    different = np.bincount((np.unique(owner * np.uint64(BUCKETS) + words % np.uint64(BUCKETS)) // np.uint64(BUCKETS)).astype(np.int64), minlength=len(offsets) - 1)
    shares = [different[some] / np.diff(counts)[some]]
    for kind in _KINDS:
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])[offsets]
        shares.append((np.diff(sums) / np.maximum(1, np.diff(offsets)))[some])
    steps = [mixed(np.floor(24 * np.sqrt(x)).astype(np.uint64) + np.uint64(100 * k + 10**9)) % np.uint64(BUCKETS) for k, x in enumerate(shares)]
    keys = np.unique(np.concatenate([keys, *(some.astype(np.uint64) * np.uint64(BUCKETS) + x for x in steps)]))
    return (keys % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(keys, np.arange(len(offsets)).astype(np.uint64) * np.uint64(BUCKETS))


def _scores(weights: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of a text's weights over the root of their number; 0 for none."""
    sums = np.concatenate([[0.0], np.cumsum(weights[buckets])])
    n = np.diff(at)
    return (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(1, n))


def evidence(buckets: np.ndarray, at: np.ndarray, grades: np.ndarray, n_grades: int, least: int = 5) -> np.ndarray:
    """How much a bucket's presence tells of the grade: the square of its largest log-odds over all cuts between grades.

    Buckets of fewer than ``least`` texts tell nothing.
    """
    texts = np.repeat(np.arange(len(grades)), np.diff(at))
    total = np.bincount(buckets, minlength=BUCKETS)
    best = np.zeros(BUCKETS)
    for cut in range(1, n_grades):
        low = grades < cut
        below = np.bincount(buckets, low[texts], BUCKETS)
        odds = np.log((below + 1) / (low.sum() + 2)) - np.log((total - below + 1) / ((~low).sum() + 2))
        best = np.maximum(best, np.abs(odds))
    return best**2 * (total >= least)


def train(buckets: np.ndarray, at: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 200, rate: float = 0.2, decay: float = 1e-5) -> OrdinalModel:
    """Weights and thresholds by Adam on the mean log-likelihood of all texts. The same input gives the same model."""
    n = np.diff(at)
    owner, scale = np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(1, n))
    told = evidence(buckets, at, grades, n_grades)
    value = told[buckets]
    weights = np.zeros(BUCKETS)
    steps = np.concatenate([[-1.0], np.full(n_grades - 2, np.log(2.0))])
    first, second = [np.zeros_like(weights), np.zeros_like(steps)], [np.zeros_like(weights), np.zeros_like(steps)]
    rows = np.arange(len(grades))
    for k in range(1, rounds + 1):
        limits = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        scores = np.bincount(owner, weights[buckets] * value, len(n)) * scale
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - limits[None, :], -60, 60)))
        cumulative = np.concatenate([np.zeros((len(n), 1)), below, np.ones((len(n), 1))], 1)
        p = np.maximum(cumulative[rows, grades + 1] - cumulative[rows, grades], 1e-9)
        slope = np.concatenate([np.zeros((len(n), 1)), below * (1 - below), np.zeros((len(n), 1))], 1)
        up, down = slope[rows, grades + 1] / p, slope[rows, grades] / p
        by_score = (up - down) / len(n)
        by_limit = np.zeros(n_grades + 1)
        np.add.at(by_limit, grades + 1, -up / len(n))
        np.add.at(by_limit, grades, down / len(n))
        inner = by_limit[1:-1]
        tail = np.cumsum(inner[::-1])[::-1]
        gradients = [np.bincount(buckets, (by_score * scale)[owner] * value, BUCKETS) + decay * weights, np.concatenate([tail[:1], tail[1:] * np.exp(steps[1:])])]
        for x, g, m, v in zip((weights, steps), gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return OrdinalModel(weights * told, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])])))


def held_out(name: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def rated(labels: DataFrame) -> DataFrame:
    """``rated_id, grade`` from ``labels(doc_id, quality, toxic)``: 0 for toxic texts, else 1 for poor and 2 for good ones.

    Rows that leave the grade open are no ratings. Of several for a document
    the lowest counts.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("rated_id"), grade.alias("grade")).where("rated_id is not null and grade is not null")
    return rows.groupBy("rated_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = 1500, **options) -> OrdinalModel | None:
    """Learn from ``docs(doc_id, text)`` and ``ratings(rated_id, grade)``, grades from 0.

    A documented sample: of each grade at most ``per_grade`` documents that
    are not held out, chosen by hash. The driver gets their distinct buckets,
    at most as many as there are. Without ratings of two grades there is no
    model.
    """
    wanted = ratings.withColumns({"rank": F.xxhash64("rated_id"), "part": F.pmod(F.xxhash64("rated_id", F.lit(1)), F.lit(32))})
    wanted = wanted.where(~held_out("rated_id"))
    for by in (["grade", "part"], ["grade"]):
        wanted = wanted.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "rated_id"))).where(F.col("n") <= per_grade).drop("n")
    wanted = stored(wanted.select("rated_id", "grade"), "rated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            found = []
            for i, j in pieces(offsets, 1 << 20):
                own, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found += [own[at[d] : at[d + 1]].astype("<u2").tobytes() for d in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "grade", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(wanted), F.col("id") == F.col("rated_id")).select("id", "grade", "text")
    rows = sorted((r.id, bytes(r.buckets), r.grade) for r in rows.mapInArrow(run, "id long, grade int, buckets binary").collect())
    grades = np.array([g for _, _, g in rows], int)
    if len(set(grades.tolist())) < 2:
        return None
    buckets = [np.frombuffer(b, "<u2") for _, b, _ in rows]
    at = np.concatenate([[0], np.cumsum([len(b) for b in buckets])])
    return train(np.concatenate(buckets).astype(np.int64), at, grades, max(2, int(grades.max()) + 1), **options)


def grade(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_prob, kept`` of every whole text of ``docs(doc_id, text)``.

    tail_prob: the chance of the highest grade; kept: whether it is ``least``
    or more. A text without words has score 0. Without a model expected_grade
    and tail_prob are null and everything is kept. Each row is answered for
    itself, so nulls in doc_id and repeated rows change nothing. Other columns
    are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n = len(batch)
            scores = np.zeros(n)
            if model is None:
                nothing = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), nothing, nothing, pa.array(np.ones(n, bool))], ["doc_id", "expected_grade", "tail_prob", "kept"])
                continue
            for i, j in pieces(offsets, 1 << 20):
                own, at = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                scores[i:j] = _scores(model.weights, own, at)
            tails = model.tails(scores)
            columns = [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_prob", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, kept boolean")
