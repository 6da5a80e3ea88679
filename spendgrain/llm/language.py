"""Language of texts by a recurrent network over bytes: every position is labelled, documents pool their positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm import gru
from spendgrain.llm.common import fresh, parts_of, pieces, text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    network: gru.Network | None


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = 500, chars: int = 384) -> DataFrame:
    """``lang, part``: one passage each of at most so many documents per language, chosen by hash.

    Only documents with a doc_id, a language and a letter that are not held
    out are seen. The best of each part of a language are found first, so a
    language with most of the rows is no single task's work.
    """
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    text = F.col("text").cast("string")
    place = F.xxhash64(text, F.lit(1))
    passage = F.substring(text, (F.pmod(place, F.greatest(F.length(text) - chars, F.lit(0)) + 1) + 1).cast("int"), F.lit(chars))
    rows = seen.select(F.col("lang").cast("string").alias("lang"), passage.alias("part"), F.xxhash64(text, "doc_id").alias("rank"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang", F.pmod("rank", F.lit(64))).orderBy("rank", "part"))).where(F.col("n") <= per_language).drop("n")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "part"))).where(F.col("n") <= per_language)
    return best.select("lang", "part")


def fit(docs: DataFrame, per_language: int = 500, window: int = 128, **options) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)``.

    The passages of the sample, at most ``per_language`` a language, are
    trained on by the driver. Without any, the model knows no language.
    """
    rows = sorted((r.lang, r.part) for r in training_sample(docs, per_language).collect())
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return LanguageModel([], None)
    texts = [part.encode() for _, part in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    windows, owner = gru.cut(np.frombuffer(b"".join(texts), np.uint8), offsets, window)
    labels = np.array([languages.index(lang) for lang, _ in rows])[owner]
    return LanguageModel(languages, gru.train(windows, labels, len(languages), **options))


_BATCH = 2048


def _pooled(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, positions: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean probability of each language over a text's positions; if asked for, the label of each position."""
    net, n = model.network, len(offsets) - 1
    sums = np.zeros((n, len(model.languages)))
    labels: list[list[np.ndarray]] = [[] for _ in range(n)] if positions else []
    for i, j in pieces(offsets, net.window * _BATCH):
        windows, owner = gru.cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], net.window)
        for k in range(0, len(windows), _BATCH):
            own = np.ascontiguousarray(windows[k : k + _BATCH].T, np.intp)
            p = gru.position_probabilities(net, own)
            for x in np.flatnonzero(own[-1] == gru.FILL):
                p[own[:, x] == gru.FILL, :, x] = 0
            np.add.at(sums, i + owner[k : k + _BATCH], p.sum(0, dtype=np.float64).T)
            if positions:
                for x, d in enumerate(owner[k : k + _BATCH]):
                    labels[i + d].append(p[own[:, x] != gru.FILL, :, x].argmax(1))
    return sums / np.maximum(1, np.diff(offsets))[:, None], [np.concatenate(x) if x else np.empty(0, int) for x in labels]


def _runs(labels: np.ndarray, languages: list[str]) -> list[dict]:
    edges = np.flatnonzero(np.diff(labels)) + 1
    ends = [*edges.tolist(), len(labels)]
    return [{"start": a, "end": b, "lang": languages[labels[a]]} for a, b in zip([0, *edges.tolist()], ends, strict=True) if b > a]


def identify(docs: DataFrame, model: LanguageModel, positions: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; with positions also ``runs``, the byte ranges of equal labels.

    A text that is null or has no letter, or any text for a model that knows
    no language, gets ``und`` and score 0. Among equal scores the first
    language in code-point order wins. Each row is answered for itself, so
    nulls in doc_id and repeated rows change nothing. Other columns are not
    read. An empty table gives no rows.
    """
    kinds = "doc_id long, lang_pred string, score double" + (", runs array<struct<start:int,end:int,lang:string>>" if positions else "")
    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            names, scores, runs = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if model.network is not None and n:
                data, offsets = text_bytes(batch.column(1))
                p, labels = _pooled(model, data, offsets, positions)
                for d in np.flatnonzero(np.diff(offsets)):
                    names[d] = model.languages[int(p[d].argmax())]
                    scores[d] = min(1.0, p[d].max())
                    if positions:
                        runs[d] = _runs(labels[d], model.languages)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores)]
            if positions:
                columns.append(pa.array(runs, runs_type))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kinds.split(", ")][: len(columns)])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.when(text.rlike(r"\p{L}"), text)).mapInArrow(run, kinds)


def least_score(languages: int, above_chance: float = 1 / 15) -> float:
    """The score that lies such a part of the way from chance to certainty; with one language there is nothing to tell, and it is 0."""
    return 0.0 if languages < 2 else 1 / languages + above_chance * (1 - 1 / languages)


def recognised(docs: DataFrame, above_chance: float = 1 / 15, **options) -> DataFrame:
    """The rows of docs whose language the model tells with at least ``least_score`` of its languages, with all their columns.

    The model is fitted to docs itself. The language of a kept row is left as
    it is given where it is given, and filled with the prediction where it is
    null. Where no language can be learned, because no document outside the
    held-out part has one, all rows whose text has a letter are kept, and
    languages are left as they are.
    """
    model = fit(docs, **options)
    least = least_score(len(model.languages), above_chance)
    (flag,) = fresh(docs, "named")
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            *rest, named = (batch.column(k) for k in range(batch.num_columns))
            texts = batch.column(columns.index("text"))
            keep = named.to_numpy(zero_copy_only=False)
            names = [None] * len(batch)
            if model.network is not None and len(batch):
                data, offsets = text_bytes(texts.cast(pa.string()))
                p, _ = _pooled(model, data, offsets, False)
                keep = keep & (p.max(1) >= least)
                names = [model.languages[k] for k in p.argmax(1)]
            at = columns.index("lang")
            lang = pa.array([x if x is not None else y for x, y in zip(rest[at].to_pylist(), names, strict=True)], rest[at].type)
            rest[at] = lang
            yield pa.RecordBatch.from_arrays(rest, columns).filter(pa.array(keep))

    text = F.col("text").cast("string")
    return docs.withColumn(flag, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
