"""Near-duplicate texts: SetSketch registers of word shingles, banded, estimated by likelihood, verified on full sets.

A text is the set of its distinct runs of ``width`` lower-cased words. Its
sketch has one register per hash function: the smallest of the set's hash
values, read as an exponential variable and kept as the floor of a logarithm to
a base close to 1. Registers of a union are the larger of the two, and equal
registers are about as frequent as the Jaccard similarity. The steps:

1. One pass over the texts makes a row each: size, identity and sketch of the
   set. Texts with equal sets become one class.
2. Classes with an equal band of registers fall in a bucket. In every bucket
   all classes are compared with one of them, so large groups of near copies
   become one component without listing their pairs. This can be repeated
   with other centres for buckets that still hold several components.
3. Buckets that still do are compared completely, in tiles of bounded size:
   every pair from different components, each in the first band it shares.
   Pairs are never listed: a task gives the links that join its components.
4. A pair is open if the likelihood of its registers leaves the wanted
   similarity open. It is confirmed by the two whole sets.

Components need no link inside what is already connected, so none that could
change the result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendgrain.llm.common import _odd, fresh, mixed, pieces, stored, within, text_bytes, word_hashes, word_spans
from spendgrain.llm.components import connected_components

ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
_RNG = np.random.default_rng(7)
_XOR, _TIMES, _WORD = _odd(_RNG, REGISTERS), _odd(_RNG, REGISTERS), _odd(_RNG, 256)
_UNSEEN = np.uint64(2**64 - 1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts laid end to end, and where each text's begin.

    counts: the number of words before each text, and of all. A text of fewer
    words has one shingle of them all, a text without words none.
    """
    n = np.diff(counts)
    shingles = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(shingles)])
    full = max(0, len(words) - width + 1)
    sums = np.zeros(full, np.uint64)
    for j in range(width):
        sums += words[j : j + full] * _WORD[j]
    where = np.arange(at[-1]) + np.repeat(counts[:-1] - at[:-1], shingles)
    out = np.empty(at[-1], np.uint64)
    whole = np.repeat(n >= width, shingles)
    out[whole] = sums[where[whole]]
    for d in np.flatnonzero((n > 0) & (n < width)):
        own = words[counts[d] : counts[d + 1]]
        out[at[d]] = np.append(own * _WORD[: len(own)], _WORD[255 - len(own)]).sum(dtype=np.uint64)
    return mixed(out), at


def minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over each text's shingles; texts without any hold the largest number."""
    out = np.full((len(at) - 1, REGISTERS), _UNSEEN)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for j in range(REGISTERS):
            values = hashes ^ _XOR[j]
            values *= _TIMES[j]
            out[some, j] = np.minimum.reduceat(values, at[some])
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Register values of minima: 1 - log(x) to the base, x exponential with the given rate, cut to 0 .. TOP + 1."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


SKETCH = "doc_id long, text_hash long, n_shingles long, set_id binary, registers binary"


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


_STEP_BYTES = 1 << 20


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with the hashes of their shingles and where each text's begin."""
    data, offsets = text_bytes(batch.column(1))
    for i, j in pieces(offsets, _STEP_BYTES):
        own = data[offsets[i] : offsets[j]]
        starts, ends, counts = word_spans(own, offsets[i : j + 1] - offsets[i])
        yield i, j, *shingle_hashes(word_hashes(own, starts, ends), counts, width)


def _identity(own: np.ndarray) -> bytes:
    """16 bytes that stand for a set of hashes: the sum of two remixed copies."""
    return mixed(own).sum(dtype=np.uint64).tobytes() + mixed(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).tobytes()


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id, registers`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, values = [], [], []
            for i, j, hashes, at in _sets(batch, width):
                values.append(registers(minima(hashes, at)))
                for d in range(j - i):
                    own = np.unique(hashes[at[d] : at[d + 1]])
                    sizes.append(len(own))
                    names.append(_identity(own))
            rows = [x.tobytes() for part in values for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "registers"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash()).mapInArrow(run, SKETCH)


_GRID = np.linspace(0, 1, 65)


def _log_likelihood(less: np.ndarray, more: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are smaller and larger, and the sets' shares of their summed size."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
    return more * np.log(up) + less * np.log(down) + (REGISTERS - less - more) * np.log(np.maximum(1 - up - down, 1e-9))


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float, slack: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of pairs of sketches with sizes n and m, and whether the wanted one stays open.

    A pair is refused only if its registers are exp(slack) times as likely
    under a smaller similarity as under the wanted one.
    """
    less, more = (a < b).sum(1)[:, None], (a > b).sum(1)[:, None]
    total = (n + m)[:, None].astype(float)
    u, v = n[:, None] / total, m[:, None] / total
    top = np.minimum(u / v, v / u)
    values = _log_likelihood(less, more, u, v, _GRID * top)
    best = values.argmax(1)
    guess = (_GRID[None, :] * top)[np.arange(len(best)), best]
    wanted = _log_likelihood(less, more, u, v, np.minimum(similarity, top))[:, 0]
    possible = np.minimum(n, m) * 100 >= round(similarity * 100) * np.maximum(n, m)
    return guess, possible & ((guess >= similarity) | (values.max(1) - wanted <= slack))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, width)


def _plausible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sketches leave the similarity open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), "<u2", REGISTERS) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            parts = [likely(x[i : i + _PAIRS], y[i : i + _PAIRS], n[i : i + _PAIRS], m[i : i + _PAIRS], similarity)[1] for i in range(0, len(n), _PAIRS)]
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(parts)) if parts else pa.array([], pa.bool_()))

    first = classes.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("n"), F.col("registers").alias("x"))
    second = classes.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("m"), F.col("registers").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a binary, b binary")


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``set_id, hashes`` of the wanted sets, made again from the text of one document each; wanted: doc_id, set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for i, j, hashes, at in _sets(batch, width):
                for d in range(j - i):
                    own = np.unique(hashes[at[d] : at[d + 1]])
                    names.append(_identity(own))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["set_id", "hashes"])
        pa.default_memory_pool().release_unused()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = within(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), 1_000_000)
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = texts.mapInArrow(run, "set_id binary, hashes binary")
    return sets.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of pairs(a, b) with 100 * intersection >= percent * union, counted on the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pair in zip(batch.column("x"), batch.column("y"), strict=True):
                keep.append(_contains(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = stored(classes.join(ids, "set_id", "left_semi").select("doc_id", "set_id"), "wanted")
    sets = stored(_whole_sets(docs, wanted, width), "sets")
    first = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _spread(bands: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the bucket's number of rows."""
    kept = bands.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"))
    kept = kept.where("low != high").select(F.col("bucket").alias("own"), "held")
    return bands.join(kept, F.col("bucket") == F.col("own")).drop("own")


def _stars(bands: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class in a bucket with the bucket's centre of this turn, where their components differ."""
    rank = F.struct(F.xxhash64("set_id", F.lit(turn)).alias("h"), "set_id", "root", "n_shingles")
    centres = bands.groupBy("bucket").agg(F.min(rank).alias("c")).select(F.col("bucket").alias("own"), "c.*")
    centres = centres.select("own", F.col("set_id").alias("c_id"), F.col("root").alias("c_root"))
    joined = bands.join(centres, F.col("bucket") == F.col("own")).where(F.col("root") != F.col("c_root"))
    return joined.select(F.least("set_id", "c_id").alias("a"), F.greatest("set_id", "c_id").alias("b")).distinct()


_TILE = 512
_PAIRS = 1024  # compared together


def _open_pairs(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the plausible pairs of different components in each unit, in the first band they share. Rows of a unit lie together."""
    group = rows.column("unit").to_numpy()
    tile, band = rows.column("tile").to_numpy(), rows.column("band").to_numpy()
    n, root = rows.column("n_shingles").to_numpy(), rows.column("root_no").to_numpy()
    same_tile = rows.column("same_tile").to_numpy()
    values = _matrix(rows.column("registers").combine_chunks(), "<u2", REGISTERS)
    low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = 1
    left = np.arange(len(group) - 1)
    while len(left):
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        for k in range(0, len(left), _PAIRS):
            i = left[k : k + _PAIRS]
            j = i + step
            ok = (root[i] != root[j]) & (same_tile[i] | (tile[i] != tile[j]))
            i, j = i[ok], j[ok]
            if len(i):
                x, y = values[i], values[j]
                ok = (x == y).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
                i, j, x, y = i[ok], j[ok], x[ok], y[ok]
                ok = likely(x, y, n[i], n[j], similarity)[1]
                low.append(i[ok])
                high.append(j[ok])
        step += 1
    return np.concatenate(low), np.concatenate(high)


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole units, which lie together in the stream."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        if not len(unit):
            continue
        others = np.flatnonzero(unit != unit[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or (rest and rest[-1].column("unit")[0].as_py() != unit[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _contains(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    near = y[np.minimum(np.searchsorted(y, x), len(y) - 1)]
    both = int((near == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _tiles(bands: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that join the components of each bucket as all its pairs would.

    A bucket is cut into tiles; every pair of tiles is a unit of bounded size.
    At first the sketches tell which classes of a unit are in an open pair.
    Those meet again in their units with their whole sets. A task confirms
    open pairs until its classes are joined and gives the links that joined
    them, so a group yields fewer links than it has classes.
    """
    similarity = percent / 100
    columns = ["unit", "set_id", "band", "root_no", "tile", "same_tile"]
    kinds = "unit long, set_id binary, band int, root_no long, tile int, same_tile boolean"

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_unit(batches):
            i, j = _open_pairs(rows, similarity)
            yield from rows.select(columns).take(pa.array(np.unique(np.concatenate([i, j])))).to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_unit(batches):
            ids, sets = rows.column("set_id").to_pylist(), rows.column("hashes").combine_chunks()
            root = {}

            def find(x: int, root: dict = root) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            names = rows.column("root_no").to_pylist()
            links = []
            for i, j in zip(*(x.tolist() for x in _open_pairs(rows, similarity)), strict=True):
                one, other = find(names[i]), find(names[j])
                if one != other and _contains(*(np.frombuffer(sets[k].as_buffer(), np.uint64) for k in (i, j)), percent):
                    root[one] = other
                    links.append((ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in range(2)], ["a", "b"])

    tiles = F.ceil(F.col("held") / _TILE).cast("int")
    rows = bands.select("set_id", "bucket", "band", F.xxhash64("root").alias("root_no"), tiles.alias("tiles"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other"))
    rows = rows.select(unit.alias("unit"), "set_id", "band", "root_no", "tile", (F.col("tile") == F.col("other")).alias("same_tile"))
    sketches = classes.select("set_id", "n_shingles", "registers")
    open_ = rows.join(sketches, "set_id").repartition("unit").sortWithinPartitions("unit").mapInArrow(flag, kinds)
    open_ = stored(open_, "open")
    wanted = stored(classes.join(open_.select("set_id").distinct(), "set_id", "left_semi").select("doc_id", "set_id"), "wanted")
    sets = _whole_sets(docs, wanted, width).join(sketches, "set_id")
    return open_.join(sets, "set_id").repartition("unit").sortWithinPartitions("unit").mapInArrow(join, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, star_turns: int = 1) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, root`` for each row of ``docs(doc_id, text)``.

    Two texts are linked if 100 * intersection >= percent * union of their
    shingle sets. component_id is the smallest doc_id reachable over links,
    kept tells whether it is the row's own; root names the component whatever
    its doc_ids are, and is null where the set is empty.

    Null texts and texts without words have an empty set, link with nothing
    and are kept. Equal texts are linked. Rows that share a doc_id are each
    compared by their own text; a component whose doc_ids are all null has
    component_id null, and those rows are kept. Other columns are not read. An
    empty table gives no rows. Sets are held as 64-bit hashes of their
    shingles.
    """
    similarity = percent / 100
    sketches = stored(sketch(docs, width), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = stored(classes, "classes")
    keys = [F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)]
    bands = classes.select("set_id", "n_shingles", F.posexplode(F.array(*keys)).alias("band", "bucket")).withColumn("root", F.col("set_id"))
    links = None
    roots = None
    for turn in range(star_turns + 1):
        if roots is not None:
            named = roots.select(F.col("node").alias("set_id"), F.col("root").alias("new_root"))
            bands = bands.join(named, "set_id", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        bands = stored(_spread(bands.drop("held")), "bands")
        if bands.isEmpty():
            break
        if turn < star_turns:
            pairs = stored(_plausible(_stars(bands, turn), classes, similarity), "pairs")
            found = _confirmed(pairs, docs, classes, percent, width)
        else:
            found = _tiles(bands, docs, classes, percent, width)
        found = stored(found, "found").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links)
    named = classes.select("set_id", F.col("doc_id").alias("least_id"))
    named = named.withColumns({"node": F.col("set_id"), "root": F.col("set_id")}) if roots is None else named.join(roots, F.col("set_id") == F.col("node"), "left")
    named = named.select("set_id", "least_id", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "own")
    named = named.join(least, F.col("root") == F.col("own")).select(F.col("set_id").alias("own_set"), "component_id", "root")
    out = sketches.join(named, (F.col("set_id") == F.col("own_set")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash", "root")


def kept_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs of each component, and all rows with empty sets, with all their columns.

    The row with the smallest doc_id stays, a null one only where all are null,
    and of several texts with that doc_id the one with the smallest hash. Only
    decisions that remove something meet the texts.
    """
    by = ["doc_id", "text_hash"]
    key, value = fresh(docs, "key", "value")
    rows = found.groupBy(*by).agg(F.max("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("root").alias("root"))
    rows = stored(rows, "rows")
    several = rows.where("kept and n > 0").groupBy(F.col("root").alias("own")).agg(F.min("text_hash").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    several = within(stored(several, "several"), 1_000_000)
    rows = rows.join(several, F.col("kept") & (F.col("root") == F.col("own")), "left")
    rows = rows.withColumn("kept", F.col("kept") & F.coalesce(F.col("text_hash") == F.col("first"), F.lit(True)))
    rows = rows.where("not kept or (copies > 1 and n > 0)").select(F.col("doc_id").alias(key), F.col("text_hash").alias(value), "kept")
    rows = stored(rows, "decided")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (text_hash() == F.col(value))
    rest = docs.join(within(rows.select(key, value), 1_000_000), same, "left_anti")
    again = rows.where("kept").select(key, value)
    if again.isEmpty():
        return rest
    once = docs.join(again, same).dropDuplicates([key, value]).select([F.col(f"`{c}`") for c in docs.columns])
    return rest.unionByName(once)
