"""Near-duplicate vectors: all pairs with a cosine of a threshold or more, by PCA-ordered tiles.

Each unit vector lies in the cell of the nearest of some pivots, at an angle.
Two vectors as near as asked for differ in their angles to any pivot by the
angle between them at most, so a vector meets only cells whose pivot it is near
enough to, and of each pair the one nearer to its own pivot is met by the
other. Cells are put into tiles of bounded size along the first principal axis;
tiles too far apart on it are never compared. Every vector is stored in one
tile, and pairs of tiles are read from there, so nothing is copied for them.

Inside a pair of tiles vectors are turned so that the directions in which they
differ most come first, and products are added up over the leading dimensions
first. What the others can still add is at most the product of the norms of the
two remainders, and a pair stops where that cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendgrain.llm.common import small_batches, stored
from spendgrain.llm.components import connected_components

TILE, TILE_BYTES, TILES, BLOCK = 32768, 8 << 20, 16, 1024  # a tile's most rows and bytes, tiles of a table large enough, rows compared at once
PIVOTS, PIVOT_BYTES, CELL = 65536, 32 << 20, 256  # most pivots of a table, and bytes of a length; rows of a cell, at least
LEADING, BAND = 16, 256  # dimensions multiplied first; rows of a cell that guests are chosen for together
NEAR = 1e-9  # products that close to the threshold are formed again from the given components
ROUGH = 1e-5  # more than products of 64 or fewer numbers of 32 bits can be wrong by


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, v, h, k`` of the vectors that can link: components as given if of 32 bits, else as doubles, and two hashes of them."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), _components(table).alias("v")).where(linkable(F.col("v")) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("k"))


def _components(table: DataFrame) -> Column:
    kind = table.schema["embedding"].dataType
    short = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col("embedding").cast("array<float>" if short else "array<double>")


def usable(v: Column) -> Column:
    """Neither null nor empty, nor holding null, infinite or undefined components."""
    known = ~F.array_contains(v, F.lit(float("nan")))  # null where a component is, and none is undefined
    return F.coalesce(known & (F.array_max(v) < float("inf")) & (F.array_min(v) > -float("inf")), F.lit(False))


def linkable(v: Column) -> Column:
    return usable(v) & F.coalesce((F.array_max(v) != 0) | (F.array_min(v) != 0), F.lit(False))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column("v").offsets.to_numpy())
    for d in np.unique(lengths):
        yield int(d), batch.filter(pa.array(lengths == d))


def principal_axes(rows: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """For each length of vectors the axes (columns) of their unit vectors, by falling variance, and their number.

    Products are summed up by the executors; the driver gets one number per
    pair of components. Vectors that are equal within a batch count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, own in _by_length(batch):
                x = unit_rows(matrix(own.column("v"))[_distinct(own)[0]])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], ["d", "at", "s"])

    found = rows.select("h", "k", "v").mapInArrow(run, "d int, at int, s double").groupBy("d", "at").agg(F.sum("s").alias("s")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in found:
        sums.setdefault(r.d, np.zeros(r.d * r.d))[r.at] = r.s
    axes = {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in sums.items()}
    return axes, {d: round(m.reshape(d, d).trace()) for d, m in sums.items()}


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The first of the rows of each class, and the class of each row."""
    keys = np.empty(len(batch), [("h", np.int64), ("k", np.int64)])
    for c in keys.dtype.names:
        keys[c] = batch.column(c).to_numpy()
    order = np.lexsort((keys["k"], keys["h"]))
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def pivots_of(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length of vectors the unit vectors that cells lie around: some of the rows, by a hash.

    They decide how many pairs are looked at, never which are found. Their
    number grows with the root of that of the rows. Where a length has none, it
    gets one direction.
    """
    n = sum(sizes.values())
    wanted = max(1, min(PIVOTS, 4 * isqrt(n), n // CELL))
    some = rows.where(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(max(1, n // wanted))) == 0).dropDuplicates(["h", "k"]).select("h", "k", "v").toArrow()
    order = np.lexsort((some.column("k").to_numpy(), some.column("h").to_numpy()))
    found = {d: np.eye(1, d) for d in sizes}
    for batch in some.take(order).combine_chunks().to_batches():
        for d, own in _by_length(batch):
            found[d] = unit_rows(matrix(own.column("v"))[: max(1, PIVOT_BYTES // (8 * d))])
    return found


def nearest(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot nearest to each unit vector, but for rounding to 32 bits, and the angle to it."""
    rough, best, cell = units.astype(np.float32), np.full(len(units), -np.inf, np.float32), np.zeros(len(units), np.int32)
    for low in range(0, len(pivots), 4096):
        some = pivots[low : low + 4096].astype(np.float32)
        for x in range(0, len(units), BLOCK):
            product = rough[x : x + BLOCK] @ some.T
            at = product.argmax(1)
            top = product[np.arange(len(at)), at]
            closer = top > best[x : x + BLOCK]
            best[x : x + BLOCK][closer] = top[closer]
            cell[x : x + BLOCK][closer] = at[closer] + low
    return cell, np.arccos(np.clip(np.einsum("ij,ij->i", units, pivots[cell]), -1, 1))


ROW = np.dtype([("id", "<i8"), ("h", "<i8"), ("held", "<i8"), ("angle", "<f8"), ("cell", "<i4")])
TILE_SCHEMA = pa.schema([("tile", pa.int32()), ("last", pa.int32()), ("d", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("rows", pa.binary()), ("given", pa.binary())])


def _tile_numbers(axes: dict[int, np.ndarray], pivots: dict[int, np.ndarray], sizes: dict[int, int], width: int) -> dict[int, tuple[np.ndarray, int, int]]:
    """For each length of vectors the first tile of every cell, the number of tiles of a cell, and the last tile.

    Cells are taken along the first axis. As they lie around rows drawn evenly,
    so many of them hold about as many rows as others do.
    """
    numbers, tile = {}, 0
    for d in sorted(sizes):
        most = max(1, min(TILE, max(4096, -(-sizes[d] // TILES)), TILE_BYTES // (width * d)))
        cells, tiles = len(pivots[d]), -(-sizes[d] // most)
        place = np.empty(cells, np.int64)
        place[np.argsort(pivots[d] @ axes[d][:, 0], kind="stable")] = np.arange(cells)
        parts = -(-tiles // cells)
        first = tile + (place * parts if parts > 1 else place * tiles // cells)
        tile = int(first.max()) + parts
        numbers[d] = first, parts, tile - 1
    return numbers


def _tiles(rows: DataFrame, axes: dict[int, np.ndarray], pivots: dict[int, np.ndarray], sizes: dict[int, int]) -> DataFrame:
    """A row for each tile: its number, the last of its length, the range on the first axis, and its classes by growing angle.

    rows holds ids, hashes, numbers of vectors, angles and cells, given the
    components. Vectors are moved once; equal ones of a batch as one.
    """
    width = 4 if rows.schema["v"].dataType.elementType == T.FloatType() else 8
    numbers = _tile_numbers(axes, pivots, sizes, width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own in _by_length(batch):
                at, of = _distinct(own)
                ids = own.column("vec_id").to_numpy()
                least = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(least, of, ids)
                own = own.take(pa.array(at))
                cell, angle = nearest(unit_rows(matrix(own.column("v"))), pivots[d])
                first, parts, last = numbers[d]
                tile = first[cell] + own.column("h").to_numpy() % parts
                given = own.column("v").flatten()
                given = pa.Array.from_buffers(pa.binary(width * d), len(own), [None, pa.py_buffer(np.ascontiguousarray(given.to_numpy(zero_copy_only=False)))]).cast(pa.binary())
                values = tile.astype(np.int32), np.full(len(at), last, np.int32), np.full(len(at), d, np.int32), least, own.column("h"), own.column("k"), np.bincount(of), given, cell, angle
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], ["tile", "last", "d", "least_id", "h", "k", "held", "v", "cell", "angle"])

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at, of = _distinct(group)
        ids, h, angle, cell = (group.column(c).to_numpy() for c in ("least_id", "h", "angle", "cell"))
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        held = np.bincount(of, group.column("held").to_numpy()).astype(np.int64)
        order = np.lexsort((h[at], least, angle[at]))
        rows = np.empty(len(order), ROW)
        for field, values in (("id", least), ("h", h[at]), ("held", held), ("angle", angle[at]), ("cell", cell[at])):
            rows[field] = values[order]
        tile, last, d = (group.column(c)[0].as_py() for c in ("tile", "last", "d"))
        given = _numbers(b"".join(group.column("v").take(pa.array(at[order])).to_pylist()), len(order), d)
        place = unit_rows(given) @ axes[d][:, 0]
        values = tile, last, d, float(place.min()), float(place.max()), rows.tobytes(), given.tobytes()
        return pa.table([pa.array([x], f.type) for x, f in zip(values, TILE_SCHEMA, strict=True)], schema=TILE_SCHEMA)

    dealt = rows.mapInArrow(deal, "tile int, last int, d int, least_id long, h long, k long, held long, v binary, cell int, angle double")
    return dealt.groupBy("tile").applyInArrow(build, "tile int, last int, d int, low double, high double, rows binary, given binary")


def _numbers(data: bytes | pa.Buffer, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d)


def leading(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The leading dimensions of unit vectors when turned, and the norm of the others, with 32 bits."""
    turned = units @ axes[:, :LEADING]
    rest = np.sqrt(np.maximum(0, 1 - (turned * turned).sum(1, keepdims=True)) + 1e-13)
    return np.concatenate([turned, rest], 1).astype(np.float32)


class Vectors(NamedTuple):
    """Vectors as given, as unit vectors of 32 bits, and what ``leading`` gives of them."""

    given: np.ndarray
    rough: np.ndarray
    leading: np.ndarray

    @classmethod
    def of(cls, given: np.ndarray, axes: np.ndarray) -> Vectors:
        rough = np.empty(given.shape, np.float32)
        ahead = np.empty((len(given), min(LEADING, given.shape[1]) + 1), np.float32)
        for x in range(0, len(given), BLOCK):
            units = unit_rows(given[x : x + BLOCK])
            rough[x : x + BLOCK], ahead[x : x + BLOCK] = units, leading(units, axes)
        return cls(given, rough, ahead)


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few that are true, looked for eight at a time."""
    n = flags.size // 8 * 8
    some = np.flatnonzero(flags[:n].view(np.uint64) != 0)
    inside = (some[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([inside[flags[inside]], n + np.flatnonzero(flags[n:])])


def _near(x: Vectors, of_x: np.ndarray, y: Vectors, of_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in of_x and of_y, rows of x and y, of pairs whose products may reach the threshold, and the products; by growing place in of_x.

    Pairs that the leading dimensions leave open are multiplied with 32 bits,
    and what that leaves open with 64; if most are left open, in full.
    """
    product = x.leading.take(of_x, 0) @ y.leading.take(of_y, 0).T
    at = _true((product >= np.float32(threshold - ROUGH)).ravel())
    if len(at) * 8 > product.size:
        product = unit_rows(x.given[of_x]) @ unit_rows(y.given[of_y]).T
        i, j = np.nonzero(product >= threshold - NEAR)
        return i, j, product[i, j]
    i, j = np.divmod(at, max(1, len(of_y)))
    likely = np.einsum("ij,ij->i", x.rough.take(of_x[i], 0), y.rough.take(of_y[j], 0)) >= threshold - _slack(x.rough.shape[1])
    i, j = i[likely], j[likely]
    if not len(i):
        return i, j, np.empty(0)
    p = np.einsum("ij,ij->i", unit_rows(x.given[of_x[i]]), unit_rows(y.given[of_y[j]]))
    ok = p >= threshold - NEAR
    return i[ok], j[ok], p[ok]


def _slack(d: int) -> float:
    """More than a product of unit vectors of length d with 32 bits can be wrong by."""
    return ROUGH + d * 1.2e-7


def near_in_block(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of two blocks of turned unit vectors, and their products, that may reach the threshold."""
    x, y = (Vectors.of(v, np.eye(v.shape[1])) for v in (a, b))
    return _near(x, np.arange(len(a)), y, np.arange(len(b)), threshold)


def _smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs of 0 to n - 1, less than n, that connect the same; i grows.

    A round takes one pair of each i, and drops those whose ends are connected
    by then.
    """
    label, taken = np.arange(n), []
    while len(i):
        first = np.flatnonzero(np.diff(i, prepend=-1))
        taken.append((i[first], j[first]))
        label = _smallest_reachable(n, *(np.concatenate(x) for x in zip(*taken, strict=True)))
        still = label[i] != label[j]
        i, j = i[still], j[still]
    low = np.flatnonzero(label != np.arange(n))
    return low, label[low]


class Tile:
    """A stored tile, and its cells: which rows each holds, cut into bands of growing angles."""

    def __init__(self, rows: pa.Buffer, given: pa.Buffer, axes: np.ndarray):
        self.rows = np.frombuffer(rows, ROW)
        self.angle, self.held = (np.ascontiguousarray(self.rows[c]) for c in ("angle", "held"))
        self.vectors = Vectors.of(_numbers(given, len(self.rows), len(axes)), axes)
        cell = self.rows["cell"]
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        self.cells = cell[order][starts]
        self.bands = [[own[x : x + BAND] for x in range(0, len(own), BAND)] for own in np.split(order, starts[1:])]


def _guests(hosts: Tile, guests: Tile, pivots: np.ndarray, reach: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows of a band of hosts, and of rows of guests that can be near them and are no nearer to their own pivot."""
    slack = _slack(pivots.shape[1])
    bound = (np.cos(np.minimum(guests.angle + reach, np.pi)) - slack).astype(np.float32)
    at_once = max(1, (1 << 20) // len(guests.angle))
    for low in range(0, len(hosts.cells), at_once):
        products = pivots[hosts.cells[low : low + at_once]].astype(np.float32) @ guests.vectors.rough.T
        for product, bands in zip(products, hosts.bands[low : low + at_once], strict=True):
            for rows in bands:
                angles = hosts.angle[rows]
                start, wide = np.searchsorted(guests.angle, [angles[0], angles[-1]])
                most = np.float32(np.cos(min(angles[-1] + reach, np.pi)) - slack)
                who = np.concatenate([start + _true(product[start:wide] >= bound[start:wide]), wide + _true(product[wide:] >= most)])
                for y in range(0, len(who), block):
                    some = who[y : y + block]
                    met = rows[: np.searchsorted(angles, guests.angle[some[-1]], side="right")]
                    for x in range(0, len(met), block):
                        yield met[x : x + block], some


LINKS = "least_id long, h long, links long, to_id long, to_h long"


def _links_of(a: Tile, b: Tile, pivots: np.ndarray, threshold: float, block: int) -> pa.RecordBatch:
    """The links inside a tile, or those between two."""
    reach = float(np.arccos(np.clip(threshold - 2 * NEAR, -1, 1))) + 1e-7
    n, within = len(a.rows), a is b
    rows = a.rows if within else np.concatenate([a.rows, b.rows])
    links, taken, waiting = np.zeros(len(rows), np.int64), [], 0
    for hosts, guests, own, other in ((a, b, 0, 0 if within else n), *(() if within else ((b, a, n, 0),))):
        for x, y in _guests(hosts, guests, pivots, reach, block):
            i, j, p = _near(hosts.vectors, x, guests.vectors, y, threshold)
            if not len(i):
                continue
            if within:
                ok = x[i] < y[j]
            else:
                ok = hosts.angle[x[i]] < guests.angle[y[j]] if own else hosts.angle[x[i]] <= guests.angle[y[j]]
            close = np.flatnonzero(np.abs(p - threshold) <= NEAR)
            if len(close):
                given = hosts.vectors.given[x[i[close]]].astype(np.float64), guests.vectors.given[y[j[close]]].astype(np.float64)
                ok[close] &= (given[0] * given[1]).sum(1) / np.sqrt((given[0] ** 2).sum(1) * (given[1] ** 2).sum(1)) >= threshold
            i, j = i[ok], j[ok]
            links[own + x] += np.bincount(i, guests.held[y[j]], len(x)).astype(np.int64)
            links[other + y] += np.bincount(j, hosts.held[x[i]], len(y)).astype(np.int64)
            places = np.concatenate([own + x, other + y])
            u, v = _joined(len(places), i, len(x) + j)
            taken.append((places[u], places[v]))
            waiting += len(u)
            if waiting > 4 * len(rows):
                label = _smallest_reachable(len(rows), *(np.concatenate(z) for z in zip(*taken, strict=True)))
                taken, waiting = [(np.arange(len(rows)), label)], len(rows)
    to = some = np.flatnonzero(links)
    if taken:
        order = np.lexsort((rows["h"], rows["id"]))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        to = order[_smallest_reachable(len(rows), *(rank[np.concatenate(z)] for z in zip(*taken, strict=True)))[rank[some]]]
    return pa.RecordBatch.from_arrays([pa.array(z) for z in (rows["id"][some], rows["h"][some], links[some], rows["id"][to], rows["h"][to])], ["least_id", "h", "links", "to_id", "to_h"])


def _links(tiles: DataFrame, axes: dict[int, np.ndarray], pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``least_id, h, links, to_id, to_h`` of each class of each pair of tiles that has links there.

    links counts the vectors behind the linked classes; to_id and to_h name
    the smallest class it reaches there, so a group of near copies gives a row
    for each of them, not one for each pair.
    """
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tile] = {}
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r] for c in ("d", "tile", "tile_", "rows", "given", "rows_", "given_")}
                d, low, high = (row[c].as_py() for c in ("d", "tile", "tile_"))
                for name, end in ((low, ""), (high, "_")):
                    if name not in known:
                        known[name] = Tile(row[f"rows{end}"].as_buffer(), row[f"given{end}"].as_buffer(), axes[d])
                yield _links_of(known[low], known[high], pivots[d], threshold, block)
                known = {low: known[low]}

    far = float(np.sqrt(max(0.0, 2 * (1 - threshold)))) + 1e-6
    tiles = tiles.coalesce(_parts(tiles.count()))
    others = tiles.select(*(F.col(c).alias(f"{c}_") for c in tiles.columns))
    met = (F.col("tile") <= F.col("tile_")) & (F.col("tile_") <= F.col("last")) & (F.col("low_") <= F.col("high") + far) & (F.col("low") <= F.col("high_") + far)
    return tiles.join(others, met).mapInArrow(run, LINKS)


def _parts(tiles: int) -> int:
    """Into how many partitions so many tiles go: every pair of partitions is a task, which reads both."""
    return max(1, min(tiles, max(TILES, 4 * isqrt(tiles), tiles // 8)))


# Parquet's writer looks at its buffers after each row, as a row can hold a whole tile of numbers without pattern.
WIDE = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(TILE_BYTES), "parquet.enable.dictionary": "false", "compression": "none"}


def near_vectors(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``table(vec_id, embedding)``.

    Vectors that are null, zero, or hold null, infinite or undefined
    components, and rows without vec_id, link with nothing; neither do vectors
    of different lengths. Equal vectors link with each other, also under one
    vec_id, and are compared with others once. n_links counts rows. Other
    columns are not read. An empty table gives no rows.
    """
    small_batches(table.sparkSession)
    rows = vectors(table)
    axes, sizes = principal_axes(rows)
    pivots = pivots_of(rows, sizes)
    tiles = stored(_tiles(rows, axes, pivots, sizes), "tiles", **WIDE)
    links = stored(_links(tiles, axes, pivots, threshold), "links")
    classes = rows.groupBy("h", "k").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("held"))
    node = F.struct(F.col("least_id").alias("id"), "h")
    roots = connected_components(links.select(node.alias("u"), F.struct(F.col("to_id").alias("id"), F.col("to_h").alias("h")).alias("v")))
    found = classes.select(node.alias("own"), "k", "held")
    found = found.join(links.groupBy(node.alias("linked")).agg(F.sum("links").alias("links")), F.col("own") == F.col("linked"), "left")
    found = found.join(roots, F.col("own") == F.col("node"), "left")
    named = found.select(
        F.col("own.h").alias("rh"),
        F.col("k").alias("rk"),
        (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"),
        F.coalesce(F.col("root.id"), F.col("own.id")).alias("component_id"),
    )
    ids = rows.select(F.col("vec_id").alias("id"), "h", "k").join(named, (F.col("h") == F.col("rh")) & (F.col("k") == F.col("rk"))).select("id", "n_links", "component_id")
    linked = ids.select(F.col("id").alias("vec_id"), "n_links", "component_id")
    part = linkable(_components(table)) & F.col("vec_id").isNotNull()
    alone = table.where(~F.coalesce(part, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
