"""Near vectors and top-k against all pairs."""

import math
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pytest

from spendgrain.llm import near_vectors, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 24))
    x = [c + rng.normal(0, s, 24) for c in centres for s in (0.05, 0.1, 0.2, 0.3) for _ in range(12)]
    x += [rng.normal(size=24) for _ in range(150)] + [centres[0]] * 5 + [centres[0] * 3, centres[1] * 1e-200, -centres[0]]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [nan] * 24, 1), (903, [1.0, None] * 12, 1), (904, [inf] * 24, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    rows += [(20, rows[20][1], 1), (21, rows[100][1], 1)]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_and_components(spark, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    rows = corpus()
    ok = [k for k, (i, v, _) in enumerate(rows) if i is not None and good(v) and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    units = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    units = {k: v / np.sqrt((v * v).sum()) for k, v in units.items()}
    for a, x in enumerate(ok):
        for y in ok[a + 1 :]:
            if len(units[x]) == len(units[y]) and units[x] @ units[y] >= 0.95:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 10**9), 10**9 if i is None else i)
    wanted = sorted((str(i), links[k], str(None if i is None else least[find(k)])) for k, (i, _, _) in enumerate(rows))
    found = near_vectors.near_vectors(table(spark, rows).repartition(3)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert near_vectors.near_vectors(table(spark, [])).count() == 0


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 8)
    test_links_and_components(spark, monkeypatch, 40)


def folder_bytes(*folders):
    return sum(p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.is_file())


def test_pairs_of_tiles_copy_no_vectors(spark, monkeypatch, tmp_path):
    """What is shuffled and stored stays near the size of the input, however many tiles it has."""
    monkeypatch.setattr(near_vectors, "TILE", 32)
    monkeypatch.setattr("spendgrain.llm.common.shared_folder", lambda _, name: f"{tmp_path}/{name}-{uuid4().hex}")
    x = np.random.default_rng(3).normal(size=(2000, 64))
    rows = table(spark, [(i, [float(c) for c in v], 1) for i, v in enumerate(x)])
    own = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before = folder_bytes(*own)
    assert near_vectors.near_vectors(rows).where("n_links = 0").count() == 2000
    assert folder_bytes(*own) - before + folder_bytes(tmp_path) < 4 * x.nbytes


def test_guests_meet_all_they_are_near_to(monkeypatch):
    monkeypatch.setattr(near_vectors, "BAND", 8)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 32))
    x[300:] = x[rng.integers(0, 90, 400)] + rng.normal(0, 0.25, (400, 32))
    x[650:] = -x[:50]
    x = x.astype(np.float32)
    units = near_vectors.unit_rows(x)
    wanted = np.triu(units @ units.T >= 0.9, 1)
    wanted = wanted | wanted.T
    held = rng.integers(1, 4, 700)
    axes = np.linalg.eigh(units.T @ units)[1][:, ::-1]
    for pivots in (units[rng.choice(700, 40, False)], np.eye(1, 32)):
        cell, angle = near_vectors.nearest(units, pivots)
        tiles = []
        for at in np.array_split(rng.permutation(700), 3):
            at = at[np.argsort(angle[at], kind="stable")]
            rows = np.empty(len(at), near_vectors.ROW)
            for field, values in (("id", at), ("h", -at), ("held", held[at]), ("angle", angle[at]), ("cell", cell[at])):
                rows[field] = values
            tiles.append(near_vectors.Tile(pa.py_buffer(rows.tobytes()), pa.py_buffer(x[at].tobytes()), axes))
        links, label = np.zeros(700, int), np.arange(700)
        i, j = [], []
        for a, low in enumerate(tiles):
            for high in tiles[a:]:
                found = near_vectors._links_of(low, high, pivots, 0.9, 8)
                np.add.at(links, found.column("least_id").to_numpy(), found.column("links").to_numpy())
                i.append(found.column("least_id").to_numpy())
                j.append(found.column("to_id").to_numpy())
        assert (links == wanted @ held).all()
        label = near_vectors._smallest_reachable(700, np.concatenate(i), np.concatenate(j))
        assert (label == near_vectors._smallest_reachable(700, *np.nonzero(wanted))).all()


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)) * np.linspace(3, 0.2, 64)
    x[100:] = x[rng.integers(0, 100, 200)] + rng.normal(0, 0.3, (200, 64))
    u = near_vectors.unit_rows(x)
    i, j, p = near_vectors.near_in_block(u[:150], u[150:], 0.9)
    wanted = u[:150] @ u[150:].T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(w.tolist() for w in np.nonzero(wanted >= 0.9 - near_vectors.NEAR)), strict=True))
    assert np.abs(p - wanted[i, j]).max() < 1e-12


@pytest.mark.parametrize("sizes", [(64, 8, 4), (8192, 2048, 128)])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD", "QUERIES", "LEAF"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, v if v is None else [None if c is None else round(c, 1) for c in v], n) for i, v, n in corpus(2)]
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v, _ in rows if i is not None and good(v)]
    asked = {(i, tuple(v)) for i, v in ok if i % 20 == 0}
    wanted = []
    for i, q in asked:
        own = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        wanted += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own[:7])]
    found = topk.top_k(table(spark, rows).repartition(3), k=7).collect()
    assert sorted(tuple(r) for r in found) == sorted(wanted)
    assert topk.top_k(table(spark, [])).count() == 0
