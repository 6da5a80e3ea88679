"""Prefix trie of conversations by a splitter skeleton.

A turn is known by a digest of its role and text, a conversation by its path:
its turns' digests end to end, so paths in byte order put every node's
conversations side by side. Paths are dealt into ranges. A node whose
conversations lie in more than one range is a prefix of a path at a border; the
trie of these border paths, cut where the range before no longer shares them,
is the skeleton, and every task gets it. A range sorts its paths, builds all
other nodes by itself, and sends what it holds of skeleton nodes. Those parts are
added up, and the skeleton is finished from its leaves to the root.

Only digests, word counts and ids are shuffled, never texts. The path of one
conversation is one value, 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import stored, text_bytes

WORD = r"[^\x20\x09-\x0D]+"
STEP = 16  # bytes of a path per turn
SHARD_TURNS = 1 << 20
CHUNK = 512  # ids of ends sent together
EMPTY = hashlib.sha256(b"").hexdigest()


def paths_of(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, path, words`` of every rebuilt conversation of ``turns(conv_id, turn, role, text)``.

    The first h turns are those of the conversation whose id is the next
    multiple of ``every`` towards zero, h the CRC-32 of the id modulo ``most``;
    the conversation's own turns follow, without their first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256), 1, 2 * STEP)
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words")).alias("step"))
    own = stored(own.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.slice("steps", 1, 0)), F.lit(1), h)
    steps = F.concat(head, F.slice("steps", h + 1, F.size("steps")))
    whole = own.join(heads, base == F.col("base"), "left").select("conv_id", steps.alias("steps"))
    return whole.select("conv_id", F.unhex(F.array_join("steps.digest", "")).alias("path"), F.col("steps.words").alias("words"))


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    n = min(len(a), len(b)) // STEP
    x, y = (np.frombuffer(p, np.uint8, n * STEP).reshape(n, STEP) for p in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


@dataclass
class Skeleton:
    """The trie of border paths: parents and depths of nodes, the root first, and the nodes along the border before each range."""

    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    borders: dict[int, list[int]] = field(default_factory=dict)

    @staticmethod
    def of(borders: list[tuple[int, bytes]]) -> Skeleton:
        """From ranges and border paths, both ascending."""
        out, path, chain = Skeleton(), b"", [0]
        for part, border in borders:
            chain = chain[: _shared(path, border) + 1]
            while len(chain) <= len(border) // STEP:
                out.parents.append(chain[-1])
                out.depths.append(len(chain))
                chain.append(len(out.parents) - 1)
            path = border
            out.borders[part] = chain
        return out


def _borders(ranged: DataFrame) -> list[tuple[int, bytes]]:
    """For each range but the first, how far its first path goes on with the last path of the range before."""
    edge = F.struct("path", "conv_id")
    ends = ranged.groupBy("part").agg(F.min(edge)["path"].alias("first"), F.max(edge)["path"].alias("last"))
    pairs = ends.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("before")).where("before IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [a[: STEP * _shared(a, b)] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary())], ["part", "border"])

    return sorted((r["part"], bytes(r["border"])) for r in pairs.mapInArrow(cut, "part int, border binary").collect())


NODES = (
    "part int, skeleton int, seq int, ends string, conv_id long, depth int, parent_conv_id long, parent_skeleton int, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
)
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
SCHEMA = pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in NODES.split(", "))])


def _alike(turns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many turns each path shares with the one before it; -1 for the first."""
    n = np.minimum(lengths[:-1], lengths[1:])
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n)
    differ = (turns[np.repeat(starts[:-1], n) + at] != turns[np.repeat(starts[1:], n) + at]).any(1)
    alike = n.copy()
    row = np.repeat(np.arange(len(n)), n)[differ]
    np.minimum.at(alike, row, at[differ])
    return np.concatenate([[-1], alike])


def local_nodes(part: int, table: pa.Table, low: list[int], high: list[int]) -> Iterator[pa.RecordBatch]:
    """All nodes of one range of ``conv_id, path, words``; low and high: skeleton nodes along its two borders, root first.

    Nodes are numbered as they begin in path order. Rows with ``skeleton`` are
    what the range holds of that node; those with ``ends`` list ids of
    conversations that end there, in ascending order by ``seq``.
    """
    table = table.take(pc.sort_indices(table, [("path", "ascending"), ("conv_id", "ascending")])).combine_chunks()
    ids = table.column("conv_id").to_numpy()
    data, offsets = text_bytes(table.column("path").combine_chunks())
    turns, edges = data.reshape(-1, STEP).view(np.uint64), offsets // STEP
    starts, lengths = edges[:-1], np.diff(edges)
    words = table.column("words").combine_chunks().flatten().to_numpy()
    alike = _alike(turns, starts, lengths)
    new = lengths - alike
    first = np.cumsum(new) - new
    total = int(new.sum())
    row = np.repeat(np.arange(len(ids)), new)
    depth = np.arange(total) - first[row] + alike[row] + 1

    parent = np.arange(-1, total - 1)
    top = np.empty(len(ids), np.int64)
    stack: list[int] = []
    for r, (keep, begin, more) in enumerate(zip((alike + 1).tolist(), first.tolist(), new.tolist(), strict=True)):
        del stack[keep:]
        if more and stack:
            parent[begin] = stack[-1]
        stack.extend(range(begin, begin + more))
        top[r] = stack[-1]
        if r == 0:
            lower = stack[: len(low)]
    skeleton = np.full(total, -1)
    skeleton[lower], skeleton[stack[: len(high)]] = low, high
    own_words = np.where(depth > 0, words[np.minimum(starts[row] + np.maximum(depth, 1) - 1, max(len(words) - 1, 0))] if len(words) else 0, 0).astype(np.int64)

    members = np.bincount(top, minlength=total)
    least = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(least, top, ids)
    children, leaves, saved = (np.zeros(total, np.int64) for _ in range(3))
    order = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), -1, -1):
        at = order[levels[d] : levels[d + 1]]
        done = at[skeleton[at] < 0]
        leaves[done] = np.where(children[done] == 0, 1, leaves[done])
        saved[done] += (members[done] - 1) * own_words[done]
        if d:
            np.add.at(members, parent[at], members[at])
            np.minimum.at(least, parent[at], least[at])
            for held, added in ((children, 1), (leaves, leaves[done]), (saved, saved[done])):
                np.add.at(held, parent[done], added)

    ends = np.full(total, EMPTY, object)
    change = np.flatnonzero(np.diff(top, prepend=-1, append=-1))
    lists: list[tuple[int, int, str]] = []
    for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
        if skeleton[top[a]] < 0:
            ends[top[a]] = hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
        else:
            lists += [(int(skeleton[top[a]]), i, ",".join(map(str, ids[i : min(i + CHUNK, b)].tolist()))) for i in range(a, b, CHUNK)]

    inside = skeleton >= 0
    above = skeleton[np.maximum(parent, 0)]
    columns = {
        "part": pa.array(np.full(total, part), pa.int32()),
        "skeleton": pa.array(skeleton, pa.int32(), mask=~inside),
        "conv_id": pa.array(least),
        "depth": pa.array(depth, pa.int32()),
        "parent_conv_id": pa.array(least[np.maximum(parent, 0)], mask=(parent < 0) | (above >= 0)),
        "parent_skeleton": pa.array(above, pa.int32(), mask=inside | (above < 0)),
        "n_convs": pa.array(members),
        "n_children": pa.array(children),
        "n_leaves": pa.array(leaves),
        "saved_tokens": pa.array(saved),
        "words": pa.array(own_words),
        "ends_sha256": pa.array(ends, pa.string(), mask=inside),
    }
    every = pa.table([columns.get(f.name, pa.nulls(total, f.type)) for f in SCHEMA], schema=SCHEMA)
    yield from every.to_batches()
    if lists:
        given = dict(zip(("skeleton", "seq", "ends"), zip(*lists, strict=True), strict=True)) | {"part": [part] * len(lists)}
        yield pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(lists), f.type) for f in SCHEMA], schema=SCHEMA)


def _digests(lists: DataFrame) -> DataFrame:
    """``skeleton, ends_sha256``: each node's lists are read in order and hashed as they come; none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([state.hexdigest()])], ["skeleton", "ends_sha256"])

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    if state:
                        yield row()
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    ordered = lists.repartition("skeleton").sortWithinPartitions("skeleton", "part", "seq")
    return ordered.select("skeleton", "ends").mapInArrow(run, "skeleton int, ends_sha256 string")


def _finished(sums: list, skeleton: Skeleton) -> list[tuple]:
    """Rows of all skeleton nodes, each after what it holds itself and below it is added up."""
    rows = {r["skeleton"]: r.asDict() for r in sums}
    for node in sorted(rows, reverse=True):  # a node's number is above its parent's
        own, up = rows[node], rows.get(skeleton.parents[node])
        own["n_leaves"] = own["n_leaves"] or int(own["n_children"] == 0)
        own["saved_tokens"] += (own["n_convs"] - 1) * own["words"]
        if up:
            up["n_children"] += 1
            up["n_leaves"] += own["n_leaves"]
            up["saved_tokens"] += own["saved_tokens"]
    out = []
    for node, own in rows.items():
        up = rows.get(skeleton.parents[node])
        out.append((node, own["conv_id"], skeleton.depths[node], up and up["conv_id"], *(own[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), own["ends_sha256"] or EMPTY))
    return out


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns of a conversation are ordered by ``turn``, null first, and where these
    are equal by the digest of role and text; repeated rows are turns of their own.
    Null roles and texts are empty. Rows without conv_id belong to no conversation
    and are left out. A conversation without rebuilt turns ends at the root. An
    empty table has no nodes. Other columns are not read.

    shards: how many ranges; by default the session's shuffle partitions, or
    more where a range would hold over SHARD_TURNS turns. Ranges are cut between
    conversations, so equal ones spread over several. Skeleton nodes, at most
    ranges times path length, are finished on the driver. The ends of one node
    are hashed in one pass in order, as the digest asks for.
    """
    spark, seen = turns.sparkSession, Observation()
    paths = paths_of(turns).observe(seen, F.sum(F.size("words")).alias("turns"), F.count(F.lit(1)).alias("n"))
    paths = stored(paths, "paths")
    if not seen.get["n"]:
        return spark.createDataFrame([], RESULT)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen.get["turns"] or 0) // SHARD_TURNS))
    ranged = stored(paths.repartitionByRange(shards, "path", "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    borders = _borders(ranged)
    skeleton = Skeleton.of(borders)
    parts = [None, *(part for part, _ in borders)]  # the first range has no border before it
    following = dict(zip(parts, parts[1:], strict=False))  # the last range has none behind it

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        low = skeleton.borders.get(part, [0])
        high = skeleton.borders.get(following.get(part if part in skeleton.borders else None), [0])
        return local_nodes(part, pa.Table.from_batches(list(batches)), low, high)

    nodes = stored(ranged.groupBy("part").applyInArrow(run, NODES), "nodes")
    inside = F.col("skeleton").isNotNull()
    sums = nodes.where(inside & F.col("ends").isNull()).groupBy("skeleton")
    sums = sums.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"))
    digests = _digests(nodes.where(F.col("ends").isNotNull()).select("skeleton", "part", "seq", "ends"))
    finished = spark.createDataFrame(_finished(sums.join(digests, "skeleton", "left").collect(), skeleton), f"skeleton int, {RESULT}")
    above = F.broadcast(finished.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    local = nodes.where(~inside).join(above, "parent_skeleton", "left")
    local = local.withColumns({"depth": F.col("depth").cast("long"), "parent_conv_id": F.coalesce("parent_conv_id", "above")})
    return local.select(*finished.columns[1:]).unionByName(finished.drop("skeleton"))
