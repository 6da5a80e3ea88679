"""Exact top-k search by inner product: a ball tree per shard, branch and bound over blocks of queries.

Candidates are dealt into shards of bounded size. A task builds a ball tree of
its shard and searches it for a block of queries together. At a node only the
queries go on whose bound, the product with the centre plus norm times radius,
reaches their kth score; each goes to the child with the larger bound first.
Every query searches one shard at first. The kth score found there is sent with
it to all others, which therefore return only what can still count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import stored
from spendgrain.llm.near_vectors import matrix, usable

SHARD, QUERIES, LEAF = 8192, 2048, 128
NONE = np.iinfo(np.int64).min + 1


@dataclass
class Node:
    low: int
    high: int
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, Node]:
    """An order of the rows, and nodes over ranges of it."""
    order = np.arange(len(x))

    def build(low: int, high: int) -> Node:
        own = x[order[low:high]]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        node = Node(low, high, centre, float(np.sqrt(away.max())) * (1 + 1e-9) + 1e-9)
        if high - low > LEAF and node.radius > 1e-6:
            first = own[away.argmax()]
            second = own[((own - first) ** 2).sum(1).argmax()]
            half = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(own @ (second - first), half)]
            node.children = [build(low, low + half), build(low + half, high)]
        return node

    return order, build(0, len(x))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where all sums are small enough to be exact there."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Search:
    """The k best of a shard for each query: scores and ids so far, and the kth score."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray):
        self.order, self.root = ball_tree(x.astype(np.float64))
        self.x, self.ids = x[self.order], ids[self.order]
        self.q, self.q_ids, self.k, self.floor = q, q_ids, k, floor
        self.scale = q.astype(np.float64)
        self.norms = np.sqrt((self.scale**2).sum(1))
        self.scores = np.full((len(q), k), NONE)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.visit(self.root, np.arange(len(q)))

    def bound(self, node: Node, who: np.ndarray) -> np.ndarray:
        value = self.scale[who] @ node.centre + self.norms[who] * node.radius
        return value + 1e-9 * np.abs(value) + 1e-6

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.children:
            self.take(node, who)
            return
        a, b = node.children
        for_a, for_b = self.bound(a, who), self.bound(b, who)
        ahead = for_a >= for_b
        for first, second, own, top_first, top_second in ((a, b, ahead, for_a, for_b), (b, a, ~ahead, for_b, for_a)):
            chosen = who[own]
            self.visit(first, chosen[top_first[own] >= self.kth(chosen)])
            self.visit(second, chosen[top_second[own] >= self.kth(chosen)])

    def kth(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[who, -1], self.floor[who])

    def take(self, node: Node, who: np.ndarray) -> None:
        ids = self.ids[node.low : node.high]
        scores = _products(self.q[who], self.x[node.low : node.high])
        scores[self.q_ids[who][:, None] == ids[None, :]] = NONE
        some = np.flatnonzero((scores >= self.kth(who)[:, None]).any(1))
        if not len(some):
            return
        who, scores = who[some], scores[some]
        every = np.concatenate([self.scores[who], scores], 1)
        names = np.concatenate([self.found[who], np.broadcast_to(ids, scores.shape)], 1)
        best = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[who] = np.take_along_axis(every, best, 1)
        self.found[who] = np.take_along_axis(names, best, 1)


RESULT = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    """``query_id, query_key, vec_id, score``: the best k of each group of ``is_query, id, key, v, floor`` for its queries."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("is_query").to_numpy()
        q, x = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        if not len(q) or not len(x):
            return RESULT.empty_table()
        ids, names = q.column("id").to_numpy(), q.column("key").to_numpy()
        search = Search(matrix(x.column("v")), x.column("id").to_numpy(), matrix(q.column("v")), ids, k, q.column("floor").to_numpy())
        row, at = np.nonzero((search.scores > NONE) & (search.scores >= search.floor[:, None]))
        return pa.Table.from_arrays([pa.array(y) for y in (ids[row], names[row], search.found[row, at], search.scores[row, at])], schema=RESULT)

    return rows.groupBy(*groups).applyInArrow(run, "query_id long, query_key long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest products of every query with the other rows of ``table(vec_id, embedding)``.

    Components become floor(scale * x). Queries are the rows whose vec_id is
    divisible by ``every``; rows with a query's own vec_id are not among its
    answers. Ties go to the smaller vec_id. Vectors that are null or hold null,
    infinite or undefined components, and rows without vec_id, take no part;
    vectors answer only queries of their length. Rows with one vec_id are each
    a candidate; as queries, equal ones count once and others are ranked for
    themselves. Products beyond 64 bits wrap around. Other columns are not
    read. An empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    rows = table.where(F.col("vec_id").isNotNull() & usable(v) & (F.size(v) > 0))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("id"), whole.alias("v")).withColumns({"key": F.xxhash64("v"), "d": F.size("v")}), "vectors")
    queries = stored(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "key"]), "queries")
    n, asked = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "key"), F.lit(shards)).cast("int"))
    queries = queries.withColumns({"shard": F.pmod(F.xxhash64("id", "key"), F.lit(shards)).cast("int"), "block": F.pmod(F.xxhash64("key", "id"), F.lit(blocks)).cast("int")})

    def ask(q: DataFrame) -> DataFrame:
        return q.withColumn("is_query", F.lit(True))

    def offer(x: DataFrame) -> DataFrame:
        return x.withColumns({"is_query": F.lit(False), "floor": F.lit(NONE)})

    columns = ["is_query", "id", "key", "v", "floor", "d", "shard"]
    home = ask(queries.withColumn("floor", F.lit(NONE))).select(columns).unionByName(offer(rows).select(columns))
    first = stored(_searched(home, ["d", "shard"], k), "first")
    floors = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("fq"), F.col("query_key").alias("fk"), F.col("score").alias("known"))
    bounded = queries.join(floors, (F.col("id") == F.col("fq")) & (F.col("key") == F.col("fk")), "left").withColumn("floor", F.coalesce("known", F.lit(NONE)))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))
    sent = ask(bounded.withColumn("shard", F.explode(others))).select(*columns, "block")
    held = offer(rows).select(*columns, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rest = _searched(sent.unionByName(held), ["d", "shard", "block"], k)
    return _ranked(first.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
