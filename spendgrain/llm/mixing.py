"""Mixing sources to target weights, with DataFrame functions only.

Every source is a stream: its documents in an order given by a hash, again from
the start when it ends. A source gives as many words as its target says, read
off the front of its stream, so all documents are taken equally often or once
more, and at most one in part. The stream is cut into blocks of equal length.
A splitting tree hands the exact number of blocks of each source down to the
output shards: at every node the blocks of the left half are a multivariate
hypergeometric draw, one source after the other, by the inverse of the
distribution. A shard then takes its share of each source's permuted blocks,
disjoint from every other shard's, and is ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
# Primes below 2^31, factors of the permutations.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` out of ``population`` are among its ``marked`` ones: the inverse of the distribution at u in [0, 1).

    Probabilities follow from their neighbours' ratio. Those further than ten
    standard deviations and ten from the most likely number are beyond the
    resolution of u.
    """

    def within(v: Column) -> Column:
        n, k, d = (v[c].cast("double") for c in ("n", "k", "d"))
        mode = F.floor((d + 1) * (k + 1) / (n + 2))
        spread = F.sqrt(d * (k / F.greatest(n, F.lit(1.0))) * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
        reach = F.ceil(10 * spread + 10)
        low, high = F.greatest(F.lit(0), v["d"] - (v["n"] - v["k"])), F.least(v["d"], v["k"])
        return F.struct(v["n"], v["k"], v["d"], F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"))

    def ratio(v: Column, x: Column) -> Column:
        n, k, d, at = (c.cast("double") for c in (v["n"], v["k"], v["d"], x))
        return (k - at) * (d - at) / ((at + 1) * (n - k - d + at + 1))

    def total(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        grown = F.aggregate(F.sequence(v["low"], v["high"]), start, lambda s, x: F.struct((s["w"] * ratio(v, x)).alias("w"), (s["sum"] + s["w"]).alias("sum")))
        return grown["sum"]

    def number(v: Column) -> Column:
        def step(t: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("x"))
            counted = F.aggregate(
                F.sequence(v["low"], v["high"]),
                start,
                lambda s, x: F.struct((s["w"] * ratio(v, x)).alias("w"), (s["sum"] + s["w"]).alias("sum"), (s["x"] + F.when(s["sum"] + s["w"] <= t, 1).otherwise(0)).alias("x")),
            )
            return F.least(v["low"] + counted["x"], v["high"]).cast("long")

        return _let(u * total(v), step)

    given = F.struct(population.cast("long").alias("n"), marked.cast("long").alias("k"), drawn.cast("long").alias("d"))
    return _let(_let(given, within), number)


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(2.0**53)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``s, shard, quota`` of ``quotas(s, blocks)``: for each source and shard an exact number of blocks.

    Shards get equal numbers of blocks but for one. One row holds a number per
    source and node, never anything per block.
    """
    rows = quotas.agg(F.sort_array(F.collect_list(F.struct("s", F.col("blocks").cast("long").alias("q")))).alias("own"))
    rows = rows.select(F.transform("own", lambda x: x["s"]).alias("sources"), F.transform("own", lambda x: x["q"]).alias("quotas"))
    rows = rows.withColumn("all", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(shards)})
    floors = 0
    while 2**floors < shards:
        floors += 1
    for _ in range(floors):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        room = F.floor(middle.cast("long") * F.col("all") / shards) - F.floor(F.col("low").cast("long") * F.col("all") / shards)
        own = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.expr("cast(array() as array<bigint>)").alias("left"), own.alias("n"), room.cast("long").alias("d"))

        def draw(s: Column, q: Column) -> Column:
            u = _unit(F.lit(seed), F.col("low"), F.col("high"), F.size(s["left"]))
            return _let(
                hypergeometric(u, s["n"], q, s["d"]),
                lambda x: F.struct(F.concat(s["left"], F.array(x)).alias("left"), (s["n"] - q).alias("n"), (s["d"] - x).alias("d")),
            )

        rows = rows.withColumns({"middle": middle, "left": F.aggregate("quotas", start, draw)["left"]})
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        halves = F.array(
            F.struct("low", F.col("middle").alias("high"), F.col("left").alias("quotas")),
            F.struct(F.col("middle").alias("low"), "high", right.alias("quotas")),
        )
        single = F.array(F.struct("low", "high", "quotas"))
        rows = rows.select("sources", "all", F.explode(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(single)).alias("x")).select("sources", "all", "x.*")
    pairs = F.posexplode(F.arrays_zip(F.col("sources").alias("s"), F.col("quotas").alias("q")))
    return rows.select(F.col("low").alias("shard"), pairs.alias("at", "x")).select("x.s", "shard", F.col("x.q").alias("quota"))


def sizes(docs: DataFrame, seed: int = 0, *more: Column) -> DataFrame:
    """``doc_id, source, size, place, mark`` of each document, and more columns; place orders a source's stream, mark is a hash of the text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), place.alias("place"), F.xxhash64(F.col("text").cast("string")).alias("mark"), *more)


def targets(measured: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``s, source, source_size, target`` of each source.

    Weights repeat over the sources by code point, null last. A target is the
    smaller of ``most`` times the source's size and its weight's part of a
    level at which all targets add up to ``share`` of all sizes. That level is
    the largest that any number of filled sources, the smallest for their
    weight first, leaves to the rest.
    """
    sums = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") - 1) % len(weights) + 1)
    rows = sums.withColumns({"weight": weight, "room": most * F.col("source_size")})
    order = Window.orderBy(F.col("room") / F.col("weight"), "s")
    filled = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (share * everything - filled) / rest)
    level = F.max("level").over(Window.partitionBy())
    return rows.select("s", "source", "source_size", F.least("room", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, shards: int = 16, block_words: int = 4096, seed: int = 0, most: float = 2.0, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, draws`` of each row of ``docs(doc_id, text, source)``.

    size: the number of words; taken: words the mix takes, repeats counted;
    draws: each time the document is taken, with the shard, the number of the
    block in its source, the key that orders the shard, and the words taken.
    A draw is made only where a shard's quota holds its block, and taken adds up
    the draws; the query fails where that is not the part of the stream that
    the target asks for.

    Null sources are one source. Null texts and texts without words have size
    0 and are never taken. Documents with the same doc_id are taken in order of
    size and of a hash of the text, each by its own source; equal rows may stand for each other. Other columns are not read. An
    empty table gives no rows. Reruns agree.
    """
    return _dealt(docs, False, shards, block_words, seed, most, **options).select("doc_id", "source", "size", "source_size", "target", "taken", "draws")


def _dealt(docs: DataFrame, whole_rows: bool, shards: int = 16, block_words: int = 4096, seed: int = 0, most: float = 2.0, **options) -> DataFrame:
    """The columns of ``mix``; with whole_rows also ``row``, all columns of the document's own row."""
    measured = stored(sizes(docs, seed), "sizes")
    n = measured.count()
    buckets = max(1, round(4 * n**0.5))
    sources = stored(targets(measured, most=most, **options), "targets")
    amount = F.least(F.round("target").cast("long"), F.floor(most * F.col("source_size")).cast("long"))
    whole = F.floor(F.col("amount") / F.greatest("source_size", F.lit(1)))
    plan = sources.withColumn("amount", amount).withColumns({"whole": whole.cast("long"), "blocks": F.ceil(F.col("amount") / block_words).cast("long")})
    plan = plan.withColumn("part", F.col("amount") - F.col("whole") * F.col("source_size"))
    quotas = split_quotas(plan.select("s", "blocks"), shards, seed)
    filled = quotas.withColumn("upto", F.sum("quota").over(Window.partitionBy("s").orderBy("shard")))
    filled = filled.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("filled"))
    best = F.transform(F.array(*[F.lit(p) for p in PRIMES]), lambda p: F.struct(F.least(p % F.col("safe"), F.col("safe") - p % F.col("safe")).alias("apart"), p.cast("long").alias("p")))
    plan = plan.withColumn("safe", F.greatest("blocks", F.lit(1))).withColumn("factor", F.array_max(best)["p"])
    plan = plan.join(filled, "s").select("s", F.col("source").alias("own"), "source_size", "target", "whole", "part", "safe", "factor", F.transform("filled", lambda x: x["upto"]).alias("upto"))
    plan = stored(plan, "plan")

    bucket = F.shiftright(F.shiftright("place", 28) * F.lit(buckets).cast("long"), 32)
    own = sizes(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole_rows else measured
    rows = own.withColumn("bucket", bucket).join(plan, F.col("source").eqNullSafe(F.col("own")))
    before = measured.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = before.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.join(plan.select("own", F.col("s").alias("of")), F.col("source").eqNullSafe(F.col("own"))).select("of", F.col("bucket").alias("slot"), "before")
    inside = Window.partitionBy("s", "bucket").orderBy("place", "size", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(before, (F.col("s") == F.col("of")) & (F.col("bucket") == F.col("slot")))
    start = F.col("before") + F.col("inside")
    rows = rows.withColumn("start", start).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("start"))))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(0)

    def drawn(copy: Column) -> Column:
        block = F.floor((copy * F.col("source_size") + F.col("start")) / block_words)
        place = (block * F.col("factor") + F.col("s") * 7919) % F.col("safe")
        shard = F.size(F.filter("upto", lambda x: x <= place))
        words = F.when(copy < F.col("whole"), F.col("size")).otherwise(F.col("extra"))
        key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("place"), F.col("mark"), copy)
        return F.struct(copy.cast("int").alias("copy"), shard.cast("int").alias("shard"), block.cast("long").alias("block"), key.alias("shuffle_key"), words.cast("long").alias("words"))

    every = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), copies.cast("long")), lambda k: k < copies), drawn)
    rows = rows.withColumn("draws", F.filter(every, lambda d: d["shard"] < shards))
    rows = rows.withColumn("dealt", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    wanted = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return rows.withColumn("taken", F.when(F.col("dealt") == wanted, F.col("dealt")).otherwise(F.raise_error(F.lit("the shards' quotas do not hold the words of the targets")).cast("long")))


def shard_order(mixed: DataFrame) -> DataFrame:
    """``shard, shuffle_key, doc_id, copy, words``: one row per draw, each shard together in its shuffled order."""
    rows = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.shuffle_key", "doc_id", "d.copy", "d.words")
    return rows.repartition("shard").sortWithinPartitions("shard", "shuffle_key")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix draws them, with all their columns, shard by shard in its shuffled order.

    A document drawn in part is taken whole if the part is half of it or more.
    Each row is drawn by its own source and text, whatever ids it shares.
    Partitions are ranges of shard and shuffle key, so a shard may fill several.
    """
    rows = _dealt(docs, True, **options)
    rows = rows.select("row", F.explode(F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))).alias("d"))
    order = ("d.shard", "d.shuffle_key")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
