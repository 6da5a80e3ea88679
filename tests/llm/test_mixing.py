"""Targets against resharing step by step, exact quotas, and what is taken against a plain loop."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendgrain.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        now = {s: left * weight[s] / w for s in open_}
        above = [s for s in open_ if now[s] > 2 * sizes[s]]
        if not above:
            return fixed | now
        fixed |= {s: 2.0 * sizes[s] for s in above}


def corpus():
    rows = []
    for i in range(400):
        source = ["a", "B", "é", None, "hot", "hot", "hot", "zz"][i % 8]
        rows.append((i, " ".join(["w"] * (1 + i * 7 % 90)), source, i))
    rows += [(1000, "x " * 20000, "long", 0), (1001, None, "a", 1), (1002, "", "empty", 2), (3, "again", "B", 3), (3, "again", "B", 3), (None, "one two", None, 4)]
    return rows


def brute_taken(rows, targets):
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(list)
    for i, t, s, _ in rows:
        by[s].append((hashlib.md5(f"0|{'' if i is None else i}".encode()).hexdigest()[:15], size(t), i))
    out = []
    for s, docs in by.items():
        total = sum(d[1] for d in docs)
        amount = min(math.floor(targets[s] + 0.5), 2 * total)
        whole = amount // max(1, total)
        left = amount - whole * total
        for _, n, i in sorted(docs, key=lambda d: (d[0], d[1], -1 if d[2] is None else d[2])):
            part = max(0, min(n, left))
            left -= part
            out.append((str(i), n, whole * n + part))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_taken_and_draws(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.mix(docs, shards=shards, block_words=64).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    wanted = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6
        assert r.taken <= 2 * r.size and sum(d.words for d in r.draws) == r.taken
        assert len({d.copy for d in r.draws}) == len(r.draws) and all(0 <= d.shard < shards for d in r.draws)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in found) == brute_taken(rows, wanted)
    for s in sizes:
        assert abs(sum(r.taken for r in found if r.source == s) - wanted[s]) <= 1
    again = mixing.mix(docs.repartition(7), shards=shards, block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_quotas_are_exact_and_spread(spark):
    blocks = [(1, 1000), (2, 0), (3, 37), (4, 1)]
    found = mixing.split_quotas(spark.createDataFrame(blocks, "s int, blocks long"), 7).collect()
    assert len(found) == 4 * 7
    for s, n in blocks:
        assert sum(r.quota for r in found if r.s == s) == n and all(r.quota >= 0 for r in found)
    totals = [sum(r.quota for r in found if r.shard == k) for k in range(7)]
    assert sum(totals) == 1038 and max(totals) - min(totals) <= 1


def test_hypergeometric_inverse(spark):
    n, k, d = 30, 11, 13
    p = [math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) for x in range(min(k, d) + 1)]
    us = [i / 200 for i in range(200)]
    frame = spark.createDataFrame([(u,) for u in us], "u double")
    got = frame.select("u", mixing.hypergeometric(F.col("u"), F.lit(n), F.lit(k), F.lit(d)).alias("x")).collect()
    for r in got:
        wanted = next(x for x in range(len(p)) if sum(p[: x + 1]) > r.u - 1e-12)
        assert r.x == wanted
    big = frame.select(mixing.hypergeometric(F.col("u"), F.lit(2_000_000), F.lit(700_000), F.lit(1_000_000)).alias("x")).collect()
    assert abs(sum(r.x for r in big) / len(big) - 350_000) < 50


def test_empty_table_and_repeats(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, times int")
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(docs).collect() if r.size}
    for i, x in taken.items():
        if i not in (3, None):
            assert abs(counts.get(i, 0) - x) <= 0.5
    ordered = mixing.shard_order(mixing.mix(docs, shards=3, block_words=64))
    assert ordered.count() == sum(len(r.draws) for r in mixing.mix(docs, shards=3, block_words=64).collect())


def test_quotas_decide_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, times int")
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: split(*a).withColumn("quota", F.when(F.col("shard") == 0, 0).otherwise(F.col("quota"))))
    with pytest.raises(Exception, match="quotas"):
        mixing.mix(docs, shards=3, block_words=64).select("doc_id", "taken").collect()


def test_repeated_rows_come_in_the_shuffled_order_of_their_shards(spark):
    rows = [r for r in corpus() if r[0] not in (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    draws = mixing.mix(docs, shards=3, block_words=64).select("doc_id", "size", F.explode("draws").alias("d")).collect()
    wanted = [r.doc_id for r in sorted(draws, key=lambda r: (r.d.shard, r.d.shuffle_key)) if 2 * r.d.words >= r.size]
    assert [r.doc_id for r in mixing.repeated(docs, shards=3, block_words=64).collect()] == wanted


def test_rows_that_share_an_id_are_drawn_by_their_own_source(spark):
    rows = [(i, f"{s} {k} " + "w " * 8, s) for i in (None, 7) for s, n in (("a", 60), ("b", 60), ("c", 60), ("none", 3)) for k in range(n)]
    rows = [(i, "" if s == "none" else t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.repeated(docs).groupBy("source").agg(F.count("*").alias("n")).collect()
    wanted = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("taken") / 10).alias("n")).collect()}
    found = {r.source: r.n for r in out}
    assert wanted["a"] > 2 * wanted["b"] and "none" not in found
    assert all(abs(found[s] - wanted[s]) <= 0.5 for s in ("a", "b", "c"))
    keys = [r.k for r in mixing.mix(docs).select(F.explode("draws").alias("d")).select(F.col("d.shuffle_key").alias("k")).collect()]
    assert len(set(keys)) == len(keys)


def test_draws_follow_most(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, times int")
    for most, share in ((5.0, 4.5), (0.5, 0.4)):
        found = mixing.mix(docs, shards=3, block_words=64, most=most, share=share).collect()
        assert max(len(r.draws) for r in found) == (5 if most > 1 else 1)
        for s in {r.source for r in found}:
            own = [r for r in found if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(sum(d.words for d in r.draws) == r.taken and {d.copy for d in r.draws} == set(range(len(r.draws))) for r in found)
