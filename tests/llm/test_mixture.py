"""Mixing: targets, draws, quotas and blocks."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftstone.llm import mixture, queries

from ..conftest import DATA


def targets(sizes, most=3):
    """By filling up: sources at their caps give what is left to the others."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, "d": 50, None: 3}, {"a": 0, "b": 7}, {"Z": 5, "a": 5, "é": 90, "b": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixture.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_draws_follow_the_law(spark):
    from math import comb

    n, k, m = 40, 15, 12
    draws = spark.range(20_000).select(mixture._drawn(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), (F.col("id") + 0.5) / 20_000).alias("x"))
    got = {r["x"]: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    for x in range(0, 13):
        assert got.get(x, 0) == pytest.approx(comb(k, x) * comb(n - k, m - x) / comb(n, m), abs=2e-4)


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 7), (2, 0), (3, 333)], "place int, quota long")
    got = mixture.split_quotas(quotas, 7).collect()
    by_shard, by_place = defaultdict(int), defaultdict(list)
    for r in got:
        by_shard[r["shard"]] += r["blocks"]
        by_place[r["place"]].append((r["shard"], r["before"], r["blocks"]))
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and sum(by_shard.values()) == 1340
    for place, quota in ((0, 1000), (1, 7), (2, 0), (3, 333)):
        at = 0
        for _, before, blocks in sorted(by_place[place]):
            assert before == at and blocks >= 0
            at += blocks
        assert at == quota
    assert sorted(map(tuple, mixture.split_quotas(quotas, 7).collect())) == sorted(map(tuple, got))


def test_very_many_sources(spark):
    import random

    random.seed(3)
    quotas = [(k, random.randint(0, 20) if k else 50_000) for k in range(12_000)]
    got = mixture.split_quotas(spark.createDataFrame(quotas, "place int, quota long"), 4).collect()
    by_shard, by_place = defaultdict(int), defaultdict(dict)
    for r in got:
        by_shard[r["shard"]] += r["blocks"]
        by_place[r["place"]][r["shard"]] = r["blocks"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(sum(by_place[k].values()) == q and min(by_place[k].values()) >= 0 for k, q in quotas)
    assert all(abs(n - 12_500) < 600 for n in by_place[0].values())  # six standard deviations
    ones = sum(by_place[k][0] for k, q in quotas if 0 < k < 128)
    assert abs(ones - sum(q for k, q in quotas if 0 < k < 128) / 4) < 160


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op9_mixture(spark, DATA).collect()
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert len(got) == len(size)
    taken, total, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        total[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["source_size"] is not None
    assert target == pytest.approx(targets(total))
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = queries.op9_mixture(spark, DATA)
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_blocks_and_rows(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), "abc"[k % 3] if k % 5 else None, 1, "x") for k in range(120)] + [(None, None, "a", 1, "x"), (None, "one two", "a", 1, "x"), (5, "w w w w w", None, 1, "x"), (5, "w w w w w", None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string")
    blocks = mixture.mix(df, shards=4).collect()
    used = [b for b in blocks if b["take"]]
    shards = defaultdict(list)
    for b in used:
        shards[b["shard"]].append(b["position"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    out = mixture.mixed_rows(df, shards=4)
    assert out.columns == df.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(b["take"] for b in used)
    none = df.limit(0)
    assert mixture.mix(none).count() == 0 and mixture.mixed_rows(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["take"] for r in mixture.mix(empty).collect()] == [0, 0]


def test_repeated_rows_keep_a_row_each(spark, monkeypatch):
    rows = [(1, "a b c", "x")] * 4 + [(2, "d e", "x"), (3, "f g h i", "y"), (4, None, "y"), (4, None, "y")]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = queries.op9_mixture(spark, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_rows_that_differ_in_source_only(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "d e f g", "x"), (3, "h i j k l m n o", "y"), (1, "a b c", "y"), (4, "p q", None), (4, "p q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, came = defaultdict(int), defaultdict(int)
    for b in mixture.mix(df, shards=2).collect():
        taken[b["doc_id"], b["source"]] += b["take"]
    for r in mixture.mixed_rows(df, shards=2).collect():
        came[r["doc_id"], r["source"]] += len(r["text"].split())
    assert came == {k: v for k, v in taken.items() if v}
