"""Embeddings and components against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from siftstone.llm import queries, sorted_projection
from siftstone.llm.components import least_reachable

from ..conftest import DATA


def brute(ids, x, cosine=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    low = np.array(ids)
    while True:
        new = np.array([min(low[k], low[linked[k]].min(initial=low[k])) for k in range(len(ids))])
        if (new == low).all():
            return linked.sum(1), low
        low = new


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5000 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in least_reachable(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    for a, b in edges:
        for n in (a, b):
            assert got.get(n, n) == root(n)
    assert least_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((500, 32))
    near = base[:150] + 0.4 * rng.standard_normal((150, 32)) * np.linalg.norm(base[:150], axis=1)[:, None] / np.sqrt(32)
    crowd = base[499] + 0.05 * rng.standard_normal((700, 32))
    x = np.vstack([base, near, crowd, base[:5], 2 * base[5:6]]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1, "p") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int, point string")
    links, low = brute(ids, x.astype(float))
    got = {r["vec_id"]: r for r in sorted_projection.near_vectors(df).collect()}
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert sum(got[i]["component_id"] == c for i, c in zip(ids, low, strict=True)) >= 0.98 * len(ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_dense_cells_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(sorted_projection, "BLOCK", 16)
    monkeypatch.setattr(sorted_projection, "CELL", 6)
    rng = np.random.default_rng(6)
    x = (np.ones(24) + 1e-4 * rng.standard_normal((300, 24))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted_projection.near_vectors(df, passes=2).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


def test_crowds_over_many_cells_are_found(spark, monkeypatch):
    monkeypatch.setattr(sorted_projection, "BLOCK", 32)
    rng = np.random.default_rng(8)
    center = rng.standard_normal(64)
    crowd = center + 0.314 * rng.standard_normal((500, 64)) * np.linalg.norm(center) / 8
    x = np.vstack([rng.standard_normal((1250, 64)), crowd]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    links, _ = brute(list(range(len(x))), x.astype(float))
    found = {r["vec_id"]: r["n_links"] for r in sorted_projection.near_vectors(df).collect()}
    share = sum(found.values()) / links.sum()
    print("share of links", share)
    assert links.sum() > 100_000 and share >= 0.985


@pytest.mark.parametrize("ranked", [16, 1 << 16])
def test_pairs_of_a_crowd_are_told_once(spark, monkeypatch, ranked):
    monkeypatch.setattr(sorted_projection, "BLOCK", 32)
    monkeypatch.setattr(sorted_projection, "RANKED", ranked)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.standard_normal((300, 24)), np.ones(24) + 0.02 * rng.standard_normal((400, 24))])
    links, _ = brute(list(range(len(x))), x)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "point long, v array<double>")
    depth = sorted_projection.cell_depth(len(x))
    told = sorted_projection._pairs(points, 0.9, 12, sorted_projection.SEED, depth).toPandas()
    hashed = np.stack([sorted_projection.hashes(sorted_projection._unit(pd.Series(list(x))), p) for p in range(12)], 1) >> (sorted_projection.BITS - depth)
    meet = (hashed[told["a"]] == hashed[told["b"]]).any(1)
    assert 2 * len(told.drop_duplicates()) == links.sum()
    # a pair may be told as neighbours before it shares a cell, but only once as sharing one
    assert meet.mean() > 0.99 and len(told) < 1.2 * len(told.drop_duplicates())
    df = points.withColumnsRenamed({"point": "vec_id", "v": "embedding"})
    assert {r["vec_id"]: r["n_links"] for r in sorted_projection.near_vectors(df).collect()} == dict(enumerate(links.tolist()))


@pytest.mark.parametrize("points", [5_000, 50_000, 1_000_000, 30_000_000, 1_000_000_000])
def test_pairs_meet_at_any_size(points):
    """Pairs at the least cosine share a cell in some pass, measured with the operator's own hashes."""
    rng = np.random.default_rng(points)
    a, b = rng.standard_normal((2, 400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    depth, met = sorted_projection.cell_depth(points), np.zeros(400, bool)
    assert points / 2**depth <= sorted_projection.BLOCK  # a cell never holds more of evenly spread points
    for p in range(sorted_projection.passes_for(points, 0.9)):
        shift = sorted_projection.BITS - depth
        met |= sorted_projection.hashes(a, p) >> shift == sorted_projection.hashes(b, p) >> shift
    assert met.mean() >= 0.97


def test_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    links, low = brute(ids, np.array([r["embedding"] for r in rows], float))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op10_sorted_projection(spark, DATA).collect()}
    assert got == {i: (n, c) for i, n, c in zip(ids, links.tolist(), low.tolist(), strict=True)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1e300]), (10, [0.0, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in sorted_projection.near_vectors(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (2, 1, 2, True), (10, 1, 2, False), (9, 0, 9, True), (None, 0, None, True)] + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8)]
    assert got == sorted(want, key=repr)
    assert sorted_projection.near_vectors(df.limit(0)).count() == 0
