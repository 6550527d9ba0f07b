"""Whitening against plain linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest

from siftstone.llm import queries, whitening

from ..conftest import DATA

NAN, INF = float("nan"), float("inf")


def brute(vectors):
    whole = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(whole), [sum(c) for c in zip(*whole, strict=True)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in whole]
    away = np.array([[(n * x - s) / n for x, s in zip(row, sums, strict=True)] for row in whole])
    values, turn = np.linalg.eigh(away.T @ away / n)
    return deviation, away, values[::-1], turn[:, ::-1]


def table(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_query(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.collect()
    got = queries.op12_embedding_whitening(spark, DATA)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = table(got.collect())
    deviation, away, values, turn = brute([r["embedding"] for r in rows])
    assert len(got) == len(rows) and all(sorted(g) == list(range(1, 9)) for g in got.values())
    z = np.array([[got[r["vec_id"]][k + 1]["whitened"] for k in range(8)] for r in rows])
    want = away @ turn[:, :8] / np.sqrt(values[:8])
    assert np.abs(z - want * np.sign((z * want).sum(0))).max() < 1e-10
    assert np.abs(np.cov(z.T, bias=True) - np.eye(8)).max() < 1e-12
    for r, d in zip(rows, deviation, strict=True):
        for k, g in got[r["vec_id"]].items():
            assert (g["n"], g["deviation"]) == (len(rows), d)
            assert abs(g["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-9 and g["identity_error"] < 1e-12


def rotated(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(q)) - 0.5 * (q.T @ q))
    a = (q * np.asarray(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 2, 40), np.r_[5 + np.arange(8) * 1e-9, np.linspace(1, 2, 20)], np.r_[5 + np.arange(6) * 1e-12, 3 + np.arange(6) * 1e-10], np.r_[np.ones(9), 2, np.zeros(5)], 10.0 ** -np.arange(30), [7.0], [0.0, 0.0]],
    ids=["apart", "cluster", "two clusters", "equal", "graded", "one", "zero"],
)
def test_eigenvectors_are_right_to_double_precision(values):
    a, _ = rotated(values)
    got, x = whitening.eigen(a)
    wide = x.astype(np.longdouble)
    assert np.abs(a @ wide - wide * got).max() <= 1e-15 * max(np.max(values), 1e-300)
    assert np.abs(wide.T @ wide - np.eye(len(x))).max() < 1e-15
    assert np.abs(got - np.sort(np.array(values))[::-1]).max() <= 1e-14 * max(np.max(values), 1e-300)


def test_single_precision_alone_is_not_enough():
    """What the refinement is for: a cluster that single precision mixes."""
    a, q = rotated(np.r_[5 + np.arange(8) * 1e-9, np.linspace(1, 2, 20)])
    _, x = np.linalg.eigh(a.astype(np.float32))
    assert np.abs(np.abs(x[:, -1].astype(np.longdouble) @ q[:, 7]) - 1) > 1e-3
    _, x = whitening.eigen(a)
    assert abs(abs(float(x[:, 0].astype(np.longdouble) @ q[:, 7])) - 1) < 1e-12


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (None, [3.0, 1.0, 1.0]), (1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [NAN, 0.0, 1.0]), (10, [INF, 0.0, 1.0]), (11, [0.0, -INF, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in good + bad], "vec_id long, embedding array<float>, n int, component string")
    rows = whitening.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), k) for i, _ in good for k in (1, 2, 3))
    deviation, *_ = brute([v for _, v in good])
    assert {str(r["vec_id"]): r["deviation"] for r in rows} == {str(i): d for (i, _), d in zip(good, deviation, strict=True)}
    assert {r["whitened"] for r in rows if r["component"] == 3} == {0.0} and max(r["identity_error"] for r in rows) < 1e-12  # three different rows span a plane


def test_nothing_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25]) for k in range(3)], schema)).collect()
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in same} == {(0.0, 0.0, 0, 0.0)} and len(same) == 6
    with pytest.raises(ValueError, match="length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (2000, 1 << 24, 1 << 40):
        y = rng.integers(-top, top, (300, 4))
        assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()
