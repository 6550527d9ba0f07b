"""Whitening of embeddings with eigenvectors that are right to double precision.

*Whole numbers.*  Entries become whole numbers, and their sums are exact: each task sums its
rows and, around the rounded mean, their products, in pieces that stay below 2^53; Spark adds
the pieces up as decimals.  The covariance is then a fraction of whole numbers, rounded once.

*Refinement.*  The driver holds one matrix of dimensions squared, whatever the number of
rows.  Its eigenvectors are taken in single precision and corrected by the iteration of Ogita
and Aishima: with ``R = I - X'X`` and ``S = X'AX`` in higher precision, ``X + XE`` has twice
as many right digits, where ``E`` follows from the residuals entry by entry.  That
divides by differences of eigenvalues.  Eigenvalues that stand too close for it form a
cluster: the vectors of each are turned by the eigenvectors of their small matrix
``X_c'(A - m I)X_c``, which shows differences that the whole matrix hides, and refined again.
Eigenvalues that stay equal are equal to this precision; any basis of theirs is right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows that are multiplied at once.
ROWS = 4096
MOST_STEPS = 30
#: Residuals (of a matrix with largest entry 1) that further steps may not lower.
SETTLED = 1e-15
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


@dataclass
class Spectrum:
    """What the fit list gives: count, sums, and eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """``y'y`` of whole numbers, exact: by floating-point products where they stay exact."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top < 1 << 26 and len(y) > 1:
        half = len(y) // 2
        return _products(y[:half]) + _products(y[half:])
    o = y.astype(object)
    return o.T @ o


def _summed(rows: DataFrame, part, width: int) -> list[list[int]]:
    """The rows of whole numbers that ``part`` makes of each batch, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                got = part(_matrix(batch.column(0).slice(k, ROWS)))
                total = got if total is None else total + got
        if total is not None:
            at, values = zip(*[((i, j), str(v)) for i, line in enumerate(total.tolist()) for j, v in enumerate(line)], strict=True)
            i, j = zip(*at, strict=True)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(values)})

    parts = rows.mapInArrow(run, "i int, j int, v string")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a matrix, however many rows
    out = [[0] * width for _ in range(max((r["i"] for r in added), default=-1) + 1)]
    for r in added:
        out[r["i"]][r["j"]] = int(r["v"])
    return out


def fit(rows: DataFrame) -> Spectrum | None:
    """The spectrum of ``rows``' one column, vectors of whole numbers; nothing if there are none."""
    (column,) = rows.columns
    lengths = [r[0] for r in rows.select(F.size(column).alias("d")).distinct().limit(2).collect()]
    if not lengths or not lengths[0]:
        return None
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {lengths}")
    d = lengths[0]
    counted = _summed(rows, lambda x: np.append(x.sum(0, dtype=object), len(x)).reshape(1, -1), d + 1)[0]
    sums, n = counted[:d], counted[d]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded
    gram = _summed(rows, lambda x: _products(x - middle), d)
    off = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    covariance = [[Fraction(n * gram[i][j] - off[i] * off[j], n * n) for j in range(d)] for i in range(d)]
    values, vectors = eigen(np.array([[_long_double(v) for v in line] for line in covariance], np.longdouble))
    return Spectrum(n, sums, values, vectors, float(sum(covariance[i][i] for i in range(d))))


def _long_double(v: Fraction) -> np.longdouble:
    head = float(v)
    return np.longdouble(head) + np.longdouble(float(v - Fraction(head)))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix, as doubles.

    Single-precision eigenvectors, refined with products in ``longdouble``.
    """
    a = a.astype(np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not scale > 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    x = x[:, ::-1].astype(np.longdouble)
    left = np.inf
    for _ in range(MOST_STEPS):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        before, left = left, max(np.abs(r).max(), np.abs(off).max())
        if left < SETTLED and left > before / 2:  # only rounding is left
            break
        bound = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > bound
        np.fill_diagonal(far, False)
        x = x + x @ np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = _turned(a, x, values, bound)
    for _ in range(2):  # what is left of the angles between close vectors
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def _turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: np.longdouble) -> np.ndarray:
    """``x`` with the vectors of each cluster of close eigenvalues turned to its own eigenvectors."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    x = x.copy()
    for cluster in np.split(order, cuts):
        if len(cluster) < 2:
            continue
        basis = x[:, cluster]
        shift = values[cluster].mean()
        small = basis.T @ (a @ basis - shift * basis)
        size = np.abs(small).max()
        if size > 0:
            _, turn = np.linalg.eigh((small / size).astype(np.float64))
            x[:, cluster] = basis @ turn.astype(np.longdouble)
    return x


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """For each row with a usable vector and each of the ``most`` first components: ``id_col``,
    ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null or non-finite entries are left out, of the fit as well.
    Repeated rows count as often as they stand there, and identifiers may be null or repeated.
    A component without variance (equal vectors, fewer of them than dimensions) has ``whitened``
    and ``explained`` 0 and doesn't count in ``identity_error``; with none left that is 0.
    ``deviation`` fails if it doesn't fit a long.  An empty table, or one of empty vectors, gives
    an empty result; vectors of different lengths are an error.  Other columns aren't read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(usable(F.col("v"))).select("id", whole_numbers(F.col("v")).alias("x"))
    found = fit(rows.select("x"))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("component", T.IntegerType())]
        + [T.StructField(c, t()) for c, t in [("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType), ("explained", T.DoubleType)]]
    )
    if found is None:
        empty = df.sparkSession.createDataFrame([], schema).withColumn("identity_error", F.lit(0.0))
        return empty.withColumnRenamed("id", id_col)
    n, sums, count = found.n, found.sums, min(most, len(found.sums))
    variances = found.values[:count]
    real = variances > found.trace * len(sums) * np.finfo(np.float64).eps
    turn = np.where(real, found.vectors[:, :count] / np.sqrt(np.where(real, variances, 1)), 0)
    explained = np.where(real, variances / (found.trace or 1), 0)

    def centred(x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
            return x * n - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)

    def projected(x: np.ndarray) -> np.ndarray:
        return (centred(x) / n).astype(np.float64) @ turn

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                z = projected(_matrix(batch.column(0).slice(k, ROWS)))
                total, first = total + z.T @ z, first + z.sum(0)
        i, j = np.divmod(np.arange(count * count), count)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total.ravel(), "a": np.where(i == j, first[i], 0)})

    # Of the whitened values, as they come out: their covariance around their own means.
    got = rows.select("x").mapInArrow(moments, "i int, j int, v double, a double").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("a").alias("a")).collect()
    second, mean = np.zeros((count, count)), np.zeros(count)
    for r in got:
        second[r["i"], r["j"]] = r["v"] / n
        if r["i"] == r["j"]:
            mean[r["i"]] = r["a"] / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count))[np.ix_(real, real)].max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x = _matrix(part.column(1))
                away = centred(x)
                top = int(np.abs(away).max(initial=0))
                far = (away if top * top * x.shape[1] < 1 << 63 else away.astype(object)) ** 2
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * count, n, np.int64)),
                        pa.array(np.repeat(far.sum(1), count), pa.int64()),
                        pa.array(projected(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(error)).withColumnRenamed("id", id_col)
