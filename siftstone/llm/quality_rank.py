"""A quality classifier by Bradley-Terry pairwise ranking.

Each document has a score that is linear in features of its whole text.  Of two documents
the better one is preferred with the probability that the logistic function gives for the
difference of their scores, so the weights are learned from preference pairs by logistic
loss on feature differences; what is common to all documents (an intercept) cancels out.
A document is accepted from a threshold on, which is a quantile of the scores of the
labelled documents: the share of them that is labelled bad lies below it.

Only the fit is bounded: it takes ``MOST_LABELS`` labelled documents at most, those with the
smallest hashes of their identifiers.  Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of the fitting sample, in documents.
MOST_LABELS = 20_000
#: Good documents whose pairs with all bad ones are summed up at once.
TILE = 256
#: The score at the threshold.
ACCEPTED = 0.3
RIDGE = 1e-3

#: Bytes that have a feature of their own: their share of the text.
SINGLE = b".,!?;:'\"()[]{}<>|*#$%&@/\\=+-_~^`\n\t"


def _classes() -> np.ndarray:
    """The class of each byte."""
    kind = np.zeros(256, np.int64)  # controls
    for b in range(256):
        c = chr(b)
        kind[b] = 1 if b == 32 else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if c.isdigit() and b < 128 else 5 if b >= 128 else 0
    for k, b in enumerate(SINGLE):
        kind[b] = 6 + k
    return kind


CLASSES = _classes()
N_CLASSES = 6 + len(SINGLE)
N_FEATURES = N_CLASSES + 8


def features(text: str | None) -> np.ndarray:
    """Features of a whole text; a null text is empty, and the empty text's are all zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:N_CLASSES] = np.sqrt(np.bincount(CLASSES, counts, minlength=N_CLASSES) / len(data))
    words = data.split()
    n = len(words)
    if n:
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        letters = counts[65:91].sum() + counts[97:123].sum()
        marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
        out[N_CLASSES:] = [
            same / n,
            np.sqrt(same / n),
            counts[65:91].sum() / max(letters, 1),
            marks / len(data),
            min(marks / n, 4.0),
            np.log1p(len(data) / n),
            len(set(words)) / n,
            np.log1p(n) / 10,
        ]
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, ``ACCEPTED`` at the threshold."""
        z = np.clip(self.raw(x) - self.threshold + np.log(ACCEPTED / (1 - ACCEPTED)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights for preference pairs (rows of ``x``), by Newton's method."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    d = z[better] - z[worse]
    w = np.zeros(x.shape[1] if x.ndim == 2 else N_FEATURES)
    if not len(d):
        return mean, scale, w
    ridge = RIDGE * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the probability of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge, d.T @ p / len(d) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit_all(x: np.ndarray, ups: np.ndarray, downs: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`fit_pairs` for all pairs of a better row (``ups``) and a worse one (``downs``).

    Newton's sums need no pair by itself, only row and column sums of the pairs'
    probabilities and one product for each tile of them.
    """
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    up, down = z[ups], z[downs]
    w, n = np.zeros(x.shape[1]), len(up) * len(down)
    for _ in range(rounds):
        high, low = up @ w, down @ w
        of_up, of_down = np.zeros(len(up)), np.zeros(len(down))  # sums of the probabilities of the wrong order
        curve_up, curve_down, cross = np.zeros(len(up)), np.zeros(len(down)), np.zeros((len(w), len(w)))
        for k in range(0, len(up), TILE):
            at = slice(k, k + TILE)
            p = 1 / (1 + np.exp(np.clip(high[at, None] - low[None, :], -500, 500)))
            of_up[at], of_down = p.sum(1), of_down + p.sum(0)
            p *= 1 - p
            curve_up[at], curve_down = p.sum(1), curve_down + p.sum(0)
            cross += up[at].T @ (p @ down)
        slope = up.T @ of_up - down.T @ of_down
        curve = up.T @ (curve_up[:, None] * up) + down.T @ (curve_down[:, None] * down) - cross - cross.T
        step = np.linalg.solve(curve / n + RIDGE * np.eye(len(w)), slope / n - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(x: np.ndarray, good: np.ndarray, quantile: float | None = None) -> Ranker:
    """Learns from labelled rows: every good one is preferred to every bad one.

    ``quantile`` of the scores is the threshold; the share of bad labels unless given.
    Without both labels all documents have one score, and are accepted.
    """
    ups, downs = np.flatnonzero(good == 1), np.flatnonzero(good != 1)
    if not len(ups) or not len(downs):
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, scale, w = fit_all(x, ups, downs)
    ranker = Ranker(mean, scale, w, 0.0)
    below = np.sort(ranker.raw(x))
    k = int(round((len(downs) / len(x) if quantile is None else quantile) * len(x)))
    ranker.threshold = float(below[0] - 1 if k <= 0 else below[-1] + 1 if k >= len(x) else (below[k - 1] + below[k]) / 2)
    return ranker


def held_out(identifier: Column) -> Column:
    """Rows that no fit may see: those whose hash of the identifier as text is divisible by 5."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELS) -> Ranker:
    """Fits on labelled documents that aren't held out, ``most`` at most.

    Null identifiers and labels teach nothing.  Of rows that share an identifier one counts,
    with the least label and the text of the least hash, so what the driver gets is bounded
    by ``most``.  Identifiers may be of any type that both tables share.  A null text counts as empty.  Without labels, or with one kind only, every
    document has one score and is accepted.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .dropna()
        .filter(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(most)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "y": batch["y"], "h": batch["h"], "x": [features(t) for t in batch["t"].tolist()]})

    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    met = texts.join(F.broadcast(known), "i").withColumn("i", F.col("i").cast("string"))
    found = met.mapInPandas(run, "i string, y int, h bigint, x array<double>")
    rows = found.groupBy("i", "y").agg(F.min_by("x", "h").alias("x")).toPandas().sort_values("i")  # at most ``most`` rows
    x = np.array(rows["x"].tolist()) if len(rows) else np.zeros((0, N_FEATURES))
    return fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Scores each row of ``docs``: ``id_col``, ``score`` (0 to 1) and ``predicted`` (1: accepted).

    A null text counts as empty; the empty text has the score of its (zero) features.  Null
    and repeated identifiers keep their rows; an empty table gives an empty result.  With
    ``keep_columns`` all of ``docs``' columns come along, as the struct ``row``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_columns else F.lit(0)
    if keep_columns:
        score_of = F.pandas_udf(lambda t: pd.Series(ranker.scores(np.array([features(s) for s in t])) if len(t) else np.zeros(0)), "double")
        scored = docs.select(body.alias("row"), F.col(f"`{id_col}`").alias(id_col), score_of(F.col(f"`{text_col}`")).alias("score"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"i": batch["i"], "score": ranker.scores(np.array([features(t) for t in batch["t"].tolist()]))})

        rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInPandas(run, "i string, score double")
        scored = rows.select(F.col("i").cast(kind).alias(id_col), "score")  # as strings, since pandas has no null among integers
    return scored.withColumn("predicted", F.when(F.col("score") >= ACCEPTED, 1).otherwise(0).cast("int"))
