"""Embedding near-dedup by sorted projection passes.

Each pass draws random hyperplanes and gives each vector the signs of its projections, one
concatenated hash.  Sorted by that hash, similar vectors tend to stand close together.
Each vector is compared with its neighbours in a bounded window, by exact cosine in double
precision.  Several passes make up for neighbours that one order tears apart; the links of
all passes are merged, and their components found.

Equal vectors are one point with a multiplicity from the start, so copies fill no window.

Windows.  A pass's order is cut into blocks of ``BLOCK`` points, and each block is compared
with itself and the next one.  Cells are what agrees on the first ``log2(points / BLOCK)``
signs (rounded up; ``CELL`` at most): all blocks that touch a cell are compared with each
other, so two points of a cell are compared however many crowd there.  Places in the order
come from two levels (counts of hash ranges, summed up, and ranks within a range), so that
no task ranks a whole pass.

Recall.  Two vectors at angle ``a`` agree on a sign with probability ``1 - a / pi``, and
meet in a pass that gives them one cell.  The number of passes follows from the number of
points, so that vectors at the given cosine meet with probability ``RECALL``: 13 passes for
50,000 points, 27 for 1 million, 61 for 30 million, 135 for a billion.  Comparisons grow with the square of
what crowds in a cell, as the links do that are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import least_reachable

#: Passes at least, and the recall that more are added for.
PASSES = 12
RECALL = 0.995
BLOCK = 512
#: The most leading signs of a cell, the least of a range that is ranked, and about how many points one task ranks.
CELL = 40
LEAST_SIGNS = 10
RANKED = 1 << 16
BITS = 60
SEED = 31_337


def planes(dimensions: int, pass_: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, pass_, dimensions]).standard_normal((dimensions, BITS))


def hashes(x: np.ndarray, pass_: int, seed: int = SEED) -> np.ndarray:
    """The hash of each row: signs of projections, the first in the highest bit."""
    signs = x @ planes(x.shape[1], pass_, seed) > 0
    return (signs * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(1)


def _valid(vector):
    """Whether a vector can link: neither null nor zero, and all of its components finite."""
    finite = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _places(keyed: DataFrame, cell: int) -> DataFrame:
    """(``pass``, ``point``, ``dim``, ``hash``) with ``block``: where the point stands in the pass's order.

    Ranks are taken within ranges of leading signs.  Ranges are no longer than a cell, whose
    points are compared in any order, so a range above ``RANKED`` points is dealt over parts.
    """
    order = ["dim", "pass", "bucket"]
    dealt = keyed.withColumn("bucket", F.shiftright("hash", BITS - max(LEAST_SIGNS, cell)))
    crowds = dealt.groupBy(*order).agg(F.ceil(F.count(F.lit(1)) / RANKED).alias("parts")).filter("parts > 1")
    dealt = dealt.join(crowds, order, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("point"), "parts"), F.lit(0))).drop("parts")
    before = Window.partitionBy("dim", "pass").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*order, "part").agg(F.count(F.lit(1)).alias("n")).select(*order, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*order, "part").orderBy("hash", "point")) - 1
    placed = dealt.withColumn("rank", rank).join(starts, [*order, "part"])
    return placed.select("dim", "pass", "point", "hash", F.floor((F.col("start") + F.col("rank")) / BLOCK).cast("long").alias("block"))


def cell_depth(points: int) -> int:
    """Leading signs that would leave ``BLOCK`` of evenly spread points in a cell."""
    return min(CELL, max(0, math.ceil(math.log2(max(points, 1) / BLOCK))))


def passes_for(points: int, cosine: float) -> int:
    """Passes that bring two vectors at ``cosine`` into one cell with probability ``RECALL``."""
    missed = 1 - (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** cell_depth(points)
    if missed in (0, 1):
        return PASSES
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(missed)))


def _pairs(points: DataFrame, cosine: float, passes: int, seed: int, cell: int) -> DataFrame:
    """The pairs (``a`` < ``b``) of points that share a window or a cell and reach ``cosine``.

    Each pass compares all points of a cell, so a pair is told by the first pass that gives both
    one cell, and passes after it leave it out; a crowd's pairs aren't told again in each pass.
    Only neighbours that share no cell, or not yet, may be told more than once.
    """

    def hash_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby(batch["v"].map(len)):
                x = _unit(rows["v"])
                of = np.stack([hashes(x, p, seed) for p in range(passes)], 1)
                yield pd.DataFrame({"dim": np.int32(dim), "point": rows["point"], "v": rows["v"], "hashes": list(of)})

    kind = points.schema["v"].dataType.simpleString()
    hashed = written(points.select("point", "v").mapInPandas(hash_all, f"dim int, point bigint, v {kind}, hashes array<bigint>"), "hashed")
    keyed = hashed.select("dim", "point", F.posexplode("hashes").alias("pass", "hash"))
    placed = written(_places(keyed, cell), "places")
    touched = written(placed.select("dim", "pass", "block", F.shiftright("hash", BITS - cell).alias("cell")).distinct(), "touched")
    other = touched.withColumnRenamed("block", "last")
    crowded = touched.join(other, ["dim", "pass", "cell"]).filter("last >= block + 2").select("dim", "pass", "block", "last").distinct()
    sides = F.explode(F.array(F.struct(F.col("block").alias("i"), (F.col("block") + 1).alias("j"), F.lit(0).alias("side")), F.struct((F.col("block") - 1).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))
    usual = placed.select("dim", "pass", "point", sides.alias("s")).select("dim", "pass", "point", "s.*")
    ends = crowded.select("dim", "pass", F.col("block").alias("i"), F.col("last").alias("j"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("at")), F.struct(F.lit(1).alias("side"), F.col("last").alias("at")))).alias("e"))
    ends = ends.select("dim", "pass", "i", "j", "e.side", F.col("e.at").alias("block"))
    extra = placed.select("dim", "pass", "point", "block").join(ends, ["dim", "pass", "block"]).select("dim", "pass", "point", "i", "j", "side")
    earlier = F.transform(F.slice("hashes", F.lit(1), F.col("pass")), lambda h: F.shiftright(h, BITS - cell).cast("int" if cell < 31 else "long"))
    rows = usual.unionByName(extra).join(hashed.select("point", "v", "hashes"), "point").withColumn("cells", earlier).drop("hashes")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, side = group["point"].to_numpy(), group["side"].to_numpy()
        x = _unit(group["v"]) if len(group) else np.zeros((0, 1))
        cells = np.array(group["cells"].tolist(), np.int64).reshape(len(group), -1 if len(group) else 0)
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        i, j = np.nonzero(x[left] @ x[right].T >= cosine)
        i, j = left[i], right[j]
        if len(group) and group["j"].iloc[0] == group["i"].iloc[0] + 1:
            k, m = np.nonzero(np.triu(x[left] @ x[left].T >= cosine, 1))
            i, j = np.concatenate([i, left[k]]), np.concatenate([j, left[m]])
        told = np.zeros(len(i), bool)
        for c in cells.T:
            told |= c[i] == c[j]
        a, b = ids[i[~told]], ids[j[~told]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("dim", "pass", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, passes: int | None = None, seed: int = SEED) -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``), a row for each row of ``df``.

    Vectors are linked if their cosine reaches ``cosine``; ``n_links`` counts the other rows
    that a row is linked with, and ``component_id`` is the smallest identifier that links
    reach.  Vectors that are null, empty or zero or hold null or non-finite components, and
    rows without an identifier, link with nothing, nor do vectors of different lengths.
    Repeated rows are rows of their own and link with each other.  An empty table gives an
    empty result.  Other columns are not read.  Without ``passes``, :func:`passes_for` tells
    their number.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    fit = rows.filter(F.col("id").isNotNull() & F.coalesce(_valid(F.col("v")), F.lit(False)))
    points = written(fit.groupBy("v").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("copies")), "points")
    # Repeated identifiers can make one identifier the least of two vectors: such points get numbers of their own.
    clash = Window.partitionBy("point").orderBy("v")
    points = written(
        points.withColumn("least", F.col("point")).withColumn("nth", F.row_number().over(clash)).withColumn("point", F.when(F.col("nth") == 1, F.col("point")).otherwise(-F.abs(F.xxhash64("v")) - 2)).drop("nth"),
        "points",
    )
    count = points.count()
    pairs = written(_pairs(points, cosine, passes or passes_for(count, cosine), seed, cell_depth(count)).distinct(), "pairs")
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ways.join(points.select(F.col("point").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = least_reachable(pairs)
    known = points.join(counts, F.col("point") == F.col("a"), "left").join(roots, F.col("point") == F.col("node"), "left").withColumn("root", F.coalesce("root", "point"))
    known = written(known.select("v", "root", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")), "known")
    heads = known.groupBy("root").agg(F.min("least").alias("head"))
    known = known.join(heads, "root").select(F.col("v").alias("w"), "n", "head")
    linked = fit.join(known, F.col("v") == F.col("w")).select("id", "n", "head")
    alone = rows.filter(~(F.col("id").isNotNull() & F.coalesce(_valid(F.col("v")), F.lit(False)))).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("head"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("head").alias("component_id"), F.col("id").eqNullSafe(F.col("head")).alias("kept")
    )
