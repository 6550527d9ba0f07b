"""Connected components of a graph that no machine could hold.

Alternating large-star and small-star steps: in a large-star step each node ties its larger
neighbours to the least node around it, in a small-star step it ties its smaller neighbours
and itself to the least of them.  The edges never grow in number, and end as stars around
the least node of each component.  Minima are combined before their shuffle; joins with a
hub on one side are left to adaptive execution, which splits large partitions.  Each round
is written to the shared folder, so its lineage is short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, written

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def least_reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``root``) for each node that ``edges`` joins to a smaller one.

    ``root`` is the least node that can be reached; nodes that are missing are their own
    roots.  Edges with a null end and loops mean nothing; repeated edges count once.
    """
    x, y = F.col(f"`{a}`").cast("long"), F.col(f"`{b}`").cast("long")
    now = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), (x != y).alias("real")).filter("real").select("a", "b").distinct()
    now = written(now, "edges")
    was = _signature(now)
    for _ in range(MOST_ROUNDS):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(apart(least), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "edges")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lower = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        tied = down.join(apart(lower), F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = written(tied.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        is_ = _signature(now)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
