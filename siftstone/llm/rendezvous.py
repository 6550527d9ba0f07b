"""Sharding by rendezvous hashing over weighted shards.

Every shard bids for every record: with ``u`` a hash of (record key, shard) in (0, 1), the
bid is ``-ln(u) / weight`` and the lowest bid wins, so a shard gets records in proportion
to its weight.  A shard's bids depend on no other shard: adding one moves only records that
the new shard outbids, and removing one moves only its own.

Slots number a shard's records from 0 without gaps.  They come from two levels, so that no
task ranks a whole shard: records fall into hash buckets, more of them where there are more
records, bucket totals (shards x buckets rows) are summed up in order, and ranks are taken
within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bits, unit

SEED = 20_011


def winner(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard, an index into ``weights``, that wins ``key``; shards of weight 0 win nothing.

    A null key is a key like any other.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are not negative, and one of them at least is positive")
    held = F.xxhash64(F.lit(seed), key)
    bids = [
        F.struct((-F.log(unit(F.xxhash64(held, F.lit(shard)))) / F.lit(float(w))).alias("bid"), F.lit(shard).alias("shard"))
        for shard, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*bids))["shard"]


def assign_shards(
    df: DataFrame,
    key_col: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 16,
    grown_weights: Sequence[float] | None = None,
    shard_col: str = "shard",
    grown_col: str = "grown_shard",
) -> DataFrame:
    """``df`` with each row's shard, and its shard under ``grown_weights`` if these are given.

    Equal keys share a shard.  A column of ``df`` that has a result's name is replaced.
    """
    key = F.col(f"`{key_col}`")
    out = df.withColumn(shard_col, winner(key, weights).cast("int"))
    return out.withColumn(grown_col, winner(key, grown_weights).cast("int")) if grown_weights else out


def assign_slots(df: DataFrame, shard_col: str, order: Sequence[str], slot_col: str = "slot") -> DataFrame:
    """``df`` with gapless slots from 0 within each shard.

    Rows without a shard drop out.  ``order`` names columns that tell records apart; records equal in all of them take
    neighbouring slots in either order.
    """
    names = [F.col(f"`{c}`") for c in order]
    shard = F.col(f"`{shard_col}`")
    buckets = 1 << range_bits(df.count())
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(SEED), *names), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy(shard.alias("__shard"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*names)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, (shard == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(slot_col, (F.col("__start") + F.col("__rank")).cast("long"))
        .drop("__bucket", "__rank", "__shard", "__b", "__start")
    )
