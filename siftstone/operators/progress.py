"""Review progress of batches, and navigation within them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def batch_progress(batches: DataFrame, items: DataFrame, reviews: DataFrame, batch: str, item: str, reviewer: str, caller) -> DataFrame:
    """``batches`` with ``total`` (items), ``team`` (items that anyone reviewed) and ``personal`` (that ``caller`` did).

    ``complete`` needs at least one item; an empty batch stays, with zeros.
    """
    by_item = reviews.groupBy(item).agg(F.lit(True).alias("any"), F.bool_or(F.col(reviewer) == F.lit(caller)).alias("own"))
    counts = (
        items.select(batch, item)
        .join(by_item, item, "left")
        .groupBy(batch)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("any")).alias("team"), F.count_if(F.col("own")).alias("personal"))
    )
    out = batches.join(counts, batch, "left")
    for name in ("total", "team", "personal"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out.withColumn("complete", (F.col("total") > 0) & (F.col("team") == F.col("total")))


def pending_batches(progress: DataFrame) -> DataFrame:
    """Batches that still have items without a review."""
    return progress.filter(F.col("team") < F.col("total"))


def menu_order(total: Column, team: Column, code: Column, series: str, position: Column) -> list[Column]:
    """Unfinished first (an empty batch counts as finished), then by series letter, code and position."""
    letter = F.regexp_extract(code, series, 1)
    return [(team >= total).asc(), F.when(letter == "", None).otherwise(letter).asc_nulls_last(), code.asc(), position.asc()]


def neighbours(items: DataFrame, batch: Sequence[str], position: str) -> DataFrame:
    """``items`` with ``next_position`` and ``previous_position``; the ends meet."""
    w = Window.partitionBy(*batch)
    ordered = w.orderBy(position)
    return items.withColumn("next_position", F.coalesce(F.lead(position).over(ordered), F.min(position).over(w))).withColumn(
        "previous_position", F.coalesce(F.lag(position).over(ordered), F.max(position).over(w))
    )


def seek(items: DataFrame, anchors: DataFrame, batch: Sequence[str], position: str, anchor: str) -> DataFrame:
    """For each anchor, which need not be a position of an item, the position after and before it, with wrap-around.

    Positions and anchors stand in one order, which sampled splitters deal into ranges, so
    neither a task holds a whole batch nor are anchors joined with its items.  Each anchor
    looks back to the last position below and ahead to the first above it in its range, else
    at the ends of the ranges beside it.  Anchors of batches without items drop out.
    """
    at = items.select(*batch, F.col(position).cast("long").alias("__at"), F.lit(1).alias("__item")).distinct()
    asked = anchors.select(*batch, F.col(anchor).cast("long").alias("__at"), F.lit(0).alias("__item")).distinct()
    both = staged(at.unionByName(asked).repartitionByRange(*batch, "__at").withColumn("__part", F.spark_partition_id()))
    seen = F.when(F.col("__item") == 1, F.col("__at"))
    w = Window.partitionBy(*batch, "__part").orderBy("__at")
    below, above = w.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy(*batch, "__part").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumns({"before": F.max(seen).over(below), "after": F.min(seen).over(above)}).filter("__item = 0")
    ranges = both.groupBy(*batch, "__part").agg(F.min(seen).alias("low"), F.max(seen).alias("high"))
    of = Window.partitionBy(*batch).orderBy("__part")  # a row for each range
    whole = Window.partitionBy(*batch)
    ends = ranges.select(
        *batch, "__part", F.max("high").over(of.rowsBetween(Window.unboundedPreceding, -1)).alias("left"), F.min("low").over(of.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
        F.min("low").over(whole).alias("first"), F.max("high").over(whole).alias("last"),
    )
    out = found.join(ends.filter("first IS NOT NULL"), [*batch, "__part"])
    return out.select(*batch, F.col("__at").alias(anchor), F.coalesce("after", "right", "first").alias("next_position"), F.coalesce("before", "left", "last").alias("previous_position"))


def resume(items: DataFrame, batch: Sequence[str], position: str, item: str, reviewed: str) -> DataFrame:
    """The item to go on with in each batch: the first one without a review, else the first."""
    first = F.min_by(F.struct(item, position, reviewed), F.struct(F.col(reviewed).cast("int"), position, item))
    return items.groupBy(*batch).agg(first.alias("r")).select(*batch, "r.*")


def pending(items: DataFrame, reviewed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items without a review under their key."""
    return items.join(reviewed.select(*key).distinct(), list(key), "left_anti")


def prior_review(items: DataFrame, reviewed: DataFrame, key: Sequence[str], batch: str, name: str = "previously_reviewed") -> DataFrame:
    """Whether an item of another batch with the same canonical key has a review.

    ``reviewed`` holds (key, batch) of items with reviews; an item is in one batch.  The
    least and the greatest batch of a key answer for all of its items, so keys with very
    many items need no self join.
    """
    seen = reviewed.groupBy(*key).agg(F.min(batch).alias("__low"), F.max(batch).alias("__high"))
    other = (F.col("__low") != F.col(batch)) | (F.col("__high") != F.col(batch))
    return items.join(seen, list(key), "left").withColumn(name, F.coalesce(other, F.lit(False))).drop("__low", "__high")
