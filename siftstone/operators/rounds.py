"""Positions, rounds and balanced groups; orders that a hash decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the rank, from 1, of each row in its group in ascending ``order`` (columns, nulls first).

    No task ranks a whole group: splitters that Spark samples over all columns of the order
    deal the rows into ranges of about equal size, the ranges' counts are summed up, and ranks
    are taken within a range.  Rows alike in the order are told apart by a hash of the whole
    row, so neither a constant column nor outliers make a large range.  The dealt rows are
    kept in the checkpoint folder, since sampling again could give other ranges.
    """
    tie = "__tie"
    dealt = df.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`").cast("string") if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in df.columns]))
    dealt = staged(dealt.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*group, *order, tie)]).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order, tie)))
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    out = inside.join(starts, same).withColumn(name, (F.col("__start") + F.col("__nth")).cast("long"))
    return out.drop(tie, "__part", "__p", "__nth", "__start", *[f"__g{k}" for k in range(len(group))])


def json_pair(a: Column, b: Column) -> Column:
    """The text of a JSON array of two strings, with a space after the comma."""

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    return F.concat(F.lit("["), quoted(a), F.lit(", "), quoted(b), F.lit("]"))


def digest_positions(df: DataFrame, group: Sequence[str], a: str, b: str, keys: Sequence[str], name: str = "position") -> DataFrame:
    """Positions within each group in the order of the MD5 of a JSON pair, then of the keys."""
    keyed = df.withColumn("__md5", F.md5(json_pair(F.col(a).cast("string"), F.col(b).cast("string"))))
    return ranked(keyed, group, ["__md5", *keys], name).drop("__md5")


def group_numbers(df: DataFrame, group: Sequence[str], name: str = "group_number") -> DataFrame:
    """A row for each group with its size and number, in the order of the group's columns.

    The numbering runs over the groups, which an aggregate has reduced the rows to.
    """
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).withColumn(name, F.row_number().over(Window.orderBy(*group)))


def balanced(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Deals each group into ``ceil(n / most)`` buckets whose sizes differ by one at most.

    The buckets are those of ``ntile``, whose number may here depend on the group.
    """
    sizes = df.groupBy(*[F.col(g).alias(f"__of{k}") for k, g in enumerate(group)]).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__of{k}"))
    numbered = ranked(df, group, order, "__r").withColumn("__r", F.col("__r") - 1).join(sizes, same)
    buckets = F.ceil(F.col("__n") / F.lit(most)).cast("long")
    return _tile(numbered.withColumn("__b", buckets)).drop("__r", "__n", "__b", "__q", "__m", "__big", *[f"__of{k}" for k in range(len(group))])


def _tile(df: DataFrame) -> DataFrame:
    small, large = F.col("__q"), F.col("__q") + 1
    out = df.withColumn("__q", F.floor(F.col("__n") / F.col("__b"))).withColumn("__m", F.col("__n") % F.col("__b"))
    out = out.withColumn("__big", F.col("__m") * large)
    early = F.col("__r") < F.col("__big")
    bucket = F.when(early, F.floor(F.col("__r") / large)).otherwise(F.col("__m") + F.floor((F.col("__r") - F.col("__big")) / small))
    inside = F.when(early, F.col("__r") % large).otherwise((F.col("__r") - F.col("__big")) % small)
    return out.withColumn("bucket", (bucket + 1).cast("long")).withColumn("bucket_position", (inside + 1).cast("long"))


def append_positions(existing: DataFrame, new: DataFrame, batch: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """``new`` with positions that go on after the greatest of their batch."""
    last = existing.groupBy(*batch).agg(F.max(position).alias("__last"))
    placed = ranked(new, batch, order, "__rank").join(last, list(batch), "left")
    return placed.withColumn(position, (F.coalesce("__last", F.lit(0)) + F.col("__rank")).cast("long")).drop("__rank", "__last")


def regroup(df: DataFrame, key: Sequence[str], batch: str, preferred: Sequence[Column]) -> DataFrame:
    """``df`` with ``destination``: the first batch of each key in the order ``preferred``."""
    return df.withColumn("destination", F.first(batch).over(Window.partitionBy(*key).orderBy(*preferred)))


#: Hexadecimal digits that tell ranges of a digest.
LEADING = 5


def hash_order(salt: str, seed: int, ordinal: Column) -> Column:
    """The sort key of a seeded shuffle: SHA-256 of ``<salt>:<seed>:<ordinal>`` in hex."""
    return F.sha2(F.concat(F.lit(f"{salt}:{seed}:"), ordinal.cast("string")), 256)


def logical_batches(df: DataFrame, digest: str, ties: Sequence[str], size: int, prefix: str) -> DataFrame:
    """Ordinals, batch numbers and positions of all rows in the order of a hex digest, and batch codes.

    The order is global, but no task ranks all rows: those that share the first ``LEADING`` digits
    are ranked together, and running sums over their counts do the rest, one over those that
    share three digits and one over the 4,096 sums of these.
    """
    dealt = df.withColumn("__b", F.substring(digest, 1, LEADING))
    counts = dealt.groupBy(F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__top", F.substring("__c", 1, 3))
    tops = counts.groupBy(F.col("__top").alias("__t")).agg(F.sum("__n").alias("__m"))  # 4,096 rows at most
    above = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__t", F.coalesce(F.sum("__m").over(above), F.lit(0)).alias("__base"))
    before = Window.partitionBy("__top").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("__c", "__top", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__in"))
    starts = inside.join(F.broadcast(tops), F.col("__top") == F.col("__t")).select("__c", (F.col("__base") + F.col("__in")).alias("__s"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(digest, *ties)) - 1
    out = dealt.withColumn("__r", rank).join(starts, F.col("__b") == F.col("__c")).withColumn("ordinal", F.col("__s") + F.col("__r"))
    batch = F.floor(F.col("ordinal") / size).cast("long") + 1
    return (
        out.withColumn("batch_number", batch)
        .withColumn("position", (F.col("ordinal") % size + 1).cast("long"))
        .withColumn("batch_code", F.concat(F.lit(prefix + "-"), F.format_string("%03d", batch)))
        .drop("__b", "__c", "__s", "__r")
    )


def top_by_hash(df: DataFrame, key: Column, n: int, salt: str = "sample", seed: int = 0) -> DataFrame:
    """The ``n`` rows with the least hashes: a sample that any engine repeats."""
    return df.orderBy(hash_order(salt, seed, key)).limit(n)
