"""Checks that stop a pipeline.

Many steps must fail rather than go on with bad rows.  A check takes a frame of violations
and reads at most a few of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Rows break a rule; the message shows some of them."""


def require_none(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raises if ``violations`` has any row."""
    found = violations.limit(shown).collect()
    if found:
        raise CheckFailed(f"{message}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raises for missing or repeated columns; needs no job."""
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    missing = sorted(set(required) - set(df.columns))
    if repeated or missing:
        raise CheckFailed(f"missing columns {missing}, repeated columns {repeated}")


def duplicates(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def not_contiguous(df: DataFrame, group: Sequence[str], position: str, repeats: bool = False) -> DataFrame:
    """Groups whose positions aren't exactly 1..n; ``repeats``: whether a position may be there more than once."""
    rows = df.groupBy(*group, position).agg(F.count(F.lit(1)).alias("rows"))
    found = rows.groupBy(*group).agg(F.min(position).alias("low"), F.max(position).alias("high"), F.count(position).alias("kinds"), F.sum(F.lit(1) if repeats else F.col("rows")).alias("n"))
    return found.filter((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("kinds") != F.col("n")))


def told_apart(content: Sequence[str]) -> Column:
    """The columns as one text, which no other values give: each with its length in front, nulls as ``-``."""
    parts = []
    for c in content:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def fingerprint(df: DataFrame, keys: Sequence[str], content: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Keys with an MD5 of the content columns as text, which stands for a row's version."""
    return df.select(*keys, F.md5(told_apart(content)).alias(name))


def table_fingerprint(df: DataFrame, content: Sequence[str]) -> DataFrame:
    """One row for a whole table: ``rows`` and ``digest``, which no order of the rows changes.

    The digest adds up the halves of the rows' SHA-256, so repeated rows count.
    """
    sha = F.sha2(told_apart(content), 256)
    halves = [F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = [F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string") for h in halves]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest"))


def require_unchanged_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], content: Sequence[str]) -> None:
    """Raises unless both frames have the same keys with the same content."""
    b, a = fingerprint(before, keys, content), fingerprint(after, keys, content)
    require_none(differing(b, a), "rows have changed")


def lost_or_changed(before: DataFrame, after: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys of ``before`` whose rows ``after`` doesn't hold as often with the same content; keys that only ``after`` has don't count.

    One shuffle of keys and fingerprints by key, without a join.
    """
    b = fingerprint(before, keys, content).withColumns({"__b": F.lit(1), "__a": F.lit(0)})
    a = fingerprint(after, keys, content).withColumns({"__b": F.lit(0), "__a": F.lit(1)})
    versions = b.unionByName(a).repartition(*keys).groupBy(*keys, "fingerprint").agg(F.sum("__b").alias("b"), F.sum("__a").alias("a"))
    return versions.groupBy(*keys).agg(F.bool_or(F.col("b") > 0).alias("was"), F.bool_or(F.col("a") != F.col("b")).alias("differs")).filter("was AND differs").select(*keys)


def changed(before: DataFrame, after: DataFrame, keys: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Keys of ``before`` that ``after`` lacks or holds with another fingerprint."""
    b = before.select(*keys, F.col(name).alias("__was"))
    a = after.select(*keys, F.col(name).alias("__is"))
    return b.join(a, list(keys), "left").filter(~F.col("__was").eqNullSafe(F.col("__is"))).drop("__was", "__is")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
