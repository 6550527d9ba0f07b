"""Evidence rows: removing repeats, tags and statuses, ranked candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import require_none, told_apart


def dedup(df: DataFrame, content: Sequence[str], count: str = "occurrence_count", name: str = "evidence_id") -> DataFrame:
    """Equal rows become one, with their number and an identifier that is a digest of the content."""
    return df.groupBy(*content).agg(F.count(F.lit(1)).alias(count)).withColumn(name, F.md5(told_apart(content)))


def require_one_payload(df: DataFrame, key: str, payload: Sequence[str]) -> None:
    """Raises if an identifier stands for different contents."""
    bad = df.groupBy(key).agg(F.countDistinct(F.struct(*payload)).alias("payloads")).filter("payloads > 1")
    require_none(bad, f"{key} has several payloads")


def tags(df: DataFrame, key: str, tag: str, order: Sequence[str]) -> DataFrame:
    """(key, ``tags`` sorted, ``primary_tag``: the first in ``order`` that the key has)."""
    wanted = F.array(*[F.lit(t) for t in order])
    own = df.groupBy(key).agg(F.sort_array(F.collect_set(tag)).alias("tags"))  # no more than there are kinds of tags
    return own.withColumn("primary_tag", F.get(F.filter(wanted, lambda t: F.array_contains("tags", t)), 0))


def ladder(*steps: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds; statuses that exclude each other."""
    out = F.lit(otherwise)
    for name, condition in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def rank_candidates(df: DataFrame, key: str, candidate: str, score: str, source: str, keep: int = 10) -> DataFrame:
    """The best candidate of each key and up to ``keep`` alternatives.

    A candidate scores its best evidence plus four for each further source, three sources at
    most; equal scores go to more sources, then to the lesser candidate.
    """
    rolled = df.groupBy(key, candidate).agg(F.max(score).alias("best"), F.countDistinct(source).alias("sources"))
    total = F.col("best") + 4 * F.least(F.lit(3), F.col("sources") - 1)
    # one order and one count of the same rows, which need one shuffle by key
    w = Window.partitionBy(key)
    order = w.orderBy(F.desc("total"), F.desc("sources"), candidate)
    scored = rolled.withColumn("total", total).withColumns({"n": F.row_number().over(order), "candidates": F.count(F.lit(1)).over(w)})
    best = scored.filter(F.col("n") <= keep + 1)
    lists = best.groupBy(key, "candidates").agg(F.sort_array(F.collect_list(F.struct("n", F.col(candidate).alias("c"), F.col("total").alias("t")))).alias("top"))
    first = F.col("top")[0]
    return lists.select(
        key,
        first["c"].alias("chosen"),
        first["t"].alias("chosen_score"),
        F.transform(F.slice("top", 2, keep), lambda x: x["c"]).alias("alternatives"),
        "candidates",
    )


def distinct_names(df: DataFrame, key: Sequence[str], name: str, separator: str = "; ") -> DataFrame:
    """(key, ``names``): the distinct names, sorted and joined."""
    return df.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(name)), separator).alias("names"))


def single_pair(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """The one pair of values of a key; null where an axis has several distinct values or none."""
    found = df.groupBy(key).agg(F.countDistinct(first).alias("n1"), F.countDistinct(second).alias("n2"), F.min(first).alias(first), F.min(second).alias(second))
    one = (F.col("n1") == 1) & (F.col("n2") == 1)
    return found.select(key, F.when(one, F.col(first)).alias(first), F.when(one, F.col(second)).alias(second))
