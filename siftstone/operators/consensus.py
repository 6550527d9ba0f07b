"""Consensus of votes, with deterministic ties.

Votes are tallied by item and label before they are shuffled again, so an item with very
many votes costs no more than its labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(votes: DataFrame, item: Sequence[str], label: str, at: str) -> DataFrame:
    """(item, label): ``votes`` and the latest time."""
    return votes.groupBy(*item, label).agg(F.count(F.lit(1)).alias("votes"), F.max(at).alias("latest"))


def priority(label: Column, order: Sequence[str]) -> Column:
    """A label's place in ``order``; labels that it lacks come after all."""
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(label == name, k).otherwise(out)
    return out


def plurality(votes: DataFrame, item: Sequence[str], label: str, at: str, order: Sequence[str]) -> DataFrame:
    """One row for each item that has votes.

    ``consensus_label`` has most votes; among equals the first in ``order`` wins, then the
    least label.  ``tied`` says that another label has as many, ``unanimous`` that there is
    no other.  ``reviewed_at`` is the time of the latest vote.
    """
    counts = tally(votes.filter(F.col(label).isNotNull()), item, label, at)
    ranked = F.struct(-F.col("votes"), priority(F.col(label), order), F.col(label))
    best = counts.groupBy(*item).agg(
        F.min(ranked).alias("best"),
        F.sum("votes").alias("review_count"),
        F.count(F.lit(1)).alias("labels"),
        F.collect_list("votes").alias("all"),  # as many as there are labels
        F.max("latest").alias("reviewed_at"),
    )
    most = -F.col("best")["col1"]
    return best.select(
        *item,
        F.col("best")[label].alias("consensus_label"),
        "review_count",
        (F.col("labels") == 1).alias("unanimous"),
        (F.size(F.filter("all", lambda n: n == most)) > 1).alias("tied"),
        "reviewed_at",
    )


def strict_majority(votes: DataFrame, item: Sequence[str], label: str, otherwise: str = "Disputed") -> DataFrame:
    """(item, ``result``): the label with more than half of the votes, else ``otherwise``."""
    counts = votes.groupBy(*item, label).agg(F.count(F.lit(1)).alias("votes"))
    top = counts.groupBy(*item).agg(F.max(F.struct("votes", label)).alias("top"), F.sum("votes").alias("all"))
    return top.select(*item, F.when(F.col("top.votes") * 2 > F.col("all"), F.col(f"top.{label}")).otherwise(otherwise).alias("result"))


def with_flags(df: DataFrame, label: str, groups: Mapping[str, Sequence[str]], tied: str | None = None, on_tie: str | None = None) -> DataFrame:
    """A column for each group: whether ``label`` is in it (null for a null label).

    A tie makes the flag ``on_tie`` true, whatever it was.
    """
    out = df
    for name, members in groups.items():
        flag = F.col(label).isin(*members)
        out = out.withColumn(name, F.when(F.col(tied), True).otherwise(flag) if tied and name == on_tie else flag)
    return out


def label_counts(votes: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """(item, ``counts``): the labels with their numbers of votes, a map sorted by label."""
    counts = votes.groupBy(*item, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*item).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("counts"))


def latest(votes: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; of equal times the one with the greatest ``tie``.

    An aggregate rather than a window: rows are combined before the shuffle.
    """
    rest = [c for c in votes.columns if c not in key]
    best = votes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row"))
    return best.select(*key, "row.*")


def ordered_history(votes: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(key, ``history``): values in the order of ``order``."""
    return votes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("h")).select(*key, F.transform("h", lambda x: x[value]).alias("history"))
