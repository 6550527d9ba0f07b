"""Versioned saves: an ordered log of commands folded into current rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "item string, reviewer string, seq bigint, result string, label string, version int"


def fold(key: tuple, commands: pd.DataFrame) -> pd.DataFrame:
    """Results of the commands of one item and reviewer, in the order of ``seq``.

    A command has ``submission``, ``label`` and the version that it ``expected``.  A repeat
    of the last saved submission with the same label and version counts as done; any other
    use of a known submission is a conflict; a wrong version is stale.
    """
    seen: dict[str, tuple[str, int]] = {}
    label, version, out = None, 0, []
    for c in commands.sort_values("seq").itertuples():
        known = seen.get(c.submission)
        if known:
            same = known == (c.label, int(c.expected) + 1) and version == known[1]
            result = "replayed" if same else "conflict"
        elif int(c.expected) != version:
            result = "stale"
        else:
            version, label = version + 1, c.label
            seen[c.submission] = (label, version)
            result = "inserted" if version == 1 else "updated"
        out.append((key[0], key[1], int(c.seq), result, label, version))
    return pd.DataFrame(out, columns=["item", "reviewer", "seq", "result", "label", "version"])


def apply_log(commands: DataFrame) -> DataFrame:
    """A result for each command of ``commands`` (item, reviewer, seq, submission, label, expected).

    The state of an item and reviewer is a few values, and their commands are few: one
    person's corrections of one answer.
    """
    return commands.select(F.col("item").cast("string"), F.col("reviewer").cast("string"), "seq", "submission", "label", "expected").groupBy("item", "reviewer").applyInPandas(fold, RESULT)


def guarded(commands: DataFrame, reviews: DataFrame) -> DataFrame:
    """``commands`` (with ``image``) with ``blocked``: a first save of an image that someone else has reviewed and the reviewer has not.

    ``reviews`` has (``image``, ``reviewer``).
    """
    by = reviews.groupBy(F.col("image").alias("__image")).agg(F.min("reviewer").alias("__low"), F.max("reviewer").alias("__high"))
    own = reviews.select(F.col("image").alias("__of"), F.col("reviewer").alias("__by")).distinct().withColumn("__own", F.lit(True))
    out = commands.join(by, F.col("image") == F.col("__image"), "left").join(own, (F.col("image") == F.col("__of")) & (F.col("reviewer") == F.col("__by")), "left")
    other = F.coalesce((F.col("__low") != F.col("reviewer")) | (F.col("__high") != F.col("reviewer")), F.lit(False))
    return out.withColumn("blocked", other & F.col("__own").isNull()).drop("__image", "__low", "__high", "__of", "__by", "__own")


def broken_updates(before: DataFrame, after: DataFrame, key: list[str], fixed: list[str], version: str, at: str) -> DataFrame:
    """Rows that changed what is fixed, vanished, or whose version or time did not move forward by the rules."""
    a = after.select(*key, *[F.col(c).alias(f"__{c}") for c in (*fixed, version, at)], F.lit(True).alias("__there"))
    both = before.join(a, key, "left")
    moved = F.lit(False)
    for c in fixed:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = (F.col(version) != F.col(f"__{version}")) | (F.col(at) != F.col(f"__{at}"))
    wrong = changed & ~((F.col(f"__{version}") == F.col(version) + 1) & (F.col(f"__{at}") > F.col(at)))
    return both.filter(F.col("__there").isNull() | moved | wrong).select(*key)
