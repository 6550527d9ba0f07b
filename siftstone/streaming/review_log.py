"""Incremental forms: the versioned review log, a rolling call budget, a retry queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versioned import RESULT

STATE = "label string, version int, seen map<string, struct<label: string, version: int>>"
#: Submissions of one item and reviewer that are remembered.
REMEMBERED = 64


def saves(commands: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The stream of results of a stream of save commands; the rules are those of the batch fold.

    The label and version of each item and reviewer stay.  Submissions are remembered as far
    as a replay of them can still be told from a stale command: the last ``remembered`` saved
    ones; an older one that comes again is stale, as its version is, and saves nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        label, version, seen = state.get if state.exists else (None, 0, {})
        seen = dict(seen)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for c in rows.itertuples():
            known = seen.get(c.submission)
            if known:
                result = "replayed" if (known[0], known[1]) == (c.label, int(c.expected) + 1) and version == known[1] else "conflict"
            elif int(c.expected) != version:
                result = "stale"
            else:
                version, label = version + 1, c.label
                seen[c.submission] = (label, version)
                result = "inserted" if version == 1 else "updated"
            out.append((key[0], key[1], int(c.seq), result, label, version))
        last = sorted(seen.items(), key=lambda x: -x[1][1])[:remembered]  # a saved submission's version is its own
        state.update((label, version, dict(last)))
        yield pd.DataFrame(out, columns=["item", "reviewer", "seq", "result", "label", "version"])

    keyed = commands.select(F.col("item").cast("string"), F.col("reviewer").cast("string"), "seq", "submission", "label", "expected")
    return keyed.groupBy("item", "reviewer").applyInPandasWithState(step, RESULT, STATE, "append", "NoTimeout")


def hourly_calls(calls: DataFrame, at: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Calls of each kind in each hour, final once the watermark has passed."""
    return calls.withWatermark(at, late).groupBy(F.window(at, "1 hour"), kind).agg(F.count(F.lit(1)).alias("calls"), F.min(at).alias("first"))


def retry_queue(queue: DataFrame, responses: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """``queue`` with the state of each entry: done, failed after ``most`` passes, or pending."""
    seen = responses.groupBy(*key).agg(F.bool_or(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("misses"))
    state = F.when(F.col("ok"), "done").when(F.col("misses") >= most, "failed").otherwise("pending")
    return queue.join(seen, key, "left").withColumn("state", state).withColumn("passes", F.coalesce("misses", F.lit(0))).drop("ok", "misses")
