"""Streams with state of their own: a queue of work that is retried, and a rolling budget of calls.

Both keep their state in map and list states of a key and let go of it by event-time timers,
so it grows with what is under way, not with what has ever been seen.  They need the RocksDB
state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Outcomes that settle a job, and failed passes after which it has failed for good.
TERMINAL = ("ok", "photo_unavailable", "no_public_location")
MOST_PASSES = 3
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store to the one that timers and map states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Queue(StatefulProcessor):
    """Jobs of one photo: failed passes and last attempt by endpoint, until settled or idle for too long."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "endpoint string", "passes int, settled boolean, last bigint")

    def _timers(self, until: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tries = pd.concat(list(rows)).sort_values(["at", "outcome"], kind="stable")
        out, latest = [], 0
        for r in tries.itertuples():
            at = int(r.at.value // 1_000_000)
            latest = max(latest, at)
            known = self.jobs.getValue((r.endpoint,)) if self.jobs.containsKey((r.endpoint,)) else None
            passes, settled = (int(known[0]), bool(known[1])) if known else (0, False)
            if settled:
                continue  # an attempt at what is settled changes nothing
            if r.outcome in TERMINAL:
                state, settled = "complete", True
            else:
                passes += 1
                settled = passes >= MOST_PASSES
                state = "failed" if settled else "pending"
            self.jobs.updateValue((r.endpoint,), (passes, settled, at))
            out.append((key[0], r.endpoint, r.at, state, passes))
        self._timers(max([latest, *[int(v[2]) for v in self.jobs.values()]]) + self.idle_ms)
        yield pd.DataFrame(out, columns=["photo", "endpoint", "at", "state", "passes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        out = [(key[0], k[0], at, "abandoned", int(v[0])) for k, v in self.jobs.iterator() if not v[1]]
        self.jobs.clear()
        yield pd.DataFrame(sorted(out), columns=["photo", "endpoint", "at", "state", "passes"])

    def close(self) -> None:
        pass


def retried(attempts: DataFrame, idle: timedelta = timedelta(days=7), late: str = "1 hour") -> DataFrame:
    """The changes of state of a stream of attempts (``photo``, ``endpoint``, ``at``, ``outcome``).

    (``photo``, ``endpoint``, ``at``, ``state``, ``passes``): complete at the first outcome
    that settles a job, failed at the third failed pass, else pending; further attempts at
    what is settled change nothing.  Photos that nobody tried for ``idle`` are let go, their
    pending jobs as abandoned.  Rows later than ``late`` are dropped.  A query that starts
    again from its checkpoint goes on where it was.
    """
    idle_ms = int(idle.total_seconds() * 1000)
    rows = attempts.select(F.col("photo").cast("string"), F.col("endpoint").cast("string"), F.col("at").cast("timestamp"), F.coalesce("outcome", F.lit("none")).alias("outcome"))
    keyed = rows.withWatermark("at", late).groupBy("photo")
    return keyed.transformWithStateInPandas(
        statefulProcessor=_Queue(idle_ms), outputStructType="photo string, endpoint string, at timestamp, state string, passes int", outputMode="Append", timeMode="EventTime"
    )


class _Budget(StatefulProcessor):
    """Calls of one ledger: those whose turn hasn't come, and the times of the last window."""

    def __init__(self, window_us: int, budget: int):
        self.window_us, self.budget = window_us, budget

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "calls int")
        self.past = handle.getMapState("past", "at bigint", "calls int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, n in part["micros"].value_counts().items():
                held = self.waiting.getValue((int(at),))[0] if self.waiting.containsKey((int(at),)) else 0
                self.waiting.updateValue((int(at),), (int(held) + int(n),))
                self.handle.registerTimer(int(at) // 1000 + 1)
        return iter(())  # nothing is final before its timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((int(k[0]), int(v[0])) for k, v in self.waiting.iterator() if int(k[0]) < until)
        past = sorted((int(k[0]), int(v[0])) for k, v in self.past.iterator())
        out = []
        for at, n in due:
            self.waiting.removeKey((at,))
            gone = [p for p in past if p[0] <= at - self.window_us]
            for p in gone:
                self.past.removeKey((p[0],))
            past = past[len(gone) :] + [(at, n)]
            self.past.updateValue((at,), (n,))
            used = sum(c for _, c in past)
            out.append((key[0], pd.Timestamp(at, unit="us"), n, used, used > self.budget))
        yield pd.DataFrame(out, columns=["ledger", "at", "calls", "in_window", "over_budget"])

    def close(self) -> None:
        pass


def budgeted(calls: DataFrame, at: str, key: str, seconds: int = 3600, budget: int = 3500, late: str = "10 minutes") -> DataFrame:
    """(``ledger``, ``at``, ``calls``, ``in_window``, ``over_budget``): each moment with calls, once the watermark has passed it.

    ``in_window`` counts the calls of the last ``seconds`` up to and with that moment, as the
    batch form does; so calls that come late, but not later than ``late``, count where they
    belong, and others are dropped.  A ledger keeps the times of one window.
    """
    rows = calls.select(F.col(key).cast("string").alias("ledger"), F.col(at).cast("timestamp").alias("at")).filter("at IS NOT NULL").withWatermark("at", late)
    keyed = rows.withColumn("micros", F.unix_micros("at")).groupBy("ledger")
    return keyed.transformWithStateInPandas(
        statefulProcessor=_Budget(seconds * 1_000_000, budget), outputStructType="ledger string, at timestamp, calls bigint, in_window bigint, over_budget boolean", outputMode="Append", timeMode="EventTime"
    )
