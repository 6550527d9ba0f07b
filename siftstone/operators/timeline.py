"""Rows of one owner that are near in time: interval joins and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
#: A slice of time is so many times as long as the reach of the nearest neighbours; twice at least.
REACHES = 8


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds, with fractions, from one naive time to another."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def interval_join(targets: DataFrame, anchors: DataFrame, owner: str, at: str, key: str, reach: int = DAY) -> DataFrame:
    """Pairs of a target and an anchor of the same owner at most ``reach`` seconds apart, both ends included.

    Anchors get the prefix ``anchor_``.  Both sides are keyed by owner and by a slice of time
    as long as the reach, with targets looking into three slices; so an owner with very many
    rows is spread over tasks, and only rows of neighbouring slices meet.  A row doesn't
    match itself (equal ``key``).
    """
    slice_ = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / reach)
    a = anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns], slice_.alias("__slice"))
    t = targets.withColumn("__near", F.explode(F.array(slice_ - 1, slice_, slice_ + 1)))
    delta = seconds_between(F.col(at), F.col(f"anchor_{at}"))
    met = t.join(a, (F.col(owner) == F.col(f"anchor_{owner}")) & (F.col("__near") == F.col("__slice")) & (F.col(key) != F.col(f"anchor_{key}")))
    return met.withColumn("delta_seconds", delta).filter(F.abs("delta_seconds") <= reach).drop("__near", "__slice")


def relation(delta: Column) -> Column:
    """Where the anchor lies: before, after or at the target's time."""
    return F.when(delta > 0, "before").when(delta < 0, "after").otherwise("same_time")


def nearest(pairs: DataFrame, key: str, windows: Sequence[tuple[str, int]] = (("hour", HOUR), ("day", DAY))) -> DataFrame:
    """For each target, window and relation the nearest anchor (then the least key) and how many there are.

    An anchor counts in the first of ``windows`` that holds it, ends included, and in no other.
    """
    window = F.lit(None).cast("string")
    for name, reach in reversed(windows):
        window = F.when(F.abs("delta_seconds") <= reach, name).otherwise(window)
    wide = pairs.withColumn("window", window).filter("window IS NOT NULL").withColumn("relation", relation(F.col("delta_seconds")))
    order = F.struct(F.abs("delta_seconds"), F.col(f"anchor_{key}"))
    best = wide.groupBy(key, "window", "relation").agg(
        F.min_by(F.struct(F.col(f"anchor_{key}").alias("anchor"), F.col("delta_seconds").alias("delta")), order).alias("b"), F.count(F.lit(1)).alias("anchors")
    )
    return best.select(key, "window", "relation", F.col("b.anchor").alias("anchor_id"), (F.col("b.delta") / 60).alias("minutes"), "anchors")


def nearest_anchors(targets: DataFrame, anchors: DataFrame, owner: str, at: str, key: str, windows: Sequence[tuple[str, int]] = (("hour", HOUR), ("day", DAY))) -> DataFrame:
    """What :func:`nearest` tells of the pairs of :func:`interval_join`, without making them.

    Both sides have one row for each ``key``; ``windows`` go from the shortest to the longest.
    Anchors of one time are one row, which stands in each slice of time that it can reach;
    sorted with the targets of a slice, running sums and last rows tell each target its
    numbers and its nearest.  So the work grows with the rows, however many are near each other.
    """
    second = 1_000_000
    longest = windows[-1][1]
    when = F.col(at).cast("timestamp")
    slice_ = lambda ahead=0: F.floor((F.unix_seconds(when) + ahead) / (longest * REACHES))
    reached = F.array_distinct(F.array(slice_(-longest - 1), slice_(longest + 1)))
    known = anchors.filter(F.col(owner).isNotNull() & F.col(at).isNotNull() & F.col(key).isNotNull()).select(F.col(owner).alias("__o"), F.col(key).alias("__a"), F.unix_micros(when).alias("__t"), reached.alias("__s"))
    # the least two keys of a time: a row is no anchor of its own
    alike = Window.partitionBy("__o", "__t")
    least = known.withColumns({"__i": F.row_number().over(alike.orderBy("__a")), "__n": F.count(F.lit(1)).over(alike)}).filter("__i <= 2")
    times = least.groupBy("__o", "__t").agg(F.max("__n").alias("n"), F.min("__s").alias("__s"), F.min("__a").alias("k1"), F.max(F.when(F.col("__i") == 2, F.col("__a"))).alias("k2"))
    a = times.select("__o", "__t", F.explode("__s").alias("__s"), F.struct(F.col("__t").alias("t"), "n", "k1", "k2").alias("__g"))
    own = known.select(F.col("__o").alias("__p"), F.col("__a").alias("__b"), F.col("__t").alias("__own"))
    t = targets.filter(F.col(owner).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(owner).alias("__o"), F.unix_micros(when).alias("__t"), slice_().alias("__s"))
    t = t.join(own, (F.col("__o") == F.col("__p")) & (F.col(key) == F.col("__b")), "left").drop("__p", "__b")
    rows = a.unionByName(t.withColumn("__asked", F.lit(True)), allowMissingColumns=True)

    here, now = F.col("__t"), Window.partitionBy("__o", "__s")
    upto = lambda order, end: order.rangeBetween(Window.unboundedPreceding, end)
    for name, sign in (("before", 1), ("after", -1)):
        order = now.orderBy(here * sign)
        rows = rows.withColumn("__with", F.when(F.col("__g").isNotNull(), F.struct("__g", F.last("__g", True).over(upto(order, -1)).alias("next"))))
        ends = sorted({0} | {-r * second - 1 for r in (0, *[r for _, r in windows])}, reverse=True)
        seen = {}
        for e in ends:
            seen |= {f"__{name}_{-e}_last": F.last("__with", True).over(upto(order, e)), f"__{name}_{-e}_n": F.coalesce(F.sum("__g.n").over(upto(order, e)), F.lit(0))}
        rows = rows.withColumns(seen).drop("__with")

    entries = []

    def entry(window: str, name: str, near: Column, count: Column, mine: Column, inside) -> Column:
        g, more = near["__g"], near["next"]
        spot = lambda k, at_: F.struct(k.alias("k"), at_.alias("t"))
        best = F.when(~g["k1"].eqNullSafe(F.col(key)), spot(g["k1"], g["t"])).when(g["k2"].isNotNull(), spot(g["k2"], g["t"])).when(more.isNotNull(), spot(more["k1"], more["t"]))
        best = F.when(near.isNotNull() & inside(best["t"]), best)
        minutes = (here - best["t"]) / F.lit(1_000_000.0) / 60
        return F.struct(F.lit(window).alias("window"), F.lit(name).alias("relation"), best["k"].alias("anchor_id"), minutes.alias("minutes"), (count - F.when(mine, 1).otherwise(0)).alias("anchors"))

    of = lambda name, e, what: F.col(f"__{name}_{e}_{what}")
    shorter = 0
    for window, reach in windows:
        for name, sign in (("before", 1), ("after", -1)):
            low, high = shorter * second, reach * second
            inside = lambda x, sign=sign, low=low, high=high: ((here - x) * sign > low) & ((here - x) * sign <= high)
            count = of(name, low + 1, "n") - of(name, high + 1, "n")
            entries.append(entry(window, name, of(name, low + 1, "last"), count, F.coalesce(inside(F.col("__own")), F.lit(False)), inside))
        shorter = reach
    same = lambda x: x == here
    entries.append(entry(windows[0][0], "same_time", of("before", 0, "last"), of("before", 0, "n") - of("before", 1, "n"), F.coalesce(same(F.col("__own")), F.lit(False)), same))
    found = rows.filter("__asked").select(key, F.explode(F.filter(F.array(*entries), lambda e: e["anchor_id"].isNotNull())).alias("e"))
    return found.select(key, "e.*")


def closest(pairs: DataFrame, key: str) -> DataFrame:
    """For each target the nearest anchor of all, then the least key."""
    order = F.struct(F.abs("delta_seconds"), F.col(f"anchor_{key}"))
    return pairs.groupBy(key).agg(F.min_by(F.struct(F.col(f"anchor_{key}").alias("anchor_id"), "delta_seconds"), order).alias("b")).select(key, "b.anchor_id", "b.delta_seconds")


def first_source(frames: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Of several sources, one row for each key: from the first source that has it, then by ``order``."""
    parts = [f.withColumn("source_rank", F.lit(k)) for k, f in enumerate(frames)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    rest = [c for c in all_.columns if c != key]
    return all_.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("source_rank", *order)).alias("r")).select(key, "r.*")
