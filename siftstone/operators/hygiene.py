"""Rows fit for others' eyes: allow-lists, sizes, names, and checks that abort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .evidence import ladder

#: The longest edge of an image by the suffix of its address.
EDGES = {"s": 75, "q": 150, "t": 100, "m": 240, "n": 320, "w": 400, "z": 640, "c": 800, "b": 1024, "h": 1600, "k": 2048}


def broken_geotags(df: DataFrame, lat: str, lon: str, accuracy: str) -> DataFrame:
    """Rows whose point or accuracy (1 to 16) is out of range, where they have one."""

    def bad(c: str, low: float, high: float) -> Column:
        return F.col(c).isNotNull() & (F.isnan(F.col(c).cast("double")) | ~F.col(c).between(low, high))

    return df.filter(bad(lat, -90, 90) | bad(lon, -180, 180) | bad(accuracy, 1, 16))


def allowed_host(url: Column, hosts: Sequence[str]) -> Column:
    """Whether a URL is https on its usual port, without a user, and its host one of ``hosts`` or below one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    authority = F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    named = F.lit(False)
    for h in hosts:
        named = named | (host == h) | host.endswith("." + h)
    plain = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & port.isin("", "443") & ~authority.contains("@")
    return F.coalesce(plain & named, F.lit(False))


def preview_edge(url: Column, host: str = "staticflickr.com", edges: Mapping[str, int] = EDGES) -> Column:
    """The longest edge of a preview by its address: infinite for an unknown size, null for another host."""
    found = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"_([a-z])\.[A-Za-z]+$", 1)
    size = F.lit(float("inf"))
    for suffix, edge in edges.items():
        size = F.when(found == suffix, float(edge)).otherwise(size)
    at = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when((at == host) | at.endswith("." + host), size)


def without_placeholders(df: DataFrame, placeholders: Sequence[str], prefix: str, prefixed: Sequence[str]) -> DataFrame:
    """``df`` without columns that never held anything, and with a prefix on those named ``prefixed``."""
    return df.drop(*placeholders).withColumnsRenamed({c: prefix + c for c in prefixed if c in df.columns})


def with_new_columns(df: DataFrame, other: DataFrame, key: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """``df`` with those columns of ``other`` that it has neither by name nor as a known alias."""
    new = [c for c in other.columns if c not in df.columns and aliases.get(c) not in df.columns]
    return df.join(other.select(*key, *[c for c in new if c not in key]), list(key), "left")


def positive_cohort(counts: Column, name: Column, prefix: str = "target:") -> Column:
    """Whether a JSON object of counts has more than none for ``prefix`` and the name."""
    return F.coalesce(F.element_at(F.from_json(counts, "map<string,int>"), F.concat(F.lit(prefix), name)) > 0, F.lit(False))


def explorer_filter(df: DataFrame, text: Sequence[str], needle: str = "", mode: str = "all", box: tuple[float, float, float, float] | None = None, least_isolation_km: float = 50.0, **equal: str) -> DataFrame:
    """Rows of the geotag explorer: columns that equal a value, a part of any text column in any case, a box (west, south, east, north), and a mode.

    Modes: all, isolated, ambiguous (a spread of 250 km and more), coarse, flagged, unplaced.
    """
    modes = {
        "all": F.lit(True),
        "isolated": F.col("isolation_km") >= least_isolation_km,
        "ambiguous": F.col("spread_km") >= 250,
        "coarse": F.col("level") != "settlement",
        "flagged": F.size("flags") > 0,
        "unplaced": F.col("latitude").isNull(),
    }
    out = df.filter(modes[mode])
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    if needle:
        out = out.filter(F.contains(F.lower(F.concat_ws("\n", *text)), F.lit(needle.lower())))
    if box:
        west, south, east, north = box
        out = out.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    return out


def explorer_order(df: DataFrame, mode: str, key: str) -> DataFrame:
    """Rows of the explorer: the most isolated or the widest spread first, unknown ones last, then by key."""
    by = {"isolated": ["isolation_km"], "ambiguous": ["spread_km"]}.get(mode, [])
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in by], key)


def location_group(priority: Column, status: Column) -> Column:
    """The sheet of an image: with a hint, with a profile only, with none, or other; an unknown status aborts."""
    from .clues import STATUSES

    known = F.coalesce(status.isin(*STATUSES, "none"), F.lit(False))
    found = ladder(("priority", F.coalesce(priority, F.lit(False))), ("profile_only", status == "profile_only"), ("none", status == "none"), otherwise="other")
    return F.when(known, found).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))))


def marker_groups(df: DataFrame, lat: str, lon: str, key: str) -> DataFrame:
    """Markers of a map: points that agree to five places, with their number, a size and their keys' least."""
    at = [F.bround(F.col(c), 5).alias(c) for c in (lat, lon)]
    out = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*at).agg(F.count(F.lit(1)).alias("points"), F.min(key).alias("first"))
    return out.withColumn("size", geo.marker_size(F.col("points")))


def placed_counts(df: DataFrame, lat: str, by: str) -> DataFrame:
    """(``by``, ``rows``, ``mapped``, ``unplaced``): how many rows have a place."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count(lat).alias("mapped"), F.count_if(F.col(lat).isNull()).alias("unplaced"))
