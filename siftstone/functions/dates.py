"""Dates and times on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(day: str, zone: str) -> tuple[Column, Column]:
    """Start and end (exclusive) of a civil day in a time zone, in UTC."""
    start = F.to_timestamp(F.lit(day))
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + F.expr("INTERVAL 1 DAY"), zone)


def in_local_day(at: Column, day: str, zone: str) -> Column:
    low, high = local_day(day, zone)
    return (at >= low) & (at < high)


def capture_time(text: Column, unknown: Column, granularity: Column) -> Column:
    """A naive capture time: exact, without an offset, not midnight; else null."""
    naive = ~text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    at = F.try_to_timestamp(text).cast("timestamp_ntz")
    exact = ~F.coalesce(unknown, F.lit(True)) & (granularity == 0) & naive
    return F.when(exact & (F.date_format(at, "HH:mm:ss.SSSSSS") != "00:00:00.000000"), at)


def photo_date(captured: Column, granularity: Column, unknown: Column, uploaded: Column, today: Column) -> Column:
    """A struct of day, its text as exact as it is known, and the source; null outside 1800..today."""
    taken = F.try_to_timestamp(captured).cast("date")
    usable = taken.isNotNull() & ~F.coalesce(unknown, F.lit(False)) & granularity.isin(0, 4, 6) & (F.year(taken) >= 1800) & (taken <= today)
    month, year = F.trunc(taken, "month"), F.trunc(taken, "year")
    exact = F.when(granularity == 6, F.struct(year.alias("day"), F.date_format(year, "yyyy").alias("text"))).when(
        granularity == 4, F.struct(month.alias("day"), F.date_format(month, "yyyy-MM").alias("text"))
    ).otherwise(F.struct(taken.alias("day"), F.date_format(taken, "yyyy-MM-dd").alias("text")))
    up = F.try_to_timestamp(uploaded).cast("date")
    late = up.isNotNull() & (F.year(up) >= 1800) & (up <= today)
    return F.when(usable, F.struct(exact["day"].alias("day"), exact["text"].alias("text"), F.lit("captured").alias("source"))).when(
        late, F.struct(up.alias("day"), F.date_format(up, "yyyy-MM-dd").alias("text"), F.lit("uploaded").alias("source"))
    )


def epoch_utc(text: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC; null for anything else."""
    return F.date_format(F.timestamp_seconds(text.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def later(now: Column, before: Column) -> Column:
    """A correction's time: now, but strictly after the one before."""
    return F.greatest(now, before + F.expr("INTERVAL '0.000001' SECOND"))


def in_years(day: Column, first: int, last: int) -> Column:
    """Whether a day lies in a range of years; days that aren't known always do."""
    return day.isNull() | F.year(day).between(first, last)


def series_key(export_date: Column, key: Column) -> Column:
    """What makes photos of a cell one series: the same full date; a partial date joins nothing."""
    return F.when(F.char_length(export_date) == 10, export_date).otherwise(F.concat(F.lit("#"), key.cast("string")))


def instant(text: Column) -> Column:
    """A time with or without an offset (then UTC) as an instant; null for other text."""
    return F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
