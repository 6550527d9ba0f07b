"""Geography on columns: distances, an equal-area grid, colours and radii."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: WGS 84.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Standard parallel of the equal-area cylinder, in degrees.
PARALLEL = 30.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def arc_km(chord: Column) -> Column:
    """The distance on the sphere of two points whose straight distance on the unit sphere is ``chord``."""
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), chord / 2))


def valid_point(lat: Column, lon: Column, most_lat: float = 90.0) -> Column:
    """Finite, in range, and not the origin; false for nulls."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= most_lat) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def _q(s: Column) -> Column:
    e = ECCENTRICITY
    return F.lit(1 - e * e) * (s / (F.lit(1.0) - F.lit(e * e) * s * s) - F.lit(1 / (2 * e)) * F.log((F.lit(1.0) - F.lit(e) * s) / (F.lit(1.0) + F.lit(e) * s)))


def _scale() -> float:
    s, e = math.sin(math.radians(PARALLEL)), ECCENTRICITY
    return math.cos(math.radians(PARALLEL)) / math.sqrt(1 - e * e * s * s)


def equal_area(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north on the ellipsoidal cylindrical equal-area map."""
    k = _scale()
    return F.lit(SEMI_MAJOR * k) * F.radians(lon), F.lit(SEMI_MAJOR / (2 * k)) * _q(F.sin(F.radians(lat)))


def from_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a map point; the inverse of :func:`equal_area` by series."""
    k, e2 = _scale(), ECCENTRICITY**2
    s = math.sin(math.pi / 2)
    qp = (1 - e2) * (s / (1 - e2) - 1 / (2 * ECCENTRICITY) * math.log((1 - ECCENTRICITY) / (1 + ECCENTRICITY)))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * F.lit(2 * k / (SEMI_MAJOR * qp)))))
    e4, e6 = e2**2, e2**3
    lat = beta + F.lit(e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + F.lit(761 * e6 / 45360) * F.sin(6 * beta)
    return F.degrees(lat), F.degrees(x / F.lit(SEMI_MAJOR * k))


def cell(lat: Column, lon: Column, metres: float = 10_000.0) -> tuple[Column, Column]:
    """Column and row of the grid cell that holds a point."""
    x, y = equal_area(lat, lon)
    return F.floor(x / metres).cast("long"), F.floor(y / metres).cast("long")


def cell_centre(column: Column, row: Column, metres: float = 10_000.0) -> tuple[Column, Column]:
    return from_equal_area((column + 0.5) * metres, (row + 0.5) * metres)


def radius(series: Column) -> Column:
    """Of a cell's mark, by the number of its series."""
    return F.least(F.lit(38.0), 6 * F.sqrt(series.cast("double")))


def marker_size(points: Column) -> Column:
    """A marker's size: five and the binary logarithm of its points, 13 at most."""
    return F.least(F.lit(13.0), 5 + F.log2(points.cast("double")))


def ramp_fraction(day: Column, first: str, last: str) -> Column:
    """Where a day lies between two days, clamped to 0..1; null stays null."""
    share = F.datediff(day, F.to_date(F.lit(first))) / F.datediff(F.to_date(F.lit(last)), F.to_date(F.lit(first)))
    return F.when(day.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def ramp_colour(fraction: Column, low: tuple[int, int, int], high: tuple[int, int, int], unknown: str = "#888888") -> Column:
    """A hex colour between two colours, channels rounded half to even."""
    parts = [F.lower(F.lpad(F.hex(F.bround(F.lit(float(a)) + F.lit(float(b - a)) * fraction).cast("long")), 2, "0")) for a, b in zip(low, high, strict=True)]
    return F.when(fraction.isNull(), unknown).otherwise(F.concat(F.lit("#"), *parts))
