"""Joins with places: boxes and polygons, nearest reference points, map cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .gazetteer import phrase_counts, phrase_hits, phrase_words
from .staging import staged


def in_boxes(points: DataFrame, boxes: Sequence[tuple[str, float, float, float, float]], x: str, y: str, name: str = "region") -> DataFrame:
    """``points`` with the name of the first of ``boxes`` (name, low x, high x, low y, high y) that holds them, both ends included.

    ``name`` is null without one.  Boxes are a short list of regions, which becomes one
    expression: nothing is joined, and equal points stay rows of their own.
    """
    held = [F.when(F.col(x).between(x0, x1) & F.col(y).between(y0, y1), n) for n, x0, x1, y0, y1 in boxes]
    return points.withColumn(name, F.coalesce(*held) if held else F.lit(None).cast("string"))


def in_rings(px: np.ndarray, py: np.ndarray, rings: Sequence[np.ndarray]) -> np.ndarray:
    """Whether points are inside by the even-odd rule, so that inner rings are holes."""
    inside = np.zeros(len(px), bool)
    for ring in rings:
        x, y = ring[:, 0], ring[:, 1]
        for k in range(len(ring)):
            x1, y1, x2, y2 = x[k - 1], y[k - 1], x[k], y[k]
            if y1 == y2:
                continue
            cross = (y1 > py) != (y2 > py)
            inside ^= cross & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return inside


def _wrapped(degrees: np.ndarray) -> np.ndarray:
    return (degrees + 180) % 360 - 180


def edge_km(lat: np.ndarray, lon: np.ndarray, rings: Sequence[np.ndarray], chunk: int = 1 << 20) -> np.ndarray:
    """Distance of each point to the nearest edge, on a plane scaled at the point.

    Of an edge the first end is wrapped to the point and the second to the first, so an edge
    stays as short as it is wherever it lies.
    """
    best = np.full(len(lat), np.inf)
    km = np.pi * geo.EARTH_KM / 180
    for ring in rings:
        step = max(1, chunk // len(ring))
        first, along = np.roll(ring, 1, 0), _wrapped(ring[:, 0] - np.roll(ring[:, 0], 1))
        for k in range(0, len(lat), step):
            y, x = lat[k : k + step, None], lon[k : k + step, None]
            scale = np.maximum(0.01, np.cos(np.radians(y))) * km
            ax, ay = _wrapped(first[None, :, 0] - x) * scale, (first[None, :, 1] - y) * km
            dx, dy = along[None, :] * scale, (ring[None, :, 1] - first[None, :, 1]) * km
            t = np.clip(-(ax * dx + ay * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
            best[k : k + step] = np.minimum(best[k : k + step], np.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2).min(1))
    return best


def box_km(lat: np.ndarray, lon: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A distance that no edge inside a box (west, south, east, north) falls below."""
    west, south, east, north = box
    apart = np.min([np.maximum(np.maximum(west - x, x - east), 0) for x in (lon - 360, lon, lon + 360)], axis=0)
    scale = np.maximum(0.01, np.cos(np.radians(lat)))
    return np.hypot(apart * scale, np.maximum(np.maximum(south - lat, lat - north), 0)) * (np.pi * geo.EARTH_KM / 180)


def region_of(points: DataFrame, lat: str, lon: str, regions: Sequence[tuple[str, Sequence[Sequence[Sequence[float]]]]], reach_km: float = 200.0, name: str = "region", other: str = "Other") -> DataFrame:
    """``points`` with the first region whose rings hold them, else the nearest within ``reach_km``, else ``other``.

    ``regions`` are (name, rings of [lon, lat]), a list that a driver holds; Spark sends them
    to each executor once.  Points without coordinates get null.  Only regions whose box is
    near enough are measured.
    """
    shapes = [(n, [np.asarray(r, float) for r in rings]) for n, rings in regions]
    boxes = [(min(r[:, 0].min() for r in rings), min(r[:, 1].min() for r in rings), max(r[:, 0].max() for r in rings), max(r[:, 1].max() for r in rings)) for _, rings in shapes]
    sent = points.sparkSession.sparkContext.broadcast((shapes, boxes))

    @F.pandas_udf("string")
    def find(lats: pd.Series, lons: pd.Series) -> pd.Series:
        shapes, boxes = sent.value
        y, x = lats.to_numpy(float), lons.to_numpy(float)
        out = np.full(len(x), None, object)
        todo = ~(np.isnan(x) | np.isnan(y))
        for (n, rings), (x0, y0, x1, y1) in zip(shapes, boxes, strict=True):
            near = np.flatnonzero(todo & (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
            hit = near[in_rings(x[near], y[near], rings)] if len(near) else near
            out[hit] = n
            todo[hit] = False
        left = np.flatnonzero(todo)
        best = np.full(len(left), reach_km)
        out[left] = other
        for (n, rings), box in zip(shapes, boxes, strict=True):
            near = np.flatnonzero(box_km(y[left], x[left], box) <= best)
            if len(near):
                km = edge_km(y[left[near]], x[left[near]], rings)
                closer = (km < best[near]) | (km == best[near]) & (out[left[near]] == other)
                out[left[near[closer]]], best[near[closer]] = n, km[closer]
        return pd.Series(out)

    return points.withColumn(name, find(F.col(lat).cast("double"), F.col(lon).cast("double")))


#: Grids of cubes around the unit sphere, each half as wide as the one before: from 2, which holds an octant, to some 12 metres.
LEVELS = 21
#: Bits of one coordinate of a cube in its number.
BITS = 21


def _cube(lat: Column, lon: Column, level: Column, turn: Sequence[int] = (0, 0, 0)) -> Column:
    """The number of the cube of a grid that holds a point, or of the one ``turn`` cubes away."""
    out = F.lit(0).cast("long")
    for at, step in zip(geo.unit_sphere(lat, lon), turn, strict=True):
        out = F.shiftleft(out, BITS).bitwiseOR(F.floor(at * F.pow(F.lit(2.0), level - 1)).cast("long") + (step + (1 << (BITS - 1))))
    return out


def kth_nearest_km(points: DataFrame, key: str, lat: str, lon: str, k: int = 5, levels: int = LEVELS, name: str = "isolation_km") -> DataFrame:
    """``points`` with the distance to the ``k``-th nearest other distinct point.

    Points lie in grids of cubes around the sphere, which have neither poles nor a seam.  Each
    looks at the 27 cubes around it in the finest grid whose cube holds it and ``k`` others.
    These are within the cube's diagonal, so the next coarser grid, in which nothing nearer
    than two such cubes is missed, settles what the first did not.  As the next finer cubes
    hold ``k`` points at most, few points look at a cube, however many it holds: pairs grow
    with the points and the levels.  Only more than ``k`` points in one cube of the finest
    grid all meet each other.  Null where there are fewer than ``k`` other points, or without
    coordinates.  ``key`` tells points apart; repeated keys share a distance.
    """
    here = points.select(F.col(key).alias("__k"), F.col(lat).cast("double").alias("a_lat"), F.col(lon).cast("double").alias("a_lon"))
    here = here.filter(geo.valid_point(F.col("a_lat"), F.col("a_lon")) | ((F.col("a_lat") == 0) & (F.col("a_lon") == 0)))
    a_lat, a_lon, b_lat, b_lon = F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # these tables are small for the pairs that come of them
    distinct = staged(here.select("a_lat", "a_lon").distinct().repartition(parts, "a_lat", "a_lon"))
    of = distinct.select(a_lat.alias("b_lat"), a_lon.alias("b_lon"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("at"))
    of = of.withColumn("cube", _cube(b_lat, b_lon, F.col("at")))
    full = of.groupBy("at", "cube").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).drop("n")
    finest = of.join(full.hint("merge"), ["at", "cube"]).groupBy(b_lat.alias("a_lat"), b_lon.alias("a_lon")).agg(F.max("at").alias("level"))
    todo = distinct.join(finest, ["a_lat", "a_lon"], "left").select("a_lat", "a_lon", F.coalesce("level", F.lit(0)).alias("level"))
    nearest = Window.partitionBy("a_lat", "a_lon").orderBy("km")

    def looked(todo: DataFrame, back: int) -> DataFrame:
        """``todo`` with the distance, null if something nearer may be outside the cubes."""
        around = F.array(*[_cube(a_lat, a_lon, F.col("at"), turn) for turn in product((-1, 0, 1), repeat=3)])
        asked = todo.withColumn("at", F.greatest(F.col("level") - back, F.lit(0))).withColumn("cube", F.explode(around)).repartition(parts, "at", "cube")
        pairs = asked.join(of.hint("merge"), ["at", "cube"]).filter((a_lat != b_lat) | (a_lon != b_lon))
        met = pairs.select("a_lat", "a_lon", "level", "at", geo.haversine_km(a_lat, a_lon, b_lat, b_lon).alias("km")).withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") == k)
        reach = geo.arc_km(F.pow(F.lit(2.0), 1 - F.col("at"))) * 0.999999
        met = met.select("a_lat", "a_lon", F.when((F.col("at") == 0) | (F.col("km") <= reach), F.col("km")).alias("km"))
        return todo.join(met, ["a_lat", "a_lon"], "left").select("a_lat", "a_lon", "level", "km")

    first = staged(looked(todo, 0))
    rest = looked(first.filter(F.col("km").isNull() & (F.col("level") > 0)).drop("km"), 1)
    known = first.unionByName(rest).filter(F.col("km").isNotNull()).select("a_lat", "a_lon", "km")
    done = here.join(known, ["a_lat", "a_lon"]).groupBy("__k").agg(F.min("km").alias(name))
    return points.join(done, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")


def map_cells(points: DataFrame, cell: Sequence[str], series: str, at: str, key: str, photos: int | None = None) -> DataFrame:
    """Cells with ``points``, distinct ``series``, the mark's ``radius`` and the newest point.

    ``at`` may be null, which is older than anything.
    """
    newest = F.max_by(F.col(key), F.struct(at, key))
    out = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("points"), F.countDistinct(series).alias("series"), newest.alias("newest"))
    out = out.withColumn("radius", geo.radius(F.col("series")))
    if photos is None:
        return out
    order = Window.partitionBy(*cell).orderBy(F.desc_nulls_last(at), F.desc(key))
    first = points.select(*cell, F.col(key).alias("k"), F.row_number().over(order).alias("n")).filter(F.col("n") <= photos)
    listed = first.groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "k"))), lambda p: p["k"]).alias("newest_first"))
    return out.join(listed, list(cell))


def _phrases(aliases: DataFrame, alias: str, place: str, longest: int, shortest: int) -> DataFrame:
    names = aliases.select(phrase_words(F.col(alias)).alias("w"), F.col(place).alias("p")).filter(F.size("w").between(1, longest))
    names = names.select(F.array_join("w", " ").alias("phrase"), "p").filter(F.char_length("phrase") >= shortest)
    return names.groupBy("phrase").agg(F.sort_array(F.collect_set("p")).alias("places"))


def match_phrases(units: DataFrame, unit: str, text: Column, aliases: DataFrame, alias: str, place: str, longest: int = 12, shortest: int = 1) -> DataFrame:
    """Occurrences of aliases (token sequences) in texts: leftmost, then longest, without overlaps.

    Returns (unit, ``start`` and ``stop`` in characters, ``length`` in tokens, ``places``: all
    places of the alias).  Tokens are folded (NFKC, case) and an ideograph is one of its own.
    Aliases of more than ``longest`` tokens or fewer than ``shortest`` characters are none.
    Takes time in proportion to the texts: see :mod:`gazetteer`.
    """
    known = _phrases(aliases, alias, place, longest, shortest)
    return phrase_hits(units, [unit], text, known, longest).select(unit, "start", "stop", F.col("n").alias("length"), "places")


def count_phrases(units: DataFrame, unit: str, text: Column, aliases: DataFrame, alias: str, place: str, longest: int = 12, shortest: int = 1) -> DataFrame:
    """(unit, ``length``, ``places``, ``hits``): how many of the occurrences of :func:`match_phrases` a text has by their length and number of places."""
    known = _phrases(aliases, alias, place, longest, shortest).withColumn("places", F.size("places"))
    return phrase_counts(units, [unit], text, known, longest).select(unit, F.col("n").alias("length"), "places", "hits")
