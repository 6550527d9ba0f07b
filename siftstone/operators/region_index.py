"""Which of very many polygons a point is in, or near, by an index of cells.

Each polygon is covered by cells of a grid of degrees: cells inside it, cells that its edges
touch, and cells within reach of these.  Points join the cells of their own.  Inside cells
settle containment; in the others the point meets those polygons alone whose edge or reach
the cell has, in groups of some polygons, so each polygon's rings are read once for many
points and no table of polygons is held whole anywhere.  Polygons with equal rings are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .places import edge_km, in_rings
from .staging import staged

#: Degrees of a cell, and parts into which the points that meet one polygon are dealt.
CELL, SALTS = 1.0, 16
#: Polygons, and their corners, that one group measures about, and rows of cells that are sent on at once.
TOGETHER, CORNERS, ROWS = 256, 1 << 18, 1 << 16
INSIDE, EDGE, NEAR = 0, 1, 2
_KM = math.pi * geo.EARTH_KM / 180


def _touched(ring: np.ndarray, cell: float) -> set[tuple[int, int]]:
    """The cells that a ring's edges touch, and maybe a few beside them."""
    out: set[tuple[int, int]] = set()
    for a, b in zip(np.roll(ring, 1, axis=0), ring, strict=True):
        steps = max(1, math.ceil(2 * np.abs(b - a).max() / cell))
        line = a + (b - a) * np.linspace(0, 1, steps + 1)[:, None]
        at = np.floor((line + (180, 90)) / cell).astype(int)
        for (x1, y1), (x2, y2) in zip(at, at[1:], strict=False):
            out.update((y, x) for y in range(min(y1, y2), max(y1, y2) + 1) for x in range(min(x1, x2), max(x1, x2) + 1))
    return out


def covering(rings: list[np.ndarray], reach_km: float, cell: float = CELL) -> list[tuple[int, int, int]]:
    """(row, column, kind) of the cells of one polygon; a cell within reach has a row of that kind besides."""
    edges = set().union(*(_touched(r, cell) for r in rings))
    out = [(r, c, EDGE) for r, c in edges]
    points = np.concatenate(rings)
    (west, south), (east, north) = np.floor((points.min(0) + (180, 90)) / cell).astype(int), np.floor((points.max(0) + (180, 90)) / cell).astype(int)
    rows, columns = (z.ravel() for z in np.meshgrid(np.arange(south, north + 1), np.arange(west, east + 1), indexing="ij"))
    held = in_rings((columns + 0.5) * cell - 180, (rows + 0.5) * cell - 90, rings)
    out += [(int(r), int(c), INSIDE) for r, c in zip(rows[held], columns[held], strict=True) if (r, c) not in edges]
    around, up, near = round(360 / cell), math.ceil(reach_km / _KM / cell), set()
    by_row: dict[int, set[int]] = {}
    for r, c in edges:
        by_row.setdefault(r, set()).add(c)
    for r, own in by_row.items():
        for row in range(max(0, r - up), min(round(180 / cell) - 1, r + up) + 1):
            # a degree is shortest at the end of the row that is nearest to a pole
            far = max(abs(row * cell - 90), abs((row + 1) * cell - 90), abs(r * cell - 90), abs((r + 1) * cell - 90))
            wide = math.ceil(reach_km / (_KM * max(0.01, math.cos(math.radians(min(far, 89.9))))) / cell)
            if 2 * wide + 1 >= around:
                near.update((row, c) for c in range(around))
            else:
                near.update((row, (c + d) % around) for c in own for d in range(-wide, wide + 1))
    return out + [(r, c, NEAR) for r, c in near]


def regions_of(points: DataFrame, lat: str, lon: str, polygons: DataFrame, reach_km: float = 200.0, name: str = "region", other: str = "Other", cell: float = CELL) -> DataFrame:
    """``points`` with the first region (by ``place``) whose rings hold them, else the nearest within ``reach_km``, else ``other``.

    ``polygons``: (``region``, ``place``, ``rings`` of [lon, lat]; inner rings are holes), a row
    for each place.  Points without coordinates get null; without polygons all get ``other``.
    Equal points are looked up once, and so are equal polygons.
    """
    names = polygons.select("place", F.col("region").alias("__region"))
    polygons = staged(polygons.groupBy("rings").agg(F.min("place").alias("place")))  # equal ones are equally far, so the first stands for them
    corners = F.aggregate("rings", F.lit(0).cast("long"), lambda n, ring: n + F.size(ring))
    many, edges = polygons.agg(F.count(F.lit(1)), F.coalesce(F.sum(corners), F.lit(0))).first()
    parts = max(1, -(-many // TOGETHER), -(-edges // CORNERS))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for place, rings in zip(batch["place"].tolist(), batch["rings"], strict=True):
                found += [(*row, place) for row in covering([np.array([list(p) for p in r], float) for r in rings], reach_km, cell)]
                if len(found) >= ROWS:
                    yield pd.DataFrame(found, columns=["r", "c", "kind", "place"])
                    found = []
            yield pd.DataFrame(found, columns=["r", "c", "kind", "place"])

    cells = polygons.select("place", "rings").mapInPandas(cut, "r long, c long, kind int, place long")
    here = points.select(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).dropna().distinct()
    here = here.withColumns({"r": F.least(F.floor((F.col("y") + 90) / cell), F.lit(round(180 / cell) - 1)), "c": F.floor((F.col("x") + 180) / cell)})
    met = here.join(cells, ["r", "c"]).groupBy("y", "x", "place").agg(F.min("kind").alias("kind"), F.bool_or(F.col("kind") == NEAR).alias("near"))
    part = F.pmod(F.xxhash64("place"), F.lit(parts)).alias("part")
    salted = met.filter(F.col("kind") != INSIDE).select("*", part, F.pmod(F.xxhash64("y", "x"), F.lit(SALTS)).cast("int").alias("salt"))
    needed = polygons.select("place", "rings", part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def measure(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(own):
            return pd.DataFrame({"y": [], "x": [], "place": [], "held": pd.Series([], dtype=bool), "km": []})
        shapes = dict(zip(own["place"].tolist(), own["rings"], strict=True))
        pairs = pairs.sort_values("place")
        y, x, place, edge, near = (pairs[c].to_numpy() for c in ("y", "x", "place", "kind", "near"))
        held, km = np.zeros(len(pairs), bool), np.full(len(pairs), np.inf)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]).tolist()
        for begin, end in zip(starts, starts[1:], strict=False):
            of = slice(begin, end)
            rings = [np.array([list(p) for p in r], float) for r in shapes[int(place[begin])]]
            held[of] = (edge[of] == EDGE) & in_rings(x[of], y[of], rings)
            km[of] = np.where(near[of], edge_km(y[of], x[of], rings), np.inf)
        return pd.DataFrame({"y": y, "x": x, "place": place, "held": held, "km": km})

    measured = salted.groupBy("part", "salt").cogroup(needed.groupBy("part", "salt")).applyInPandas(measure, "y double, x double, place long, held boolean, km double")
    sure = met.filter(F.col("kind") == INSIDE).select("y", "x", "place", F.lit(True).alias("held"), F.lit(0.0).alias("km"))
    best = sure.unionByName(measured).groupBy("y", "x").agg(F.min(F.when(F.col("held"), F.col("place"))).alias("inside"), F.min(F.when(F.col("km") <= reach_km, F.struct("km", "place"))).alias("nearest"))
    named = best.select("y", "x", F.coalesce("inside", "nearest.place").alias("place")).join(names, "place")
    out = points.join(named.select(F.col("y").alias("__y"), F.col("x").alias("__x"), "__region"), (F.col(lat).cast("double") == F.col("__y")) & (F.col(lon).cast("double") == F.col("__x")), "left")
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return out.withColumn(name, F.when(known, F.coalesce("__region", F.lit(other)))).drop("__y", "__x", "__region")
