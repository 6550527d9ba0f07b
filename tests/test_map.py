"""The map's rules, its selections and its snapshots."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import map_rows
from siftstone.operators.checks import CheckFailed
from siftstone.sources import map_snapshots

DAY = datetime.date(2020, 5, 4)
SHAPE = "key string, latitude double, longitude double, image_url string, fallback_url string, label string, dataset_label string, day date, date string, source string"
GOOD = ("a", 10.0, 20.0, "https://x.example/a", None, "=1+1", "", DAY, "2020-05-04", "extra")


def images(spark, *rows):
    return spark.createDataFrame([*rows], SHAPE)


def changed(key, **values):
    names = [c.split()[0] for c in SHAPE.split(", ")]
    return tuple(values.get(n, key if n == "key" else v) for n, v in zip(names, GOOD, strict=True))


def test_each_rule_is_told(spark):
    bad = {
        "no usable key": [changed(None), changed(""), changed("k" * 129)],
        "a key that repeats": [changed("r"), changed("r")],
        "no usable coordinates": [changed("c1", latitude=86.5), changed("c2", longitude=None), changed("c3", latitude=0.0, longitude=0.0), changed("c4", latitude=float("nan")), changed("c5", longitude=float("inf"))],
        "a bad label": [changed("l1", label="x" * 501), changed("l2", label="a\tb")],
        "a bad image address": [changed("u1", image_url=None), changed("u2", image_url="http://x.example/"), changed("u3", image_url="https://me@x.example/"), changed("u4", image_url="https://x.example/" + "y" * 4096)],
        "a bad fallback address": [changed("f", fallback_url="ftp://x.example/")],
        "a bad data set": [changed("d1", dataset_label=" x"), changed("d2", dataset_label="x" * 121)],
    }
    good = [GOOD, changed("g1", latitude=-86.0, longitude=180.0), changed("g2", label=None, dataset_label=None, fallback_url="")]
    found = map_rows.problems(images(spark, *good, *[r for rows in bad.values() for r in rows]))
    assert found.columns[-2:] == ["source", "problem"]
    told = {}
    for r in found.collect():
        told.setdefault(r["problem"], []).append(r["key"])
    assert {k: len(v) for k, v in told.items()} == {None: 3} | {k: len(v) for k, v in bad.items()}
    assert map_rows.problems(images(spark, *good).limit(0)).count() == 0


def test_bad_maps_abort(spark):
    one = images(spark, GOOD)
    assert map_rows.checked(one, 1) is one
    for rows, options in ((one.limit(0), {}), (one, {"expected": 2}), (one.unionByName(images(spark, changed("b"))), {"most": 1}), (images(spark, changed("b", latitude=99.0)), {})):
        with pytest.raises(CheckFailed):
            map_rows.checked(rows, **options)


def test_selections_are_as_asked_for(spark):
    rows = images(spark, GOOD, changed("b", day=None, date=None, label=" @x", fallback_url="https://x.example/full"), changed("old", day=datetime.date(1999, 1, 1)))
    ask = lambda *keys: spark.createDataFrame([*enumerate(keys)], "place int, key string")
    got = [tuple(r) for r in map_rows.selected(rows, ask("b", "a"), (2000, 2024)).orderBy("place").collect()]
    assert [r[:3] + r[4:] for r in got] == [(0, "https://x.example/full", "", "' @x"), (1, "https://x.example/a", "2020-05-04", "'=1+1")]
    lat, lon = map(float, got[0][3].split(", "))
    assert abs(lat - 10) < 0.1 and abs(lon - 20) < 0.1 and (lat, lon) != (10, 20)
    for keys in (("a", "a"), ("none",), ("old",)):
        with pytest.raises(CheckFailed):
            map_rows.selected(rows, ask(*keys), (2000, 2024))
    assert map_rows.selected(rows, ask("a").limit(0)).count() == 0


def test_snapshots_are_what_their_pointer_vouches_for(spark, tmp_path):
    folder = str(tmp_path / "map")
    rows = images(spark, GOOD, changed("b", label='quote " é', day=None, date=None))
    revision = map_snapshots.publish_map(rows, 'A "map"', folder, expected=2)
    assert map_snapshots.publish_map(rows, 'A "map"', folder) == revision != map_snapshots.publish_map(rows, "Another", folder)
    map_snapshots.publish_map(rows, 'A "map"', folder)
    for reference in (f"{folder}/current", f"{folder}/{revision}"):
        back = map_snapshots.read_map(spark, reference)
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.select(*back.columns).collect()), key=repr)

    def point(**other):
        pointer = {"schema_version": 2, "snapshot_url": f"{folder}/{revision}", "sha256": sha, "revision": revision, "image_count": 2} | other
        at = str(tmp_path / f"p{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame([(json.dumps(pointer),)], "value string").write.text(at)
        return at

    sha = spark.read.text(f"{folder}/{revision}").select(F.sha2("value", 256)).first()[0]
    assert map_snapshots.read_map(spark, point()).count() == 2
    for other in ({"sha256": "0" * 64}, {"sha256": "short"}, {"revision": "x"}, {"image_count": 3}, {"snapshot_url": None}, {"snapshot_url": f"https://elsewhere.example{folder}/{revision}"}, {"snapshot_url": f"{folder}/none"}, {"schema_version": 3}):
        with pytest.raises(CheckFailed):
            map_snapshots.read_map(spark, point(**other))


def test_large_snapshots_are_refused(spark, tmp_path, monkeypatch):
    map_snapshots.publish_map(images(spark, GOOD), "Map", str(tmp_path))
    monkeypatch.setattr(map_snapshots, "MOST_BYTES", 100)
    with pytest.raises(CheckFailed, match="too large"):
        map_snapshots.read_map(spark, f"{tmp_path}/current")
    with pytest.raises(CheckFailed, match="too large"):
        map_snapshots.publish_map(images(spark, GOOD), "Map", str(tmp_path))
