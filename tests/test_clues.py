"""Names of places, and the clue analysis from raw rows to its tables."""

from __future__ import annotations

import datetime as dt
import random
import time
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftstone.functions import phrases
from siftstone.functions.text import FOLDED_TOKEN, fold
from siftstone.operators import clue_chain, clue_tables, gazetteer, timeline
from siftstone.operators.checks import CheckFailed
from siftstone.operators.places import count_phrases
from siftstone.plans import catalog
from siftstone.sources import readers

from .conftest import DATA

PLACES = [
    # place, name, level, country, ascii name, alternates, latitude, longitude
    ("1", "Italy", "country", "IT", None, None, None, None), ("2", "Georgia", "country", "GE", None, None, None, None), ("3", "United Kingdom", "country", "GB", None, None, None, None),
    ("4", "Georgia", "region", "US", "Georgia", None, 32.0, -83.0), ("5", "Rome", "settlement", "IT", "Rome", "Roma,Rom,Urbs", 41.9, 12.5), ("6", "Rome", "settlement", "US", "Rome", None, 34.2, -85.1),
    ("7", "São Paulo", "settlement", "BR", "Sao Paulo", "Macro,Sampa", -23.5, -46.6), ("8", "Nice", "settlement", "FR", "Nice", None, 43.7, 7.2), ("9", "New York City", "settlement", "US", None, "NYC,New York,10001", 40.7, -74.0),
    ("10", "National Park", "settlement", "US", None, None, 1.0, 1.0), ("11", "Tbilisi", "settlement", "GE", None, None, 41.7, 44.8),
]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "place_id string, name string, level string, country string, ascii_name string, alternates string, latitude double, longitude double")


@pytest.fixture(scope="module")
def known(spark, places):
    of = places.withColumnRenamed("place_id", "place")
    common = spark.createDataFrame([("nice",), ("macro",)], "word string")
    return gazetteer.dictionary(gazetteer.admitted(gazetteer.names_of(places), of, common), of)


def test_names_are_admitted_by_rules(known):
    got = {r["phrase"]: [(p["place"], p["canonical"]) for p in r["places"]] for r in known.collect()}
    assert got["rome"] == [("5", True), ("6", True)] and got["roma"] == [("5", False)] and got["georgia"] == [("2", True), ("4", True)]
    assert got["são paulo"] == [("7", True)] and got["sao paulo"] == [("7", True)] and got["new york"] == [("9", False)]
    assert got["uk"] == [("3", True)] and got["great britain"] == [("3", True)]  # short, but a country
    assert not {"rom", "nyc", "10001", "nice", "macro", "national park"} & set(got)


def test_archives_are_read_where_spark_reads_them(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"part{k}.zip", "w") as z:
            z.writestr("towns.txt", "".join(f"{k}-{n}\tName {n}é\n" for n in range(3000)))
            z.writestr("other.txt", "x")
    lines = gazetteer.read_zipped_lines(spark, f"{tmp_path}/*.zip", "towns.txt")
    assert lines.count() == 6000 and lines.filter("value = '1-2999\tName 2999é'").count() == 1


def test_gazetteer_names_from_dumps(spark, tmp_path):
    (tmp_path / "c.txt").write_text("#x\n" + "\t".join(["IT", *"abc", "Italy", *"defghijklmn", "1"]) + "\n" + "\t".join(["GB", *"abc", "United Kingdom", *"defghijklmn", "3"]) + "\n")
    (tmp_path / "r.txt").write_text("IT.07\tLazio\tLatium\t20\n")
    (tmp_path / "s.txt").write_text("\t".join(["5", "Rome", "Rome", "Roma,Urbs", "41.9", "12.5", "P", "PPLC", "IT", "", "07", "", "", "", "2318895"]) + "\n")
    places = readers.read_gazetteer(spark, *(str(tmp_path / f"{n}.txt") for n in "crs"))
    got = {(r["place"], r["name"], r["canonical"]) for r in gazetteer.names_of(places).collect()}
    assert {("1", "Italy", True), ("3", "UK", True), ("20", "Lazio", True), ("20", "Latium", True), ("5", "Rome", True), ("5", "Roma", False), ("5", "Urbs", False)} <= got


def test_common_words_come_from_texts(spark):
    texts = spark.createDataFrame([("a lovely day in Rome",), ("lovely weather",), ("Rome again",), (None,)], "t string")
    assert {r["word"] for r in gazetteer.common_words(texts, "t", 0.5).collect()} == {"lovely"}


def test_long_texts_take_linear_time(spark, known):
    lookup = known.select("phrase")
    bits, whole, begin = gazetteer.sieve(lookup)

    def took(n):
        text = "New York and Rome or the new rome of a new day " * (n // 11)
        best = 9.0
        for _ in range(3):
            at = time.process_time()
            gazetteer.runs(text, bits, whole, begin, 12)
            best = min(best, time.process_time() - at)
        return best

    assert took(32_000) < 3 * took(16_000)
    units = spark.createDataFrame([(1, "Rome, " * 16_000), (2, None), (3, "")], "u int, t string")
    hits = gazetteer.found_phrases(units, ["u"], F.col("t"), known).collect()
    assert len(hits) == 1 and len(hits[0]["hits"]) == 16_000


@pytest.mark.parametrize(
    "text, said",
    [
        ("Photo taken in Paris", (True, False, False, False)), ("seen by my friend Bob at Paris", (True, False, False, False)), ("seen by my very old friend Bob Smith at Paris", (False, False, False, False)),
        ("Location: Paris", (True, False, False, False)), ("found, near Paris", (False, False, False, False)), ("native to Paris", (False, True, False, False)), ("this species occurs in Paris", (False, True, False, False)),
        ("I photographed this genus in Paris", (True, False, False, False)), ("this genus lives in Paris", (False, True, False, False)), ("I saw this genus. Paris", (False, False, False, False)), ("greetings from Paris", (False, False, True, False)), ("post it to Paris", (False, False, True, False)), ("was this taken in Paris?", (True, False, False, True)),
        ("where is Paris", (False, False, False, False)), ("shot in the wild, Paris", (True, False, False, False)),
    ],
)
def test_what_is_said_around_a_mention(text, said):
    at = text.index("Paris")
    assert phrases.mentions(text, [(at, at + 5)])[0][2:] == said


def test_a_cue_must_be_near():
    text = "native to the far east. " + "word " * 40 + "Paris"
    at = text.index("Paris")
    assert phrases.mentions(text, [(at, at + 5)])[0][2:] == (False, False, False, False)


PHOTOS = (
    "photo string, owner string, titles array<string>, descriptions array<string>, tags array<struct<raw: string, author: string>>, raw_tags string, machine_tags string, "
    "comments array<struct<id: string, author: string, at: string, text: string>>, profile string, taken string, unknown boolean, granularity int, latitude double, longitude double"
)


def photo(key, **given):
    row = {"photo": key, "owner": "o", "titles": None, "descriptions": None, "tags": None, "raw_tags": None, "machine_tags": None, "comments": None, "profile": None, "taken": None, "unknown": False, "granularity": 0, "latitude": None, "longitude": None}
    return tuple((row | given).values())


def test_analysis_from_raw_rows(spark, places, known):
    noon = "2024-05-01 12:00:00"
    photos = [
        photo("a", descriptions=["<p>Photo taken in Rome</p>"], titles=["x", "x"]),
        photo("b", titles=["Rome", "<b>Rome</b>"], tags=[("geo:country=Italy", "o"), ("camera:iso=1", "o"), ("Rome", "x"), ("Rome", "o")]),
        photo("c", descriptions=["lat: 1.5, lon: 2.5 <a href='https://www.openstreetmap.org/?mlat=3.5&mlon=4.5'>map</a>"]),
        photo("d", comments=[("1", "o", "9", "seen in Tbilisi two hours later"), ("2", "z", "9", "nice! Where in Georgia?"), ("3", "z", "9", "nice! Where in Georgia?")], taken=noon),
        photo("e", raw_tags="geotagged:lat=5 GEO:LON=6"),
        photo("f", profile="Italy", taken="2024-05-01 12:30:00"),
        photo("g", descriptions=["found near the old mill. It hatched at 10:30 am"], taken="2024-05-02 12:10:00"),
        photo("h", owner="p"),
        photo("i", titles=["Rome"]),
    ]
    located = [photo("n1", taken="2024-05-01 11:20:00", latitude=1.0, longitude=2.0), photo("n2", taken="2024-05-01 12:00:00", latitude=0.0, longitude=0.0), photo("n3", taken="2024-05-01 00:00:00", latitude=1.0, longitude=2.0), photo("n4", owner="q", taken=noon, latitude=1.0, longitude=2.0)]
    provider = spark.createDataFrame([("i", 9.5, 8.5), ("zz", 1.0, 1.0), ("h", 0.0, 0.0)], "photo string, latitude double, longitude double")
    a = clue_chain.analyse(spark.createDataFrame(photos, PHOTOS), spark.createDataFrame(located, PHOTOS), provider, known)
    summary = {r["photo"]: r for r in a.summary.collect()}
    assert {k: r["status"] for k, r in summary.items()} == {
        "a": "other_mention", "b": "named_capture", "c": "text_coordinates", "d": "named_capture", "e": "machine_tags", "f": "day_neighbour", "g": "other_mention", "h": "none", "i": "provider_coordinates"
    }
    found = {}
    for r in a.evidence.collect():
        found.setdefault(r["photo"], []).append(r)
    (rome,) = found["a"]  # a capture in an ambiguous place names no one place
    assert rome["kind"] == "explicit_photo_locality" and not rome["capture"] and len(rome["candidates"]) == 2 and "ambiguous_place_name" in rome["flags"]
    assert sorted((r["source"], r["kind"], r["capture"], [p["place"] for p in r["candidates"]]) for r in found["b"]) == [("tag", "place_tag", True, ["1"]), ("tag", "place_tag", True, ["5"]), ("title", "title_place", True, ["5"])]
    assert summary["b"]["named"] == ["1", "5"]
    assert sorted((r["kind"], r["candidates"][0]["latitude"]) for r in found["c"]) == [("labelled_decimal", 1.5), ("map_link", 3.5)]
    assert sorted((r["kind"], r["occurrence_count"], r["capture"]) for r in found["d"]) == [("location_question", 1, False), ("location_question", 1, False), ("owner_comment_locality", 1, True)]
    assert (summary["d"]["owner_comment"], summary["d"]["other_comment"], summary["d"]["relative_times"], summary["d"]["comments"]) == (1, 2, 1, 3)
    assert (summary["e"]["machine_latitude"], summary["e"]["machine_longitude"]) == (5.0, 6.0) and summary["f"]["profile"] == 1
    assert [(r["kind"], r["matched"]) for r in found["g"]] == [("unresolved_locality_phrase", "the old mill")]
    times = [(r["photo"], r["expression"], r["basis"]) for r in a.times.orderBy("photo").collect()]
    assert times == [("d", "two hours later", "comment_narrative_reference_unresolved"), ("g", "at 10:30 am", "clock_time_in_text_timezone_unresolved")]
    near = {(r["photo"], r["window"], r["relation"]): (r["anchor_id"], r["minutes"], r["anchors"]) for r in a.neighbours.collect()}
    assert near == {("d", "hour", "before"): ("n1", 40.0, 1), ("f", "day", "before"): ("n1", 70.0, 1)}
    report = clue_chain.run_report(a.summary).first().asDict()
    assert {k: report[k] for k in ("photos", "comments", "with_provider_point", "with_machine_point", "with_named_capture", "with_text_point", "with_clock_time", "with_owner_comment", "with_other_comment")} == {
        "photos": 9, "comments": 3, "with_provider_point": 1, "with_machine_point": 1, "with_named_capture": 2, "with_text_point": 1, "with_clock_time": 1, "with_owner_comment": 1, "with_other_comment": 1
    }
    placed = {r["photo"]: r for r in clue_chain.provisional_places(a.evidence, places.withColumnRenamed("place_id", "place")).collect()}
    assert placed["b"]["place"] == "5" and placed["b"]["method"] == "gazetteer_place_reference" and placed["b"]["excerpts"] and len(placed["b"]["evidence_ids"]) >= 2
    assert placed["c"]["method"] == "text_coordinate_reference" and placed["c"]["candidates"] == 2 and "widely_separated_candidates" in placed["c"]["flags"]
    assert set(placed["a"]["alternatives"]) == {"6"} and "f" not in placed  # what a profile says is no place of a photo


def test_analysis_of_nothing_and_of_repeats(spark, known):
    none = spark.createDataFrame([], PHOTOS)
    provider = spark.createDataFrame([], "photo string, latitude double, longitude double")
    a = clue_chain.analyse(none, none, provider, known)
    assert [t.count() for t in a] == [0, 0, 0, 0] and clue_chain.run_report(a.summary).first()["photos"] == 0
    twice = spark.createDataFrame([photo("a"), photo("a")], PHOTOS)
    with pytest.raises(CheckFailed):
        clue_chain.analyse(twice, none, provider, known)
    with pytest.raises(CheckFailed):
        clue_chain.analyse(spark.createDataFrame([photo(None)], PHOTOS), none, provider, known)


def test_runs_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """However many runs the texts of one Arrow batch hold, few are held at once."""
    monkeypatch.setattr(gazetteer, "RUNS", 50)
    known = spark.createDataFrame([("rome", [1, 2]), ("new york", [3])], "phrase string, places array<int>")
    units = spark.createDataFrame([(k, "Rome, New York " * 20) for k in range(30)] + [(30, None), (31, "")], "u int, t string").coalesce(1)
    tried = gazetteer.tried_runs(units, ["u"], F.col("t"), known)
    assert "MapInArrow" in tried._jdf.queryExecution().executedPlan().toString() and tried.count() == 30 * 40
    hits = {r["u"]: r["hits"] for r in gazetteer.found_phrases(units, ["u"], F.col("t"), known).collect()}
    assert set(hits) == set(range(30)) and [(h["at"], h["n"], h["places"]) for h in hits[7][:3]] == [(0, 1, [1, 2]), (1, 2, [3]), (3, 1, [1, 2])] and len(hits[7]) == 40


def test_nearest_anchors_without_pairs(spark):
    """The same as from all pairs: ties, a row's own anchor at its time or another, ends of windows and slices, missing values."""
    rnd = random.Random(1)
    start = dt.datetime(2020, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rnd.choice([rnd.randrange(2000) * 600, rnd.randrange(1_200_000)]), microseconds=rnd.choice([0, 0, 1, 999_999]))
    rows = [(k, rnd.choice(["a", "b", None]), at() if rnd.random() < 0.95 else None) for k in range(300)]
    known = [(k, o, t if rnd.random() < 0.7 else at()) for k, o, t in rows[:150]] + [(1000 + k, rnd.choice(["a", "b"]), at()) for k in range(60)]
    kinds = "photo int, owner string, at timestamp_ntz"
    targets, anchors = spark.createDataFrame(rows, kinds), spark.createDataFrame(known, kinds)
    pairs = timeline.nearest(timeline.interval_join(targets, anchors, "owner", "at", "photo"), "photo")
    found = timeline.nearest_anchors(targets, anchors, "owner", "at", "photo")
    assert found.columns == pairs.columns and pairs.count() > 300
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def test_units_read_each_text_once(spark):
    """A raw title that shows what the current one shows is left out without a second look at all texts."""
    rows = [("a", ["Rome", "<b>Rome</b>"], ["x", "y"]), ("b", ["", "Rome"], [None, "y"]), ("c", ["Rome", "Rome"], None)]
    photos = spark.createDataFrame(rows, "photo string, titles array<string>, descriptions array<string>")
    none = {"owner": "string", "tags": "array<struct<raw: string, author: string>>", "raw_tags": "string", "comments": "array<struct<id: string, author: string, at: string, text: string>>", "profile": "string"}
    units = clue_chain.text_units(photos.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}))
    assert sorted((r["photo"], r["unit"], r["text"]) for r in units.collect()) == [("a", 0, "Rome"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "Rome"), ("b", 3, "y"), ("c", 0, "Rome")]
    assert "Join" not in units._jdf.queryExecution().optimizedPlan().toString()


def test_violations_in_one_pass(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "id string")
    evidence = spark.createDataFrame([("a", "map_link"), ("x", "odd"), (None, None), ("b", "map_link")], "id string, kind string")
    near = spark.createDataFrame([("a", clue_tables.HOUR, "earlier", 61.0), ("a", clue_tables.HOUR, "earlier", 1.0), ("x", clue_tables.DAY, "later", 1440.0), (None, clue_tables.DAY, "later", 2000.0)], "id string, time_window string, relation string, minutes double")
    found = clue_tables.violations(keys("a", "a", "b", None, None), keys("a", "c", "c", None), evidence, near, "id", ["map_link"])
    assert [r["rows"] for r in found.collect()] == [2, 3, 1, 2, 2, 2, 2, 1]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    empty = clue_tables.violations(keys(), keys(), evidence.limit(0), near.limit(0), "id", ["map_link"])
    assert [r["rows"] for r in empty.collect()] == [0] * 8


ODD = ["straße", "STRASSE", "ﬁn", "ǆ", "ﷺ", "日", "本日", "각", "각", "İx", "é", "é1", "x" * 40, "٣", "a", "b", "Rome", "new", "york"]


@pytest.mark.parametrize("way", ["as it is", "crowded bitmaps", "too many to send", "no frequent ones"])
def test_phrases_against_brute_force(spark, monkeypatch, way):
    """The same hits and counts, whether bitmaps let much pass, tasks know what is no phrase and what is frequent, and units have several rows."""
    if way in ("crowded bitmaps", "too many to send"):
        monkeypatch.setattr(gazetteer, "LEAST_BITS", 1 << 15)
        monkeypatch.setattr(gazetteer, "MOST_BITS", 1 << 15)
    if way == "too many to send":
        monkeypatch.setattr(gazetteer, "MOST_FALSE", 0)
    monkeypatch.setattr(gazetteer, "FREQUENT", {"no frequent ones": 0}.get(way, 12))
    monkeypatch.setattr(gazetteer, "CHARACTERS", 300)
    monkeypatch.setattr(gazetteer, "RUNS", 20)
    rnd = random.Random(4)
    line = lambda n: rnd.choice([" ", ", ", "-", "  "]).join(rnd.choice(ODD) for _ in range(n))
    names = {" ".join(fold(m[0]) for m in FOLDED_TOKEN.finditer(line(rnd.randrange(1, 4)))) for _ in range(90)} - {""}
    names |= {f"w{k} w{k + 1} w{k + 2}" for k in range(8000)}
    known = {p: [k, k + 1][: 1 + k % 2] for k, p in enumerate(sorted(names))}
    rows = [(k % 37, line(rnd.randrange(60))) for k in range(40)] + [(k, line(rnd.randrange(60))) for k in range(50, 120)] + [(200, None), (201, ""), (None, "new york"), (202, " ".join(f"w{rnd.randrange(9)}" for _ in range(3000)))]
    want = []
    for u in {u for u, _ in rows}:
        found = []
        for text in (t for v, t in rows if v == u):
            spans = [(fold(m[0]), m.start(), m.end()) for m in FOLDED_TOKEN.finditer(text or "")]
            found += [(at, -n, spans[at][1], spans[at + n - 1][2], p) for at in range(len(spans)) for n in range(1, min(12, len(spans) - at) + 1) if (p := " ".join(x[0] for x in spans[at : at + n])) in known]
        free = 0
        for at, n, start, stop, p in sorted(found, key=lambda x: x[:2]):
            if at >= free:
                free = at - n
                want.append((u, at, -n, start, stop, tuple(known[p])))
    units = spark.createDataFrame(rows, "u int, t string").repartition(3)
    one = {u for u, _ in rows} - {0, 1, 2}  # which of equally long hits of several rows stays is open
    listed = spark.createDataFrame(list(known.items()), "phrase string, places array<int>")
    got = [(r["u"], r["at"], r["n"], r["start"], r["stop"], tuple(r["places"])) for r in gazetteer.phrase_hits(units, ["u"], F.col("t"), listed).collect()]
    in_order = lambda x: sorted((r for r in x if r[0] in one), key=repr)
    assert len(want) > 1000 and in_order(got) == in_order(want)
    assert sorted((r[1], r[2]) for r in got if r[0] in (0, 1, 2)) == sorted((r[1], r[2]) for r in want if r[0] in (0, 1, 2))
    counts = gazetteer.phrase_counts(units, ["u"], F.col("t"), listed.withColumn("places", F.size("places"))).collect()
    assert in_order(tuple(r) for r in counts) == in_order((*k, n) for k, n in Counter((u, n, len(p)) for u, _, n, _, _, p in want).items())


def test_only_what_stays_leaves_a_task(spark):
    """Runs aren't gathered by text; where they are counted, a text's frequent phrases are one row for each length and number of places."""
    plan = catalog.QUERIES["gazetteer_matches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "_leftmost_longest" not in plan
    names = spark.createDataFrame([("Rome", 1), ("New York", 2), ("York", 3)], "a string, p int")
    units = spark.createDataFrame([(k, "Rome, New York, York " * 500) for k in range(3)], "u int, t string")
    found = count_phrases(units, "u", F.col("t"), names, "a", "p")
    assert sorted(tuple(r) for r in found.collect()) == [(k, n, 1, 500 * (3 - n)) for k in range(3) for n in (1, 2)]
    inner = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in inner and "spots" not in inner
