"""Truth tables of operators."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siftstone.functions import dates, geo, phrases, text
from siftstone.operators import candidates, checks, consensus, evidence, places, progress, reconcile, region_index, round_plans, rounds, timeline, versioned


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_plurality_prefers_the_order_on_ties(spark):
    votes = spark.createDataFrame(
        [("u", "moth", 1), ("u", "moth", 2), ("p", "adult", 1), ("p", "adult", 2), ("p", "plant", 3), ("t", "plant", 1), ("t", "bird", 2), ("s", "unsure", 1), ("x", "zz", 1), ("x", "aa", 1), ("n", None, 1)],
        "item string, label string, at int",
    )
    got = consensus.plurality(votes, ["item"], "label", "at", ["adult", "moth", "bird", "plant", "unsure"])
    assert values(got, "item", "consensus_label", "review_count", "unanimous", "tied", "reviewed_at") == [
        ("p", "adult", 3, False, False, 3), ("s", "unsure", 1, True, False, 1), ("t", "bird", 2, False, True, 2), ("u", "moth", 2, True, False, 2), ("x", "aa", 2, False, True, 1),
    ]


def test_flags_keep_null_and_ties_win(spark):
    df = spark.createDataFrame([("a", False), ("b", True), (None, False), (None, True)], "label string, tied boolean")
    got = consensus.with_flags(df, "label", {"f": ["a"], "g": ["a"]}, "tied", "g")
    assert values(got, "label", "tied", "f", "g") == sorted([("a", False, True, True), ("b", True, False, True), (None, False, None, None), (None, True, None, True)], key=repr)


def test_latest_breaks_ties_by_identifier(spark):
    df = spark.createDataFrame([(1, 5, "a", 10), (1, 6, "b", 10), (1, 9, "c", 9), (2, 1, "d", 1)], "k int, id int, v string, at int")
    assert values(consensus.latest(df, ["k"], "at", "id"), "k", "id", "v") == [(1, 6, "b"), (2, 1, "d")]


def test_cursor_wraps_from_any_anchor(spark):
    items = spark.createDataFrame([(1, 2), (1, 5), (1, 9), (2, 7)], "b int, p int")
    anchors = spark.createDataFrame([(1, a) for a in (-(2**31), 1, 2, 3, 5, 7, 9, 10, 2**31 - 1)] + [(2, 7)], "b int, a int")
    got = dict(((r["b"], r["a"]), (r["next_position"], r["previous_position"])) for r in progress.seek(items, anchors, ["b"], "p", "a").collect())
    assert got == {(1, -(2**31)): (2, 9), (1, 1): (2, 9), (1, 2): (5, 9), (1, 3): (5, 2), (1, 5): (9, 2), (1, 7): (9, 5), (1, 9): (2, 5), (1, 10): (2, 9), (1, 2**31 - 1): (2, 9), (2, 7): (7, 7)}


def test_progress_keeps_empty_batches(spark):
    b = spark.createDataFrame([(1,), (2,), (3,)], "b int")
    i = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "b int, i int")
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (4, "b")], "i int, who string")
    got = progress.batch_progress(b, i, r, "b", "i", "who", "a")
    assert values(got, "b", "total", "team", "personal", "complete") == [(1, 3, 2, 1, False), (2, 1, 1, 0, True), (3, 0, 0, 0, False)]


def test_prior_review_needs_another_batch(spark):
    i = spark.createDataFrame([("k", 1), ("k", 2), ("l", 1), ("m", 3)], "k string, b int")
    seen = spark.createDataFrame([("k", 1), ("l", 1)], "k string, b int")
    assert values(progress.prior_review(i, seen, ["k"], "b"), "k", "b", "previously_reviewed") == [("k", 1, False), ("k", 2, True), ("l", 1, False), ("m", 3, False)]


def test_seeded_shuffle_and_batches(spark):
    df = spark.range(2500).select("id", rounds.hash_order("s", 0, F.col("id")).alias("d"))
    got = rounds.logical_batches(df, "d", ["id"], 1000, "B").orderBy("ordinal").collect()
    assert [r["id"] for r in got] == [r["id"] for r in df.orderBy("d").collect()]
    assert [(r["batch_number"], r["position"]) for r in got] == [(k // 1000 + 1, k % 1000 + 1) for k in range(2500)]
    assert got[2000]["batch_code"] == "B-003"
    codes = {r["batch_number"]: r["batch_code"] for r in rounds.logical_batches(df, "d", ["id"], 2, "B").collect()}
    assert codes[999] == "B-999" and codes[1000] == "B-1000" and len(set(codes.values())) == 1250


def test_balanced_like_ntile(spark):
    df = spark.range(23).select(F.lit(1).alias("g"), "id")
    sizes = [r["n"] for r in rounds.balanced(df, ["g"], ["id"], 10).groupBy("bucket").agg(F.count("id").alias("n")).orderBy("bucket").collect()]
    assert sizes == [8, 8, 7]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(checks.CheckFailed, match="repeated"):
        checks.require_none(checks.duplicates(df, ["k"]), "repeated")
    checks.require_none(checks.duplicates(df, ["k", "v"]), "repeated")
    with pytest.raises(checks.CheckFailed):
        checks.require_columns(df, ["w"])
    assert values(checks.differing(df, df.filter("k = 1")), "k", "v", "side") == [(2, "c", "first")]


def test_reconcile_fails_closed(spark):
    s = spark.createDataFrame([(1,), (2,)], "k int")
    r = spark.createDataFrame([(2, "x")], "k int, v string")
    assert values(reconcile.reconcile(s, r, ["k"]), "k", "v", "has_saved_review") == sorted([(1, None, False), (2, "x", True)], key=repr)
    with pytest.raises(checks.CheckFailed, match="without a source"):
        reconcile.reconcile(s, spark.createDataFrame([(3, "x")], "k int, v string"), ["k"])


def test_images_join_their_reviews_and_places(spark):
    texts = [f"{r}_{c}" for r in ("first_round", "second_round") for c in (*reconcile.ROUND_COUNTS, *reconcile.ROUND_FLAGS, *reconcile.ROUND_TEXTS, "reviews_json")]
    saved = {"first_round_review_count": "3", "first_round_unanimous": "TRUE", "first_round_has_conflicting_reviews": "", "first_round_reviews_json": '[{"userEmail": "x", "label": "a"}]', "first_round_result_counts_json": ""}
    reviews = spark.createDataFrame([("s", "1", "img1", *[saved.get(c) for c in texts])], "source string, id string, image_id string, " + ", ".join(f"{c} string" for c in texts))
    source = spark.createDataFrame([("s", "1", "10.5", "20", "5", "hi", None), ("s", "2", "north", "20", "5", None, 1), ("s", "3", "10", "20", "17", None, 1), ("s", "4", "1", "2", "3", None, 1)], "source string, id string, latitude string, longitude string, accuracy string, comments_text string, extra int")
    located = spark.createDataFrame([("4", 7.0, 8.0, 9, "response")], "id string, latitude double, longitude double, accuracy int, geolocation_source string")
    got = {r["id"]: r for r in reconcile.joined_images(source, reviews, located, ["source", "id"], "id").collect()}
    one = got["1"].asDict()
    assert (one["latitude"], one["accuracy"], one["geolocation_source"], one["discovery_comments_text"], one["has_saved_review"]) == (10.5, 5, reconcile.SEARCHED, "hi", True) and "comments_text" not in one
    assert (one["first_round_review_count"], one["first_round_unanimous"], one["first_round_has_conflicting_reviews"], one["first_round_result_counts_json"], one["second_round_review_count"]) == (3, True, None, None, 0)
    assert one["first_round_reviews_json"] == '[{"label": "a"}]' and got["2"]["second_round_reviews_json"] == "[]" and got["2"]["has_saved_review"] is False
    assert [got[k]["latitude"] for k in "234"] == [None, None, 7.0] and got["4"]["geolocation_source"] == "response"
    for bad in ((source.union(source), reviews, located), (source, reviews.union(reviews), located), (source.limit(0), reviews, located), (source, reviews, located.union(located))):
        with pytest.raises(checks.CheckFailed):
            reconcile.joined_images(*bad, ["source", "id"], "id")


def test_neighbours_in_time(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    rows = spark.createDataFrame([("a", 1, at(12)), ("a", 2, at(13)), ("a", 3, at(12)), ("a", 4, at(10, 30)), ("b", 5, at(12))], "owner string, id int, at timestamp_ntz")
    pairs = timeline.interval_join(rows.filter("id = 1"), rows, "owner", "at", "id")
    assert values(timeline.nearest(pairs, "id"), "window", "relation", "anchor_id", "minutes", "anchors") == [
        ("day", "before", 4, 90.0, 1), ("hour", "after", 2, -60.0, 1), ("hour", "same_time", 3, 0.0, 1),
    ]


def test_equal_area_round_trip(spark):
    points = spark.createDataFrame([(float(a), float(b)) for a in range(-86, 87, 4) for b in (-180, -33, 0, 71, 179)], "lat double, lon double")
    x, y = geo.equal_area(F.col("lat"), F.col("lon"))
    back = points.withColumn("x", x).withColumn("y", y)
    lat, lon = geo.from_equal_area(F.col("x"), F.col("y"))
    worst = back.select(F.max(F.abs(lat - F.col("lat"))).alias("a"), F.max(F.abs(lon - F.col("lon"))).alias("b")).first()
    assert worst["a"] < 1e-6 and worst["b"] < 1e-9


def test_regions_with_holes_and_reach(spark):
    square = [[0, 0], [10, 0], [10, 10], [0, 10]]
    hole = [[4, 4], [6, 4], [6, 6], [4, 6]]
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 5.0, 11.0), (4, 50.0, 50.0), (5, None, 1.0)], "k int, lat double, lon double")
    got = places.region_of(points, "lat", "lon", [("sq", [square, hole])])
    assert values(got, "k", "region") == sorted([(1, "sq"), (2, "sq"), (3, "sq"), (4, "Other"), (5, None)], key=repr)  # the hole's middle is within reach of its edge
    got = places.region_of(points, "lat", "lon", [("sq", [square, hole])], reach_km=50)
    assert dict(values(got, "k", "region"))[2] == "Other"


def test_kth_nearest_against_brute_force(spark):
    import math
    import random

    random.seed(5)
    rows = [(k, random.uniform(-80, 80), random.uniform(-180, 180)) for k in range(60)] + [(100 + k, 48 + k / 50, 11 + k / 40) for k in range(20)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    got = places.kth_nearest_km(spark.createDataFrame(rows, "k int, lat double, lon double"), "k", "lat", "lon")
    for r in got.collect():
        me = next(x for x in rows if x[0] == r["k"])
        assert r["isolation_km"] == pytest.approx(sorted(km(me, o) for o in rows if o[0] != me[0])[4], rel=1e-9)


def test_phrases_leftmost_longest(spark):
    units = spark.createDataFrame([(1, "From New York City to York, new york!")], "u int, t string")
    names = spark.createDataFrame([("New York", "ny"), ("york city", "yc"), ("York", "y"), ("York", "y2"), ("new york city", "nyc")], "a string, p string")
    got = places.match_phrases(units, "u", F.col("t"), names, "a", "p").orderBy("start").collect()
    assert [(r["start"], r["length"], r["places"]) for r in got] == [(5, 3, ["nyc"]), (22, 1, ["y", "y2"]), (28, 2, ["ny"])]


@pytest.mark.parametrize(
    ("phrase", "minutes", "relation"),
    [("Two hours later", 120, "after"), ("half an hour before", 30, "before"), ("a week ago", 10080, "before"), ("15 min earlier", 15, "before"), ("quarter hour after", 15, "after"), ("3.5 hours later", 210, "after"), ("twenty-four hrs prior to it", 1440, "before"), ("no time", None, None)],
)
def test_relative_minutes(spark, phrase, minutes, relation):
    a, b = phrases.relative_minutes(F.lit(phrase))
    assert tuple(spark.range(1).select(a, b).first()) == (minutes, relation)


def test_https_addresses(spark):
    rows = spark.createDataFrame([("https://a.example/x",), ("http://a.example",), ("https://u:p@a.example",), (" https://a.example",), ("https://a b",), ("",), (None,)], "u string")
    assert [r[0] for r in rows.select(text.https_url(F.col("u"))).collect()] == [True] + [False] * 6


def test_machine_tags_stop_at_contradictions(spark):
    rows = spark.createDataFrame([("geo:lat=1 geo:lon=2", None), ("geo:lat=1 geo:lat=3", "geo:lat=5 geo:lon=6"), (None, "geo:lat=5 geo:lon=6"), ("x", "geo:lat=5 geo:lon=6")], "a string, b string")
    lat, lon = phrases.machine_tag_pair(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(lat, lon).collect()] == [(1.0, 2.0), (None, None), (5.0, 6.0), (5.0, 6.0)]


def test_json_helpers(spark):
    rows = spark.createDataFrame([('{"b": 1.0, "a": null}', '{"a": 2}'), ("[NaN]", "{}")], "x string, y string")
    got = rows.select(text.canonical_json("x").alias("c"), text.has_key(F.col("x"), "a").alias("k")).collect()
    assert got[0]["c"] == '{"a":null,"b":1.0}' and got[0]["k"] and got[1]["c"] is None and not got[1]["k"]
    assert rows.limit(1).select(text.merge_json("x", "y")).first()[0] == '{"a":2,"b":1.0}'
    assert spark.range(1).select(text.utf16_parts(F.lit("a😀b"), F.lit(2))).first()[0] == ["a", "😀", "b"]


def test_capture_times(spark):
    rows = spark.createDataFrame([("2024-05-01 10:11:12", 0, False), ("2024-05-01 00:00:00", 0, False), ("2024-05-01T10:11:12Z", 0, False), ("2024-05-01 10:11:12", 4, False), ("2024-05-01 10:11:12", 0, True), ("junk", 0, False)], "t string, g int, u boolean")
    got = [r[0] for r in rows.select(dates.capture_time(F.col("t"), F.col("u"), F.col("g"))).collect()]
    assert got == [dt.datetime(2024, 5, 1, 10, 11, 12)] + [None] * 5


def test_extras_win_over_metadata(spark):
    df = spark.createDataFrame([("1", {"a": "old", "b": "x"}, "new", float("nan"))], "image_id string, meta map<string,string>, a string, z double")
    row = candidates.with_extras(df, ["image_id"], "meta").first()
    assert row["meta"] == {"a": "new", "b": "x"} and len(row) == 2


def test_chunks_begin_anew(spark):
    df = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 5, 5, 20, 1, 1])] + [("h", 0, 3)], "g string, i int, s int")
    got = candidates.byte_chunks(df, "g", ["i"], "s", 10, 2).orderBy("g", "i").collect()
    assert [r["chunk"] for r in got] == [1, 1, 2, 3, 4, 4, 1]


def test_evidence_and_tags(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("l", "zz")], "k string, t string")
    assert values(evidence.tags(df, "k", "t", ["b", "a"]), "k", "tags", "primary_tag") == sorted([("k", ["a", "b"], "b"), ("l", ["zz"], None)], key=repr)
    assert sorted(r["occurrence_count"] for r in evidence.dedup(df, ["k", "t"]).collect()) == [1, 1, 2]


def test_versioned_saves(spark):
    log = spark.createDataFrame(
        [("i", "r", 1, "s1", "a", 0), ("i", "r", 2, "s1", "a", 0), ("i", "r", 3, "s1", "b", 0), ("i", "r", 4, "s2", "b", 0), ("i", "r", 5, "s3", "b", 1), ("i", "r", 6, "s1", "a", 0)],
        "item string, reviewer string, seq long, submission string, label string, expected int",
    )
    assert [r["result"] for r in versioned.apply_log(log).orderBy("seq").collect()] == ["inserted", "replayed", "conflict", "stale", "updated", "conflict"]


def test_units_and_mentions(spark):
    from siftstone.operators import clues

    photos = spark.createDataFrame(
        [("p", "Lake", "Lake", ["geo:lat=1", "camera:iso=5", "lake"], [("o", "mine"), ("x", "nice?"), ("x", "nice?")], " ", "o")],
        "id string, title string, description string, tags array<string>, comments array<struct<author: string, text: string>>, profile string, owner string",
    )
    got = clues.units(photos, "id", "title", "description", "tags", "comments", "profile", "owner")
    assert values(got, "source", "text", "by_owner") == sorted(
        [("title", "Lake", True), ("description", "Lake", True), ("tag", "geo:lat=1", True), ("tag", "lake", True), ("comment", "mine", True), ("comment", "nice?", False)], key=repr
    )


def test_mentions_are_classified(spark):
    from siftstone.operators import clues

    it, us, land = ("rome", "settlement", "IT", True), ("rome-us", "settlement", "US", False), ("it", "country", "IT", True)
    rows = [
        # unit, source, by the owner, text, mention, places, countries of the photo
        (1, "comment", True, "seen in Rome today", "Rome", [it], []),
        (2, "comment", False, "was in Rome", "Rome", [it], []),
        (3, "title", True, "taken in Rome", "Rome", [it, us], ["IT"]),
        (4, "tag", True, "#Rome", "Rome", [it, us], []),
        (5, "owner_profile", True, "Rome?", "Rome", [it], []),
        (6, "description", True, "native to Rome", "Rome", [it], []),
        (7, "description", True, "we like rome", "rome", [it], []),
        (8, "description", True, "we like italy", "italy", [land], []),
        (9, "description", True, "Where is this, Rome?", "Rome", [it], []),
        (10, "title", True, "Rome", "Rome", [us], ["US"]),
        (11, "title", True, "Rome", "Rome", [it], []),
        (12, "description", True, "greetings from Rome", "Rome", [it], []),
        (13, "tag", False, "geo:country=Italy", "Italy", [land], []),
    ]
    data = [(u, s, o, t, t.index(m), t.index(m) + len(m), p, c, []) for u, s, o, t, m, p, c in rows]
    schema = "u int, source string, by_owner boolean, text string, start int, stop int, places array<struct<place: string, level: string, country: string, canonical: boolean>>, context array<string>, local array<string>"
    got = {r["u"]: r for r in clues.classified(spark.createDataFrame(data, schema)).collect()}
    assert {u: (r["kind"], r["eligible"]) for u, r in got.items()} == {
        1: ("owner_comment_locality", True), 2: ("comment_place_mention", False), 3: ("explicit_photo_locality", True), 4: ("place_tag", False), 5: ("owner_profile_place", False),
        6: ("distribution_place", False), 8: ("description_place_mention", False), 9: ("location_question", False), 10: ("title_place", False), 11: ("title_place", False),
        12: ("greeting_or_group_place", False), 13: ("place_tag", True),
    }
    assert "ambiguous_place_name" in got[4]["flags"] and "alternate_settlement_name_without_capture_context" in got[10]["flags"]
    assert "settlement_lacks_country_or_capture_context" in got[11]["flags"] and "tag_author_not_verified_as_owner" in got[13]["flags"]
    local = clues.local_countries(spark.createDataFrame([(1, [land]), (1, [it, us]), (2, [it])], "u int, places array<struct<place: string, level: string, country: string, canonical: boolean>>"), "u")
    assert values(local, "u", "local") == [(1, ["IT"]), (2, [])]


def test_provisional_places(spark):
    from siftstone.operators import clues

    e = spark.createDataFrame(
        [
            ("a", "rome", "settlement", "IT", 41.9, 12.5, "title", "t", 60, None), ("a", "rome", "settlement", "IT", 41.9, 12.5, "tag", "g", 55, None), ("a", "oslo", "settlement", "NO", 59.9, 10.7, "title", "t", 62, None),
            ("b", "oslo", "settlement", "NO", 59.9, 10.7, "title", "t", 60, "IT"), ("c", "zero", "settlement", None, 0.0, 0.0, "title", "t", 60, None),
        ],
        "id string, place string, level string, country string, latitude double, longitude double, kind string, source string, score int, owner_country string",
    )
    n = spark.createDataFrame([("b", 7, 50.0, 1.0, 2.0), ("b", 8, 40.0, 0.0, 0.0), ("a", 9, 1.0, 1.0, 1.0)], "id string, anchor_id int, delta_seconds double, latitude double, longitude double")
    got = {r["id"]: r for r in clues.provisional(e, n, "id").collect()}
    assert set(got) == {"a", "b"} and got["a"]["place"] == "rome" and got["a"]["alternatives"] == ["oslo"] and set(got["a"]["flags"]) == {"several", "spread"}
    assert got["b"]["basis"] == "hour_neighbour" and got["b"]["place"] == "7"


def test_statuses_in_order(spark):
    from siftstone.operators import clues

    row = spark.range(1).select(clues.status(other_mention=F.lit(True), machine_tags=F.lit(True), profile_only=F.lit(None).cast("boolean")), clues.status(profile_only=F.lit(False))).first()
    assert tuple(row) == ("machine_tags", "none")
    c = spark.createDataFrame(
        [
            ("a", 1, "tag", "IT", "settlement", False), ("a", 1, "tag", "FR", "settlement", False), ("a", 2, "title", "IT", "settlement", False), ("b", 1, "tag", "IT", "settlement", False), ("b", 1, "tag", "FR", "settlement", False),
            ("c", 1, "tag", "GE", "country", False), ("c", 1, "tag", "US", "region", False), ("c", 2, "comment", "US", "country", True), ("d", 1, "title", "NO", "country", False), ("d", 2, "tag", "SE", "country", True), ("d", 3, "tag", "DK", "settlement", False),
        ],
        "id string, m int, s string, c string, l string, f boolean",
    )
    # a: shared by two mentions; b, c: one ambiguous mention says nothing, comments don't count; d: what a tag states
    assert values(clues.country_context(c, "id", "m", "s", "c", "l", "f"), "id", "context") == [("a", ["IT"]), ("d", ["SE"])]


def test_region_index_against_every_polygon(spark):
    import random

    from siftstone.operators import region_index

    rng = random.Random(6)
    shapes = []
    for k in range(40):
        x, y, n = rng.uniform(-185, 180), rng.uniform(-85, 80), rng.randrange(3, 9)
        ring = [[x + rng.uniform(2, 12) * math.cos(a), max(-89.9, min(89.9, y + rng.uniform(1, 6) * math.sin(a)))] for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]
        shapes.append((f"r{k}", [ring, [[x - 0.2, y - 0.2], [x + 0.2, y - 0.2], [x, y + 0.3]]]))
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(1500)] + [(9000, None, 1.0), (9001, 90.0, 180.0), (9002, -90.0, -180.0)]
    df = spark.createDataFrame(points + points[:5], "k int, lat double, lon double")
    polygons = spark.createDataFrame([(n, k, r) for k, (n, r) in enumerate(shapes)], "region string, place long, rings array<array<array<double>>>")
    for reach in (200.0, 900.0):
        want = values(places.region_of(df, "lat", "lon", shapes, reach_km=reach), "k", "region")
        assert values(region_index.regions_of(df, "lat", "lon", polygons, reach_km=reach), "k", "region") == want and len({r for _, r in want}) > 20
    assert {r["region"] for r in region_index.regions_of(df.limit(3), "lat", "lon", polygons.limit(0)).collect()} == {"Other"}


def test_regions_across_the_far_meridian(spark):
    east = [[[100.0, -10.0], [120.0, -10.0], [120.0, 10.0], [100.0, 10.0]]]
    dateline = [[[179.0, -10.0], [181.0, -10.0], [181.0, 10.0], [179.0, 10.0]]]
    points = spark.createDataFrame([(1, 30.0, -70.0), (2, 0.0, 121.0), (3, 0.0, -178.5), (4, 0.0, 178.2)], "k int, lat double, lon double")
    got = dict(values(places.region_of(points, "lat", "lon", [("east", east), ("dateline", dateline)]), "k", "region"))
    assert got == {1: "Other", 2: "east", 3: "dateline", 4: "dateline"}


def test_nearest_of_few_and_dense_points(spark):
    rows = [(k, 10 + k * 1e-4, 20.0) for k in range(300)] + [(1000, 10.0, 20.0), (2000, -60.0, -170.0), (3000, None, 1.0)]
    got = {r["k"]: r["isolation_km"] for r in places.kth_nearest_km(spark.createDataFrame(rows, "k int, lat double, lon double"), "k", "lat", "lon").collect()}
    assert len(got) == len(rows) and got[3000] is None and got[0] == got[1000] == pytest.approx(5e-4 * 111.195, rel=1e-3) and got[2000] > 5000
    few = places.kth_nearest_km(spark.createDataFrame(rows[:4], "k int, lat double, lon double"), "k", "lat", "lon")
    assert {r["isolation_km"] for r in few.collect()} == {None}


def most_rows(spark, run) -> int:
    """The most rows that any step of the queries within ``run`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    most = 0
    for at in range(before, store.executionsCount()):
        execution = store.executionsList().apply(at)
        kinds, texts = execution.metrics(), store.executionMetrics(execution.executionId())
        for m in (kinds.apply(i) for i in range(kinds.size())):
            if m.name() == "number of output rows" and texts.contains(m.accumulatorId()):
                most = max(most, int(texts.apply(m.accumulatorId()).split()[-1].replace(",", "")))
    return most


def test_lonely_points_do_not_meet_a_crowd(spark):
    crowd = [(k, 10 + k % 50 * 0.02, 20 + k // 50 * 0.02) for k in range(2000)]
    alone = [(10_000 + k, 60 + k % 20 * 1.4, -175 + k // 20 * 11.7) for k in range(600)]
    points = spark.createDataFrame(crowd + alone, "k int, lat double, lon double")
    found = []
    rows = most_rows(spark, lambda: found.extend(places.kth_nearest_km(points, "k", "lat", "lon").collect()))
    assert len(found) == 2600 and min(r["isolation_km"] for r in found) > 2
    assert rows < 200 * 2600  # the lonely points alone could make 1,200,000 pairs with the crowd


def test_nearest_across_pole_and_seam(spark):
    rows = [(k, 89.9, k * 60.0 - 180) for k in range(6)] + [(10 + k, 0.0, lon) for k, lon in enumerate((179.9, -179.9, 180.0, -180.0, 179.8, -179.8))]
    got = {r["k"]: r["isolation_km"] for r in places.kth_nearest_km(spark.createDataFrame(rows, "k int, lat double, lon double"), "k", "lat", "lon").collect()}
    degree = 3.141592653589793 * geo.EARTH_KM / 180
    assert all(got[k] == pytest.approx(0.2 * degree, rel=1e-6) for k in range(6))
    assert got[10] == pytest.approx(0.3 * degree, rel=1e-6) and got[14] == pytest.approx(0.4 * degree, rel=1e-6) and got[12] == pytest.approx(0.2 * degree, rel=1e-6)


def test_digests_tell_contents_apart(spark):
    rows = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "-"), (4, "-", None), (5, "1:a", None)], "k int, x string, y string")
    assert len({r["fingerprint"] for r in checks.fingerprint(rows, ["k"], ["x", "y"]).collect()}) == 5
    one, two = checks.table_fingerprint(rows, ["x", "y"]).first(), checks.table_fingerprint(rows.orderBy("y"), ["x", "y"]).first()
    assert one == two and one != checks.table_fingerprint(rows.limit(4), ["x", "y"]).first()
    with pytest.raises(checks.CheckFailed):
        checks.require_unchanged_rows(rows, rows.withColumn("x", F.lit("a")), ["k"], ["x"])
    checks.require_unchanged_rows(rows, rows.orderBy("y"), ["k"], ["x", "y"])


@pytest.mark.parametrize(
    ("url", "point"),
    [
        ("https://www.openstreetmap.org/?mlat=1.5&mlon=-2.5", (1.5, -2.5)), ("https://shop.example/x?lat=1.0&lon=2.0", (None, None)), ("https://maps.google.com/?lat=200&lon=1&q=1.5,2.5", (None, None)),
        ("https://maps.google.com/?q=1.5%2C2.5", (1.5, 2.5)), ("https://maps.google.com/maps/@-1.5,2.5,3z", (-1.5, 2.5)), ("https://www.openstreetmap.org/#map=5/1/2", (1.0, 2.0)), ("https://maps.google.com/?q=0.0,0.0&ll=3.5,4.5", (3.5, 4.5)), (None, (None, None)),
    ],
)
def test_points_in_links(spark, url, point):
    lat, lon = phrases.link_coordinates(F.lit(url).cast("string"))
    assert tuple(spark.range(1).select(lat, lon).first()) == point


def test_excerpts_tokens_and_texts(spark):
    row = spark.createDataFrame([("  \t" + "a" * 10 + " x\n\n", "Ｎew ß日本_9")], "a string, b string")
    assert row.select(text.excerpt(F.col("a"), F.lit(5), F.lit(6))).first()[0] == "a" * 10 + " x"
    assert [(t["token"], t["start"], t["stop"]) for t in row.select(text.folded_tokens("b")).first()[0]] == [("new", 0, 3), ("ss", 4, 5), ("日", 5, 6), ("本", 6, 7), ("9", 8, 9)]
    page = "<p>One&amp;<b>two</b><br>three<!-- no --><script>if (a<b) {}</script></p><div><a HREF='x&amp;y'>link</a><a>none</a></div><style>p{}</style>last\xa0 word"
    seen = spark.createDataFrame([(page,), (None,)], "h string").select(text.visible_text("h").alias("v")).collect()
    assert (seen[0]["v"]["text"], seen[0]["v"]["links"]) == ("One&two\nthree\n\nlinknone\nlast\xa0 word", ["x&y"]) and seen[1]["v"]["text"] == ""
    assert spark.range(1).select(text.utf16_parts(F.lit("😀" * 5 + "ab"), F.lit(3))).first()[0] == ["😀"] * 4 + ["😀a", "b"]
    assert spark.range(1).select(text.utf16_parts(F.lit(""), F.lit(3))).first()[0] == [""]


def test_clocks_and_localities(spark):
    from siftstone.operators import clues

    rows = spark.createDataFrame([("We left at around 10.30 am and ate by 1:15 p.m., at 7:00", False), ("seen near the old mill, by us. Then home", False), ("locality: Wood End!", True)], "t string, known boolean")
    got = rows.select(clues.clock_times(F.col("t")).alias("c"), clues.unlisted_locality(F.col("t"), F.col("known")).alias("l")).collect()
    assert got[0]["c"] == ["10.30 am", "1:15 p.m"] and got[1]["l"] == "the old mill, by us" and got[2]["l"] is None


def test_dates(spark):
    row = spark.range(1).select(
        dates.epoch_utc(F.lit("86400")).cast("string").alias("e"), dates.epoch_utc(F.lit("x")).alias("n"), dates.series_key(F.lit("2020-01-02"), F.lit(7)).alias("s"), dates.series_key(F.lit("2020-01"), F.lit(7)).alias("p"),
        dates.later(F.lit("2020-01-01").cast("timestamp"), F.lit("2020-01-02").cast("timestamp")).cast("string").alias("l"), dates.instant(F.lit("2020-01-01 10:00:00+02:00")).cast("string").alias("i"), dates.instant(F.lit("junk")).alias("j"),
    ).first()
    assert row["e"].startswith("1970-01-02") and row["n"] is None and (row["s"], row["p"]) == ("2020-01-02", "#7")
    assert row["l"] == "2020-01-02 00:00:00.000001" and row["i"] == "2020-01-01 08:00:00" and row["j"] is None


def test_small_helpers(spark):
    from siftstone.operators import clues

    df = spark.createDataFrame([(" Moth ", 1, 2), ("x", 1, 3), (None, 2, 2)], "l string, k int, v int")
    assert values(clues.fold_groups(df, "l", "g", ["moth"]), "l", "g") == sorted([(" Moth ", "moth"), ("x", "Other"), (None, "Other")], key=repr)
    pairs = df.withColumn("w", F.lit(5))
    assert values(evidence.single_pair(pairs, "k", "v", "w"), "k", "v", "w") == sorted([(1, None, None), (2, 2, 5)], key=repr)
    with pytest.raises(checks.CheckFailed):
        evidence.require_one_payload(df, "k", ["v"])
    rows = spark.createDataFrame([('{"_content": "a"}',), ('"b"',)], "j string").select(F.concat(F.lit('{"x":'), "j", F.lit("}")).alias("j"))
    assert [r[0] for r in rows.select(clues.text_or_content(F.col("j"), "$.x")).collect()] == ["a", "b"]
    one = spark.range(1).select(geo.ramp_colour(F.lit(0.5), (0, 0, 0), (255, 255, 255)), geo.ramp_colour(F.lit(None).cast("double"), (0, 0, 0), (1, 1, 1)), text.slug(F.lit("A b/c!"))).first()
    assert one[0] == "#808080" and one[1] == "#888888" and one[2].startswith("a-b-c-") and len(one[2]) == 16
    score = lambda *a: spark.range(1).select(clues.evidence_score(*map(F.lit, a))).first()[0]
    assert score("explicit_photo_locality", "description", True, True, "settlement", False) == 85 and score("title_place", "title", True, False, "settlement", True) == 72
    assert score("owner_comment_locality", "comment", True, False, "settlement", False) == 65 and score("comment_place_mention", "comment", False, False, "settlement", False) == 20
    assert score("title_place", "title", True, True, "country", False) == 30 and score("place_tag", "tag", True, False, "region", False) == 47 and score("map_link", "description", True, False, "point", False) == 140


def test_broken_updates(spark):
    before = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 1, 10), (3, "c", 1, 10)], "k int, fixed string, version int, at int")
    after = spark.createDataFrame([(1, "a", 2, 11), (2, "z", 2, 11), (4, "d", 1, 1)], "k int, fixed string, version int, at int")
    bad = {r["k"] for r in versioned.broken_updates(before, after, ["k"], ["fixed"], "version", "at").collect()}
    assert bad == {2, 3}


def test_saves_of_others_images(spark):
    reviews = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "image string, reviewer string")
    commands = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "image string, reviewer string")
    assert values(versioned.guarded(commands, reviews), "image", "reviewer", "blocked") == [("a", "x", False), ("a", "y", True), ("b", "x", False), ("c", "x", False)]


def test_latest_members_made_at_once(spark):
    """Of members alike in time and position the first review's counts, in whatever order they come."""
    for ids in ([3, 1, 2], [1, 2, 3], [2, 3, 1]):
        members = spark.createDataFrame([(7, 5, f"s{k}", 9, k) for k in ids] + [(7, 4, "s0", 9, 0)], "original_id long, position int, stamp string, made int, review long").coalesce(1)
        found = round_plans.with_latest_members(spark.createDataFrame([(7,)], "id long"), members, "review").collect()
        assert [tuple(r) for r in found] == [(7, 5, "s1")]


def test_closed_references(spark):
    """A page's title may end within a reference; of links and other texts all references are decoded."""
    page = "<title>a &amp;&amp</title>&am &amp;lt; &#233;&#xe9; &ltx &nosuch; &lt;<br>&ampamp;"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(text.closed_visible_text("h").alias("closed"), text.visible_text("h")["text"].alias("open")).collect()
    assert row[0]["closed"] == "a &&amp&am &lt; éé &ltx &nosuch; <\n&ampamp;" and row[1]["closed"] == ""
    assert row[0]["open"] == "a &&&am &lt; éé <x &nosuch; <\n&amp;"


def test_equal_polygons_and_groups(spark):
    """Of equal polygons the first counts, wherever its name stands in the alphabet, and one group measures many."""
    square = lambda x, y, r: [[[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r]]]
    shapes = spark.createDataFrame([(f"n{99 - k}", k, square(k % 20 * 10 - 95.0, 5.0, 2.3)) for k in range(60)], "region string, place long, rings array<array<array<double>>>")
    points = spark.createDataFrame([(k, 5.0 + k % 3, k % 20 * 10 - 95.0 + k % 2) for k in range(40)] + [(40, 80.0, 0.0)], "k long, lat double, lon double")
    found = region_index.regions_of(points, "lat", "lon", shapes, 50.0)
    assert sorted((r["k"], r["region"]) for r in found.collect()) == [(k, f"n{99 - k % 20}") for k in range(40)] + [(40, "Other")]
    assert "FlatMapCoGroupsInPandas [part" in found._jdf.queryExecution().executedPlan().toString()


def test_seek_in_ranges(spark):
    """Neighbours stand in other ranges than the anchor, and no window holds a whole batch of items."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges aren't put together
    try:
        items = spark.createDataFrame([(b, 10 * k) for b in (1, 2) for k in range(40)] + [(1, 390)], "b int, p int")
        anchors = spark.createDataFrame([(b, a) for b in (1, 2, 3) for a in (-7, 0, 5, 195, 200, 390, 999)], "b int, a int")
        out = progress.seek(items, anchors, ["b"], "p", "a")
        want = {-7: (0, 390), 0: (10, 390), 5: (10, 0), 195: (200, 190), 200: (210, 190), 390: (0, 380), 999: (0, 390)}
        assert {(r["b"], r["a"]): (r["next_position"], r["previous_position"]) for r in out.collect()} == {(b, a): w for b in (1, 2) for a, w in want.items()}
        assert "RangeFrame, 1, unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString()  # it would read the rest of a batch for each row
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_capacities_and_repeated_positions(spark):
    """Only texts with characters of two units go to Python; a repeated position may be allowed."""
    from siftstone.operators import workbook

    rows = spark.createDataFrame([("a" * 9, "x", ""), ("😀" * 5, None, ""), ("aa😀" * 2, "é" * 7, None)], "a string, b string, c string")
    assert tuple(workbook.capacities(rows, ["a", "b", "c"], 3).first()) == (5, 3, 1)
    seats = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 2), (3, 1), (4, 1), (4, 3), (5, None)], "g int, p int")
    assert [r["g"] for r in checks.not_contiguous(seats, ["g"], "p").orderBy("g").collect()] == [1, 2, 4, 5]
    assert [r["g"] for r in checks.not_contiguous(seats, ["g"], "p", repeats=True).orderBy("g").collect()] == [2, 4, 5]


def test_visible_text_has_its_links(spark, tmp_path):
    """A page's links are counted beside its text, as the reference gives both; text keeps blank lines, and a break has no end tag."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from siftstone.plans import catalog

    pages = [
        "<p>one <a href='/x y'>two</a>\t <a class=k href=z>three</a></p>\n\n<div>four\u00a0 five</br>six</div>", "<a name='n'>no</a> <a href=\"\">none</a><script>'<a href=\"s\">'</script><!-- <a href='c'> -->", "",
        "<A HREF=\"u\">up</A><br>&amp; <abbr href='q'>q</abbr>",
    ]
    pq.write_table(pa.table({"page_id": pa.array(range(4), pa.int64()), "url": pa.array(["u"] * 4), "html": pages}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["visible_text"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == con.sql(catalog.ORACLES["visible_text"] + " ORDER BY 1").fetchall()
    assert [r[2] for r in got] == [2, 0, 0, 1] and got[0][1] == "one two three\n\n\n\nfour\u00a0 fivesix"
