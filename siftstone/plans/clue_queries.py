"""Queries over the clue analysis and the dictionary of place names.

Orders are photos and customers' groups their owners; parts' names are settlements and regions
countries.  A photo's texts are put together of these names, in twelve ways.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clue_chain, clue_tables, clues, gazetteer, staging, workbook
from .registry import long, query

#: Parts that every size of the tables has.
PARTS = 200


def _name(c: str) -> Column:
    return F.initcap(c)


def _places(t) -> DataFrame:
    lands = t("region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("place"), _name("r_name").alias("name"), F.lit("country").alias("level"), F.col("r_regionkey").alias("land"))
    towns = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("first")).select(F.concat(F.lit("P"), F.col("first")).alias("place"), _name("p_name").alias("name"), F.lit("settlement").alias("level"), (F.col("first") % 5).cast("int").alias("land"))
    both = lands.unionByName(towns)
    at = F.when(F.col("level") == "settlement", F.col("land") * 10.0 + 0.5)
    return both.select("place", "name", "level", F.concat(F.lit("L"), F.col("land")).alias("country"), at.alias("latitude"), (at * 2).alias("longitude"))


def _known(t) -> DataFrame:
    places = _places(t)
    names = places.select("place", "name", F.lit(True).alias("canonical"))
    return gazetteer.dictionary(gazetteer.admitted(names, places), places)


def _photos(t) -> DataFrame:
    town = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    part = t("part").filter(F.col("p_partkey") < PARTS).join(town, "p_name").select("p_partkey", _name("p_name").alias("town"), (F.col("first") % 5).alias("land"))
    region = t("region").select("r_regionkey", _name("r_name").alias("region"))
    o = t("orders").select(F.col("o_orderkey").alias("photo"), (F.col("o_custkey") % 50).cast("string").alias("owner"), F.col("o_orderdate"), (F.col("o_orderkey") % 12).alias("k"), (F.col("o_orderkey") % PARTS).alias("__part")).repartition("photo")
    rows = o.join(F.broadcast(part), F.col("__part") == F.col("p_partkey"))  # a row for each of PARTS
    rows = rows.join(F.broadcast(region), F.when(F.col("k") == 2, F.col("land")).otherwise(F.col("photo") % 5) == F.col("r_regionkey"))  # five rows
    none, no = F.lit(None).cast("string"), F.lit("")
    k, a, b = F.col("k"), (F.col("photo") % 80 + 1).cast("string"), (F.col("photo") % 170).cast("string")
    said = lambda *forms: reduce(lambda out, f: F.when(k == f[0], F.concat(*[F.lit(x) if isinstance(x, str) else x for x in f[1:]])).otherwise(out), forms, none)
    title = said((0, "Taken in ", F.col("town")), (1, F.col("town")), (2, F.col("town")))
    text = said(
        (3, "Somewhere, lat: ", a, ".5, lon: ", b, ".25"), (4, "<p>see the <a href='https://maps.google.com/?q=", a, ".5,", b, ".5'>map</a></p>"), (9, "This is native to ", F.col("region")),
        (10, "The train left at 10:30 am"), (11, "found near the old mill by the river"),
    )
    comment = said((5, "seen in ", F.col("town"), " two hours later"), (6, "Where is this, ", F.col("town"), "?"))
    author = F.when(k == 5, F.col("owner")).otherwise("someone")
    kinds = {"comments": "array<struct<id: string, author: string, at: string, text: string>>", "tags": "array<struct<raw: string, author: string>>"}
    comments = F.when(comment.isNotNull(), F.array(F.struct(F.lit("c").alias("id"), author.alias("author"), none.alias("at"), comment.alias("text"))))
    tags = F.when(k == 2, F.array(F.struct(F.concat(F.lit("geo:country="), F.col("region")).alias("raw"), F.col("owner").alias("author"))))
    minutes = F.col("photo") * 7 % 1440
    return rows.select(
        "photo", "owner", F.array(title, title).alias("titles"), F.array(none, text).alias("descriptions"), tags.cast(kinds["tags"]).alias("tags"),
        F.when(k == 7, F.concat(F.lit("geo:lat="), a, F.lit(" geo:lon="), b)).otherwise(no).alias("raw_tags"), none.alias("machine_tags"), comments.cast(kinds["comments"]).alias("comments"),
        F.when(k == 8, F.col("region")).alias("profile"), F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + minutes * 60), "yyyy-MM-dd HH:mm:ss").alias("taken"),
        F.lit(False).alias("unknown"), F.lit(0).alias("granularity"), (F.col("photo") % 80 + 0.5).cast("double").alias("latitude"), (F.col("photo") % 170 + 0.5).cast("double").alias("longitude"),
    )


def _analysis(t) -> clue_chain.Analysis:
    photos = staging.staged(_photos(t))
    provider = photos.filter(F.col("photo") % 97 == 0).select("photo", "latitude", "longitude")
    return clue_chain.analyse(photos, photos.filter(F.col("photo") % 10 == 0), provider, _known(t))


#: What SQL makes of the same photos.
SUMMARY = """
    s AS (SELECT o_orderkey AS photo, o_custkey % 50 AS owner, o_orderkey % 12 AS k, o_orderkey % 97 = 0 AS told, o_orderkey * 7 % 1440 AS m, epoch(o_orderdate) + (o_orderkey * 7 % 1440) * 60 AS at FROM orders),
    an AS (SELECT * FROM s WHERE m <> 0 AND (told OR photo % 10 = 0 OR k = 7)),
    pr AS (SELECT t.photo, a.photo AS anchor, t.at - a.at AS d FROM s t JOIN an a ON a.owner = t.owner AND a.photo <> t.photo AND a.at BETWEEN t.at - 86400 AND t.at + 86400 WHERE t.m <> 0),
    nb AS (SELECT photo, abs(d) <= 3600 AS hour, sign(d) AS side, count(*) AS anchors FROM pr GROUP BY ALL),
    np AS (SELECT photo, count(*) FILTER (hour) AS hour_neighbours, count(*) FILTER (hour AND side > 0) AS hour_before, count(*) FILTER (hour AND side < 0) AS hour_after, count(*) AS neighbours FROM nb GROUP BY photo),
    c AS (SELECT s.photo, k, told, CAST(k IN (5, 6) AS BIGINT) AS comments, CAST(k IN (3, 4) AS BIGINT) AS text_points, CAST(CASE WHEN k IN (0, 5) THEN 1 WHEN k = 2 THEN 2 ELSE 0 END AS BIGINT) AS captures,
                 CAST(CASE k WHEN 2 THEN 2 WHEN 10 THEN 0 ELSE 1 END + CAST(told AS INT) AS BIGINT) AS evidence, CAST(CASE WHEN k IN (0, 1, 3, 4, 5, 11) THEN 1 WHEN k = 2 THEN 2 ELSE 0 END AS BIGINT) AS photo_text,
                 CAST(k = 5 AS BIGINT) AS owner_comment, CAST(k = 6 AS BIGINT) AS other_comment, CAST(k = 8 AS BIGINT) AS profile, CAST(k IN (5, 10) AS BIGINT) AS relative_times,
                 CAST(0 AS BIGINT) AS travel_timings, CAST(k = 10 AS BIGINT) AS clock_times,
                 coalesce(hour_neighbours, 0) AS hour_neighbours, coalesce(hour_before, 0) AS hour_before, coalesce(hour_after, 0) AS hour_after, coalesce(neighbours, 0) AS neighbours
          FROM s LEFT JOIN np USING (photo)),
    summary AS (SELECT *, CASE WHEN told THEN 'provider_coordinates' WHEN k = 7 THEN 'machine_tags' WHEN text_points > 0 THEN 'text_coordinates' WHEN captures > 0 THEN 'named_capture' WHEN hour_neighbours > 0 THEN 'hour_neighbour'
          WHEN photo_text > 0 THEN 'other_mention' WHEN neighbours > 0 THEN 'day_neighbour' WHEN relative_times > 0 THEN 'relative_time' WHEN profile > 0 THEN 'profile_only' ELSE 'none' END AS status FROM c)
"""
COLUMNS = ["photo", "comments", "text_points", "captures", "evidence", "photo_text", "owner_comment", "other_comment", "profile", "relative_times", "clock_times", "hour_neighbours", "hour_before", "hour_after", "neighbours", "status"]


@query(f"WITH {SUMMARY} SELECT {', '.join(COLUMNS)} FROM summary")
def clue_summary(t):
    """From raw photo rows: counts of each photo's clues, and its status."""
    return _analysis(t).summary.select(*COLUMNS)


_HELD = {
    "with_provider_point": "told", "with_machine_point": "k = 7", "with_named_capture": "captures > 0", "with_photo_text": "photo_text > 0", "with_owner_comment": "owner_comment > 0", "with_other_comment": "other_comment > 0",
    "with_relative_time": "relative_times > 0", "with_hour_neighbour": "hour_neighbours > 0", "with_hour_before": "hour_before > 0", "with_hour_after": "hour_after > 0", "with_day_neighbour": "neighbours > 0",
    "with_text_point": "text_points > 0", "with_travel_timing": "false", "with_stage_timing": "false", "with_clock_time": "clock_times > 0",
}


@query(f"""
    WITH {SUMMARY}
    SELECT count(*) AS photos, CAST(sum(comments) AS BIGINT) AS comments, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _HELD.items())}, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in (*clues.STATUSES, "none"))}
    FROM summary
""")
def clue_run_counts(t):
    """The seventeen counts of a run, and how many photos have each status."""
    return clue_chain.run_report(_analysis(t).summary)


@query(f"""
    WITH {SUMMARY},
    e AS (SELECT photo, unnest(CASE k
        WHEN 0 THEN [{{s: 'title', k: 'explicit_photo_locality', c: true, f: 'gazetteer_center_not_photo_coordinate'}}]
        WHEN 1 THEN [{{s: 'title', k: 'title_place', c: false, f: 'gazetteer_center_not_photo_coordinate,settlement_lacks_country_or_capture_context'}}]
        WHEN 2 THEN [{{s: 'title', k: 'title_place', c: true, f: 'gazetteer_center_not_photo_coordinate'}}, {{s: 'tag', k: 'place_tag', c: true, f: ''}}]
        WHEN 3 THEN [{{s: 'description', k: 'labelled_decimal', c: false, f: 'text_coordinate_reference_requires_review'}}]
        WHEN 4 THEN [{{s: 'description', k: 'map_link', c: false, f: 'map_query_or_center_not_verified_photo_coordinate'}}]
        WHEN 5 THEN [{{s: 'comment', k: 'owner_comment_locality', c: true, f: 'gazetteer_center_not_photo_coordinate'}}]
        WHEN 6 THEN [{{s: 'comment', k: 'location_question', c: false, f: 'location_question_not_assertion,third_party_comment,gazetteer_center_not_photo_coordinate'}}]
        WHEN 7 THEN [{{s: 'raw_machine_tags', k: 'machine_tag_coordinates', c: false, f: 'source_coordinate_not_independently_verified'}}]
        WHEN 8 THEN [{{s: 'owner_profile', k: 'owner_profile_place', c: false, f: 'owner_home_not_photo_location'}}]
        WHEN 9 THEN [{{s: 'description', k: 'distribution_place', c: false, f: 'biogeographic_distribution_context'}}]
        WHEN 11 THEN [{{s: 'description', k: 'unresolved_locality_phrase', c: false, f: 'uncatalogued_locality_requires_review'}}]
        ELSE [] END, recursive := true) FROM s
        UNION ALL SELECT photo, 'provider_metadata', 'provider_coordinates', false, 'source_coordinate_not_independently_verified' FROM s WHERE told)
    SELECT photo, s AS source, k AS kind, c AS capture, f AS flags, CAST(1 AS BIGINT) AS occurrence_count FROM e
""")
def clue_evidence(t):
    """Every piece of evidence with its kind, flags, and whether it may name where the photo was taken."""
    found = _analysis(t).evidence
    return found.select("photo", "source", "kind", "capture", F.array_join("flags", ",").alias("flags"), long("occurrence_count").alias("occurrence_count"))


@query(f"""
    WITH {SUMMARY},
    town AS (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1),
    pt AS (SELECT p_partkey, 'P' || first AS place, first % 5 AS land, p_name FROM part JOIN town USING (p_name) WHERE p_partkey < {PARTS}),
    g AS (SELECT s.*, pt.* FROM s JOIN pt ON p_partkey = photo % {PARTS})
    SELECT photo, 'gazetteer_place_reference' AS method, place, 'settlement' AS level, land * 10 + CAST(0.5 AS DOUBLE) AS latitude, land * 20 + CAST(1 AS DOUBLE) AS longitude, CAST(1 AS BIGINT) AS candidates,
           'provisional_not_human_georeferenced' AS flags, CASE k WHEN 0 THEN 'Taken in ' WHEN 5 THEN 'seen in ' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || CASE WHEN k = 5 THEN ' two hours later' ELSE '' END AS excerpts
    FROM g WHERE k IN (0, 1, 2, 5) AND NOT told
    UNION ALL
    SELECT photo, 'text_coordinate_reference', format('{{:.6f}},{{:.6f}}', lat, lon), 'point', lat, lon, 1, 'provisional_not_human_georeferenced,country_not_resolved', NULL
    FROM (SELECT photo, photo % 80 + 1 + CASE WHEN k = 7 THEN CAST(0 AS DOUBLE) ELSE 0.5 END AS lat, photo % 170 + CASE k WHEN 3 THEN 0.25 WHEN 4 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS lon FROM s WHERE k IN (3, 4, 7) AND NOT told)
""")
def provisional_details(t):
    """A provisional place with its method, candidates, flags and excerpts, for photos without the provider's point."""
    found = _analysis(t).evidence
    told = found.filter("kind = 'provider_coordinates'").select("photo")
    out = clue_chain.provisional_places(found.join(told, "photo", "left_anti"), _places(t))
    text = F.when(F.col("method") != "text_coordinate_reference", F.array_join("excerpts", "|"))
    return out.select("photo", "method", "place", "level", "latitude", "longitude", "candidates", F.array_join("flags", ",").alias("flags"), text.alias("excerpts"))


@query(f"""
    WITH {SUMMARY},
    p AS (SELECT *, told OR k = 7 OR text_points > 0 OR captures > 0 OR hour_neighbours > 0 AS priority FROM summary)
    SELECT photo, CASE WHEN priority THEN 'priority' WHEN status = 'profile_only' THEN 'profile_only' WHEN status = 'none' THEN 'none' ELSE 'other' END AS sheet,
           concat_ws(' | ', 'status: ' || status, CASE WHEN text_points > 0 THEN 'points: ' || text_points END, CASE WHEN captures > 0 THEN 'named: ' || captures END) AS hint
    FROM p
""")
def location_workbook(t):
    """Every photo in one of four sheets, with a line that sums up its hints."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    sheets = workbook.location_sheets(_analysis(t).summary, "status", ["provider_latitude", "machine_latitude", "text_points", "captures", "hour_neighbours"], "photo")
    return sheets.select("photo", "sheet", clue_tables.hint({"status": F.col("status"), "points": some("text_points"), "named": some("captures")}).alias("hint"))


@query(f"""
    WITH {SUMMARY}, v(rule, rows) AS (VALUES ('photos without a summary', (SELECT count(*) FROM s WHERE k = 1)), ('summaries without a photo', (SELECT count(*) FROM s WHERE k = 2)), ('photos with several summaries', 0),
    ('evidence without a photo', (SELECT sum(evidence) FROM summary WHERE k = 2)), ('evidence of unknown kind', (SELECT count(*) FROM s WHERE k = 8)), ('neighbours without a photo', (SELECT count(*) FROM nb JOIN s USING (photo) WHERE k = 2)),
    ('neighbours outside their window', (SELECT count(*) FROM nb WHERE NOT hour)), ('repeated neighbours', 0))
    SELECT rule, CAST(rows AS BIGINT) AS rows FROM v
""")
def output_validator(t):
    """How many rows break each rule of an analysis, zeros included; some are broken here on purpose."""
    a = _analysis(t)
    k = F.col("photo") % 12
    # Photos of one kind are missing, and summaries of another; all neighbours claim to be near; one kind of evidence isn't known.
    near = a.neighbours.select("photo", F.when(F.abs("minutes") <= 60, clue_tables.HOUR).otherwise("within_10_minutes").alias("time_window"), "relation", "minutes")
    near = near.withColumn("minutes", F.when(F.col("time_window") == clue_tables.HOUR, F.col("minutes")).otherwise(2000.0))
    known = [*clues.ELIGIBLE, *clues.ASIDE, *clues.COORDINATES, "unresolved_locality_phrase", "comment_place_mention", "third_party_comment_locality", "description_place_mention"]
    return clue_tables.violations(_photos(t).filter(k != 2).select("photo"), a.summary.filter(k != 1).select("photo"), a.evidence, near, "photo", known)


# --- names of places -----------------------------------------------------------------


@query(r"""
    WITH towns AS (SELECT 'P' || min(p_partkey) AS place, p_name FROM part GROUP BY p_name),
    names AS (
        SELECT 'R' || r_regionkey AS place, 'country' AS level, r_name AS name, true AS canonical FROM region
        UNION ALL SELECT 'N' || n_nationkey, 'region', n_name, true FROM nation
        UNION ALL SELECT place, 'settlement', p_name, true FROM towns
        UNION ALL SELECT place, 'settlement', string_split(p_name, ' ')[2], false FROM towns
        UNION ALL SELECT place, 'settlement', 'Old ' || p_name || ' National Park', false FROM towns
        UNION ALL SELECT place, 'settlement', 'National  PARK', false FROM towns
        UNION ALL SELECT DISTINCT 'P' || min(p_partkey) OVER (PARTITION BY p_name), 'settlement', p_type, false FROM part
        UNION ALL SELECT 'C' || c_custkey, 'settlement', c_name || ' ' || c_mktsegment, true FROM customer
        UNION ALL SELECT 'C' || c_custkey, 'settlement', c_mktsegment, false FROM customer
    ),
    tok AS (SELECT place, level, canonical, list_transform(regexp_extract_all(name, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM names),
    ok AS (SELECT place, canonical, array_to_string(w, ' ') AS phrase, len(w) AS n FROM tok
           WHERE len(w) BETWEEN 1 AND 12 AND len(list_filter(w, lambda x: regexp_full_match(x, '\d+'))) = 0 AND NOT (len(w) = 2 AND w[1] = 'national' AND w[2] = 'park')
                 AND NOT (len(w) = 1 AND level <> 'country' AND (length(w[1]) < 4 OR w[1] IN ('anvil', 'plate'))))
    SELECT phrase, CAST(n AS BIGINT) AS n, count(DISTINCT place) AS places, count(DISTINCT place) FILTER (canonical) AS canonical FROM ok GROUP BY ALL
""")
def gazetteer_names(t):
    """The names that may stand for places, each rule met, with the number of places that each may mean."""
    towns = t("part").groupBy("p_name").agg(F.concat(F.lit("P"), F.min("p_partkey")).alias("place"))
    types = t("part").select("p_name", "p_type").distinct().join(towns, "p_name")
    people = F.concat(F.lit("C"), F.col("c_custkey"))
    parts = [
        (t("region"), F.concat(F.lit("R"), F.col("r_regionkey")), "country", F.col("r_name"), True),
        (t("nation"), F.concat(F.lit("N"), F.col("n_nationkey")), "region", F.col("n_name"), True),
        (towns, F.col("place"), "settlement", F.col("p_name"), True),
        (towns, F.col("place"), "settlement", F.split("p_name", " ")[1], False),
        (towns, F.col("place"), "settlement", F.concat(F.lit("Old "), F.col("p_name"), F.lit(" National Park")), False),
        (towns, F.col("place"), "settlement", F.lit("National  PARK"), False),
        (types, F.col("place"), "settlement", F.col("p_type"), False),
        (t("customer"), people, "settlement", F.concat_ws(" ", "c_name", "c_mktsegment"), True),
        (t("customer"), people, "settlement", F.col("c_mktsegment"), False),
    ]
    rows = [df.select(p.alias("place"), F.lit(level).alias("level"), n.alias("name"), F.lit(c).alias("canonical")) for df, p, level, n, c in parts]
    names = reduce(DataFrame.unionByName, rows)
    common = names.sparkSession.createDataFrame([("anvil",), ("plate",)], "word string")
    found = gazetteer.admitted(names, names.select("place", "level").distinct(), common)
    return found.groupBy("phrase", long("n").alias("n")).agg(F.countDistinct("place").alias("places"), F.countDistinct(F.when(F.col("canonical"), F.col("place"))).alias("canonical"))
