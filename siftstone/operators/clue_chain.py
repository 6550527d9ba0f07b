"""The analysis of location clues, from raw photo rows to its four tables.

One typed record of evidence runs through all steps: text units are looked through for names
of places, coordinates, links to maps, localities and times; mentions are classified in the
light of what the unit and the photo speak of; equal records become one with their number;
neighbours in time come from photos of the same owner whose place is known; a summary for
each photo counts all this and takes a status.  Kinds, sources and flags are those of
:mod:`clues`, in every step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, geo, phrases
from ..functions.text import visible_text
from . import clues, evidence, timeline
from .checks import duplicates, require_none
from .gazetteer import found_phrases
from .staging import staged

#: What is told of each text unit, and of evidence that stands in it.
ORIGIN = ["source", "field", "by_owner", "comment_id", "comment_author", "comment_at"]
RECORD = ["photo", *ORIGIN, "kind", "matched", "excerpt", "candidates", "flags", "capture"]
CANDIDATE = "array<struct<place: string, level: string, country: string, latitude: double, longitude: double>>"
#: Flags of evidence that isn't a mention, and characters of a link's excerpt.
UNLISTED_FLAG = "uncatalogued_locality_requires_review"
COORDINATE_FLAG = "text_coordinate_reference_requires_review"
LINK_FLAG = "map_query_or_center_not_verified_photo_coordinate"
POINT_FLAG = "source_coordinate_not_independently_verified"
LINK_EXCERPT = 350
#: Sources of texts about the photo itself.
PHOTO_TEXT = ("title", "description", "tag", "comment")
#: The counts of a run, in the order in which it reports them.
COUNTS = (
    "photos", "comments", "with_provider_point", "with_machine_point", "with_named_capture", "with_photo_text", "with_owner_comment", "with_other_comment", "with_relative_time",
    "with_hour_neighbour", "with_hour_before", "with_hour_after", "with_day_neighbour", "with_text_point", "with_travel_timing", "with_stage_timing", "with_clock_time",
)


class Analysis(NamedTuple):
    """The four tables, each with the key ``photo``."""

    summary: DataFrame
    evidence: DataFrame
    times: DataFrame
    neighbours: DataFrame


def text_units(photos: DataFrame) -> DataFrame:
    """The texts of each photo: (``photo``, ``unit``, the columns of ``ORIGIN``, ``text``, ``links``).

    ``photos``: ``photo``, ``owner``, ``titles`` and ``descriptions`` (arrays: current, raw),
    ``tags`` (array of ``raw``, ``author``), ``raw_tags`` (parted by blanks), ``comments``
    (array of ``id``, ``author``, ``at``, ``text``) and ``profile``.  HTML gives its visible
    text and links.  A raw title or description that says the same as the current one, and
    repeated tags, are left out, as are texts that are empty, and tags such as
    ``camera:iso=100`` that aren't about a place.
    """
    none = F.lit(None).cast("string")

    def unit(number: Column, source: str, field: str, by_owner: Column, raw: Column, id_: Column = none, author: Column = none, at: Column = none, current: Column = none) -> Column:
        parts = {"unit": number, "source": F.lit(source), "field": F.lit(field), "by_owner": by_owner, "comment_id": id_, "comment_author": author, "comment_at": at, "raw": raw, "current": current}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    own = F.lit(True)
    listed = lambda n: F.lit(n).cast("long")
    fixed = F.array(
        unit(listed(0), "title", "current_title", own, F.get("titles", 0)), unit(listed(1), "title", "raw_title", own, F.get("titles", 1), current=F.get("titles", 0)),
        unit(listed(2), "description", "current_description", own, F.get("descriptions", 0)), unit(listed(3), "description", "raw_description", own, F.get("descriptions", 1), current=F.get("descriptions", 0)),
        unit(listed(4), "owner_profile", "profile", own, F.col("profile")),
    )
    said = F.transform(
        "comments", lambda c, k: unit(k.cast("long") + 5, "comment", "comments", F.coalesce(c["author"] == F.col("owner"), F.lit(False)), c["text"], c["id"], c["author"], c["at"])
    )
    rows = photos.select("photo", F.explode(F.concat(fixed, F.coalesce(said, F.slice(fixed, 1, 0)))).alias("u")).select("photo", "u.*")
    # A tag's first occurrence counts; tags that came with an author stand before bare ones.
    bare = F.transform(F.split(F.coalesce("raw_tags", F.lit("")), r"\s+"), lambda t: F.struct(t.alias("raw"), none.alias("author")))
    both = F.concat(F.coalesce(F.transform("tags", lambda t: F.struct(t["raw"].alias("raw"), t["author"].alias("author"))), F.slice(bare, 1, 0)), bare)
    tags = photos.select("photo", "owner", F.posexplode(both).alias("at", "t")).filter("t.raw IS NOT NULL AND t.raw <> ''")
    tags = tags.groupBy("photo", F.col("t.raw").alias("raw")).agg(F.min(F.struct("at", "t.author", "owner")).alias("m"))
    data = F.col("raw").contains(":") & F.col("raw").contains("=") & ~F.lower("raw").startswith("geo")
    author = F.col("m.author")
    of_tags = tags.filter(~data).select("photo", unit(-1 - F.col("m.at").cast("long"), "tag", "tags", F.when(author != "", author == F.col("m.owner")), F.col("raw"), none, author).alias("u"))
    rows = rows.unionByName(of_tags.select("photo", "u.*")).filter("raw IS NOT NULL AND raw <> '' AND (current IS NULL OR raw <> current)")
    rows = rows.withColumns({"seen": visible_text("raw"), "again": visible_text("current")})
    # A profile's location is plain text.
    rows = rows.withColumn("text", F.when(F.col("source") == "owner_profile", F.col("raw")).otherwise(F.col("seen.text"))).filter("text <> '' AND (current IS NULL OR text <> again.text)")
    return rows.select("photo", "unit", *ORIGIN, "text", F.when(F.col("source") == "owner_profile", F.slice("seen.links", 1, 0)).otherwise(F.col("seen.links")).alias("links"))


def _read(units: DataFrame, known: DataFrame) -> DataFrame:
    """``units`` with all that is found in each: ``hits``, ``said`` of them, ``points``, ``places`` (unlisted), ``times``, ``clocks``."""
    hits = found_phrases(units, ["photo", "unit"], F.col("text"), known)
    rows = units.join(hits, ["photo", "unit"], "left").withColumn("hits", F.coalesce("hits", F.expr("array()").cast(hits.schema["hits"].dataType)))
    return rows.withColumns({
        "said": phrases.mention_signals("text", F.col("hits.start"), F.col("hits.stop")),
        "points": phrases.text_coordinates("text"),
        "unlisted": phrases.locality_phrases("text"),
        "times": phrases.relative_times("text"),
        "clocks": phrases.clock_phrases("text"),
    })


def _certain(hits: Column) -> Column:
    """Countries that a unit names for certain."""

    def of(h: Column) -> Column:
        own = F.filter(h["places"], lambda p: p["canonical"])
        one = F.size(F.array_distinct(F.transform(own, lambda p: p["country"]))) == 1
        lands = F.transform(F.filter(own, lambda p: p["level"] == "country"), lambda p: p["country"])
        return F.when(one, lands).otherwise(F.slice(lands, 1, 0))

    return F.array_distinct(F.flatten(F.transform(hits, of)))


def _context(read: DataFrame) -> DataFrame:
    """(``photo``, ``context``): the countries that a photo's tags and titles speak of."""
    rows = read.filter(F.col("source").isin("tag", "title")).select("photo", "unit", "source", "text", F.explode("hits").alias("h"))
    rows = rows.select("photo", F.struct("unit", "h.at").alias("mention"), "source", F.lower("text").startswith("geo:country=").alias("forced"), F.explode("h.places").alias("p"))
    rows = rows.filter("p.canonical").select("photo", "mention", "source", F.col("p.country").alias("country"), F.col("p.level").alias("level"), (F.col("forced") & (F.col("source") == "tag")).alias("forced"))
    return clues.country_context(rows, "photo", "mention", "source", "country", "level", "forced")


def _point(lat: Column, lon: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("place"), F.lit("point").alias("level"), F.lit(None).cast("string").alias("country"), lat.alias("latitude"), lon.alias("longitude"))).cast(CANDIDATE)


def _record(rows: DataFrame, kind: Column, matched: Column, excerpt: Column, candidates: Column, flag: str) -> DataFrame:
    return rows.select("photo", *ORIGIN, kind.alias("kind"), matched.alias("matched"), excerpt.alias("excerpt"), candidates.alias("candidates"), F.array(F.lit(flag)).alias("flags"), F.lit(False).alias("capture"))


def _mentions(read: DataFrame) -> DataFrame:
    rows = read.filter(F.size("hits") > 0).withColumn("local", _certain(F.col("hits")))
    rows = rows.select("photo", *ORIGIN, F.when(F.col("source") == "tag", F.col("text")).alias("text"), "local", F.explode(F.arrays_zip("hits", "said")).alias("m"))
    rows = rows.select("photo", *ORIGIN, "text", "local", F.col("m.hits.places").alias("places"), F.col("m.said").alias("said"))
    rows = rows.join(_context(read), "photo", "left").withColumn("context", F.coalesce("context", F.expr("CAST(array() AS ARRAY<STRING>)")))
    found = clues.kinds(rows)
    left = F.transform("resolved", lambda p: F.struct(p["place"].cast("string").alias("place"), p["level"].alias("level"), p["country"].alias("country"), p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))
    return found.select("photo", *ORIGIN, "kind", "matched", "excerpt", left.cast(CANDIDATE).alias("candidates"), "flags", F.col("eligible").alias("capture"))


def _evidence(read: DataFrame, photos: DataFrame, provider: DataFrame) -> DataFrame:
    nowhere = F.expr("array()").cast(CANDIDATE)
    public = read.filter("source <> 'owner_profile'")
    unlisted = public.filter(F.size("hits") == 0).select("photo", *ORIGIN, F.explode("unlisted").alias("l"))
    written = public.select("photo", *ORIGIN, F.explode("points").alias("p"))
    linked = public.select("photo", *ORIGIN, "text", F.explode("links").alias("url")).withColumn("p", phrases.link_points("url")).filter("p.lat IS NOT NULL")
    blank = {c: F.lit(None).cast("string") for c in ("comment_id", "comment_author", "comment_at")} | {"by_owner": F.lit(None).cast("boolean")}
    tagged = _machine_points(photos).filter("lat IS NOT NULL").withColumns(blank | {"source": F.lit("raw_machine_tags"), "field": F.lit("tags")})
    told = provider.withColumns(blank | {"source": F.lit("provider_metadata"), "field": F.lit("location")})
    parts = [
        _mentions(read),
        _record(unlisted, F.lit("unresolved_locality_phrase"), F.col("l.locality"), F.col("l.excerpt"), nowhere, UNLISTED_FLAG),
        _record(written, F.col("p.kind"), F.col("p.text"), F.col("p.excerpt"), _point(F.col("p.lat"), F.col("p.lon")), COORDINATE_FLAG),
        _record(linked, F.lit("map_link"), F.col("url"), F.substring("text", 1, LINK_EXCERPT), _point(F.col("p.lat"), F.col("p.lon")), LINK_FLAG),
        _record(tagged, F.lit("machine_tag_coordinates"), F.to_json(F.struct("lat", "lon")), F.to_json(F.struct("lat", "lon")), _point(F.col("lat"), F.col("lon")), POINT_FLAG),
        _record(told, F.lit("provider_coordinates"), F.to_json(F.struct("latitude", "longitude")), F.to_json(F.struct("latitude", "longitude")), _point(F.col("latitude"), F.col("longitude")), POINT_FLAG),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # dealt by photo, so that what follows needs no further shuffle
    out = out.repartition("photo").withColumn("candidate_count", F.size("candidates").cast("long"))
    return evidence.dedup(out, [*RECORD, "candidate_count"])


def _machine_points(photos: DataFrame) -> DataFrame:
    raw = F.array_join(F.transform("tags", lambda t: F.coalesce(t["raw"], F.lit(""))), "\n")
    return photos.select("photo", phrases.tag_points(raw, F.col("machine_tags"), F.col("raw_tags")).alias("p")).select("photo", "p.lat", "p.lon")


def _times(read: DataFrame) -> DataFrame:
    public = read.filter("source <> 'owner_profile'")
    basis = F.when(F.col("source") == "comment", "comment_narrative_reference_unresolved").otherwise("photo_narrative_reference_unresolved")
    spans = public.select("photo", *ORIGIN, basis.alias("basis"), F.explode("times").alias("t")).select("photo", *ORIGIN, "basis", "t.expression", "t.minutes", "t.relation", "t.narrative", "t.excerpt")
    clocks = public.select("photo", *ORIGIN, F.lit("clock_time_in_text_timezone_unresolved").alias("basis"), F.explode("clocks").alias("t"))
    nothing = [F.lit(None).cast("double").alias("minutes"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("narrative")]
    return spans.unionByName(clocks.select("photo", *ORIGIN, "basis", F.col("t.expression").alias("expression"), *nothing, F.col("t.excerpt").alias("excerpt")))


def anchors(photos: DataFrame, located: DataFrame, provider: DataFrame) -> DataFrame:
    """Photos whose place and exact time are known: (``photo``, ``owner``, ``at``, ``latitude``, ``longitude``, ``method``).

    The place is the provider's, else the one that ``located`` (photos that were found by
    place) gives, else that of the tags.  Of a photo in both tables the row of ``located``
    counts, if it has all of these.
    """
    ids = located.select("photo").distinct().withColumn("listed", F.lit(True))

    def of(rows: DataFrame) -> DataFrame:
        told = provider.select("photo", F.struct("latitude", "longitude").alias("told"))
        tagged = _machine_points(rows).select("photo", F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))).alias("tagged")).dropDuplicates(["photo"])
        wide = rows.join(ids, "photo", "left").join(told, "photo", "left").join(tagged, "photo", "left")
        found = F.when(F.col("listed") & geo.valid_point(F.col("latitude"), F.col("longitude")), F.struct("latitude", "longitude"))
        method = evidence.ladder(("provider_location", F.col("told").isNotNull()), ("search_geotag", found.isNotNull()), otherwise="machine_tags")
        point = F.coalesce("told", found, "tagged")
        out = wide.select("photo", "owner", dates.capture_time(F.col("taken"), F.col("unknown"), F.col("granularity")).alias("at"), point.alias("p"), method.alias("method"))
        return out.filter("p IS NOT NULL AND at IS NOT NULL AND owner IS NOT NULL").select("photo", "owner", "at", "p.latitude", "p.longitude", "method")

    return timeline.first_source([of(located), of(photos)], "photo", ["at"]).drop("source_rank")


def analyse(photos: DataFrame, located: DataFrame, provider: DataFrame, known: DataFrame) -> Analysis:
    """All four tables.

    ``photos``: what :func:`text_units` reads, and ``machine_tags`` (text), ``taken``,
    ``unknown``, ``granularity``, ``latitude`` and ``longitude``, one row for each ``photo``
    (repeated or null ones abort); ``located``: the same columns, of photos that were found by
    place; ``provider``: (``photo``, ``latitude``, ``longitude``); ``known``: a dictionary
    (:func:`gazetteer.dictionary`).  Photos without any clue have a summary, too.
    """
    require_none(photos.filter("photo IS NULL").select("photo"), "photos without an identifier")
    require_none(duplicates(photos, ["photo"]), "photos are repeated")
    provider = provider.join(photos.select("photo").unionByName(located.select("photo")).distinct(), "photo", "left_semi").filter(geo.valid_point(F.col("latitude"), F.col("longitude"))).dropDuplicates(["photo"])
    own = provider.join(photos.select("photo"), "photo", "left_semi")
    read = staged(_read(staged(text_units(photos)), known))
    found, times = _evidence(read, photos, own), _times(read)
    at = dates.capture_time(F.col("taken"), F.col("unknown"), F.col("granularity"))
    targets = photos.select("photo", "owner", at.alias("at")).filter("at IS NOT NULL AND owner IS NOT NULL")
    near = timeline.nearest_anchors(targets, staged(anchors(photos, located, provider)), "owner", "at", "photo")
    return Analysis(_summary(photos, found, times, near), found, times, near)


def _summary(photos: DataFrame, found: DataFrame, times: DataFrame, near: DataFrame) -> DataFrame:
    kind, source = F.col("kind"), F.col("source")
    own = F.coalesce("by_owner", F.lit(False))
    point = F.element_at("candidates", 1)
    about = source.isin(*PHOTO_TEXT) & ~kind.isin(*clues.ASIDE)
    named = F.when(F.col("capture"), F.transform("candidates", lambda p: p["place"]))
    told = found.groupBy("photo").agg(
        *[F.first(F.when(kind == k, point[c]), True).alias(f"{name}_{c}") for k, name in (("provider_coordinates", "provider"), ("machine_tag_coordinates", "machine")) for c in ("latitude", "longitude")],
        F.count_if(kind.isin(*clues.TEXT_COORDINATES)).alias("text_points"),
        F.count_if("capture").alias("captures"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(named))))).alias("named"),
        F.count(F.lit(1)).alias("evidence"),
        F.count_if(about).alias("photo_text"),
        F.count_if((source == "comment") & own).alias("owner_comment"),
        F.count_if((source == "comment") & ~own).alias("other_comment"),
        F.count_if(source == "owner_profile").alias("profile"),
    )
    timed = times.groupBy("photo").agg(
        F.count(F.lit(1)).alias("relative_times"),
        *[F.count_if(F.col("narrative") == n).alias(c) for c, n in (("travel_timings", "travel_or_itinerary_timing"), ("stage_timings", "biological_stage_timing"))],
        F.count_if(F.col("basis") == "clock_time_in_text_timezone_unresolved").alias("clock_times"),
    )
    hour = F.col("window") == "hour"
    by = near.groupBy("photo").agg(
        F.count_if(hour).alias("hour_neighbours"), F.count_if(hour & (F.col("relation") == "before")).alias("hour_before"), F.count_if(hour & (F.col("relation") == "after")).alias("hour_after"),
        F.count(F.lit(1)).alias("neighbours"), F.min_by(F.struct("anchor_id", "minutes"), F.struct(F.abs("minutes"), "anchor_id")).alias("closest"),
    )
    out = photos.select("photo", "owner", F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("comments")).withColumn("comments", F.greatest("comments", F.lit(0).cast("long")))
    for part in (told, timed, by):
        out = out.join(part, "photo", "left")
    numbers = ["text_points", "captures", "evidence", "photo_text", "owner_comment", "other_comment", "profile", "relative_times", "travel_timings", "stage_timings", "clock_times", "hour_neighbours", "hour_before", "hour_after", "neighbours"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {"named": F.coalesce("named", F.expr("CAST(array() AS ARRAY<STRING>)"))})
    some = lambda c: F.col(c) > 0
    return out.withColumn(
        "status",
        clues.status(
            provider_coordinates=F.col("provider_latitude").isNotNull(), machine_tags=F.col("machine_latitude").isNotNull(), text_coordinates=some("text_points"), named_capture=some("captures"),
            hour_neighbour=some("hour_neighbours"), other_mention=some("photo_text"), day_neighbour=some("neighbours"), relative_time=some("relative_times"), profile_only=some("profile"),
        ),
    )


def run_report(summary: DataFrame) -> DataFrame:
    """One row: the seventeen counts of a run (``COUNTS``), and how many photos have each status (``n_...``)."""
    n = lambda condition, name: F.count_if(condition).alias(name)
    some = lambda c: F.col(c) > 0
    held = {
        "with_provider_point": F.col("provider_latitude").isNotNull(), "with_machine_point": F.col("machine_latitude").isNotNull(), "with_named_capture": F.size("named") > 0, "with_photo_text": some("photo_text"),
        "with_owner_comment": some("owner_comment"), "with_other_comment": some("other_comment"), "with_relative_time": some("relative_times"), "with_hour_neighbour": some("hour_neighbours"),
        "with_hour_before": some("hour_before"), "with_hour_after": some("hour_after"), "with_day_neighbour": some("neighbours"), "with_text_point": some("text_points"),
        "with_travel_timing": some("travel_timings"), "with_stage_timing": some("stage_timings"), "with_clock_time": some("clock_times"),
    }
    counts = {"photos": F.count(F.lit(1)), "comments": F.coalesce(F.sum("comments"), F.lit(0))}
    statuses = [n(F.col("status") == s, f"n_{s}") for s in (*clues.STATUSES, "none")]
    return summary.agg(*[counts[c].alias(c) if c in counts else n(held[c], c) for c in COUNTS], *statuses)


def provisional_places(found: DataFrame, places: DataFrame, keep: int = 10, excerpts: int = 3, characters: int = 600) -> DataFrame:
    """A provisional place for each photo that has evidence with a point.

    ``found``: the evidence of an analysis; ``places``: (``place``, ``name``, ``level``,
    ``country``, ``latitude``, ``longitude``), which gives places their points.  Evidence of
    profiles and asides doesn't count.  If what the photo's owner says names one country
    only, places of others drop out and its own gain.  Candidates rank by their best score,
    plus four for each further source (three at most), then by sources, place and point.
    Each has ``excerpts`` of up to so many ``characters``, the evidence's identifiers, and
    whether any of it is a coordinate.
    """
    kind, source = F.col("kind"), F.col("source")
    usable = found.filter((source != "owner_profile") & ~kind.isin(*clues.ASIDE))
    rows = usable.select("photo", "source", "by_owner", "kind", "capture", "evidence_id", F.coalesce("excerpt", "matched").alias("excerpt"), F.explode("candidates").alias("c"))
    said = rows.filter(((source != "comment") | F.coalesce("by_owner", F.lit(False))) & (F.col("c.level") == "country") & F.col("c.country").isNotNull())
    one = said.groupBy("photo").agg(F.collect_set("c.country").alias("all")).filter(F.size("all") == 1).select("photo", F.get("all", 0).alias("context"))
    full = rows.join(places.select(F.col("place").cast("string").alias("__p"), "name", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")), F.col("c.place") == F.col("__p"), "left").join(one, "photo", "left")
    full = full.withColumns({"lat": F.coalesce("c.latitude", "p_lat"), "lon": F.coalesce("c.longitude", "p_lon")}).filter(geo.valid_point(F.col("lat"), F.col("lon")))
    full = full.filter(F.col("context").isNull() | F.col("c.country").isNull() | (F.col("c.country") == F.col("context")))
    score = clues.evidence_score(kind, source, F.col("by_owner"), F.col("capture"), F.col("c.level"), F.coalesce(F.col("c.country") == F.col("context"), F.lit(False)))
    reference = kind.isin(*clues.TEXT_COORDINATES, "machine_tag_coordinates")
    spot = F.coalesce("c.place", F.format_string("%.6f,%.6f", "lat", "lon"))
    rolled = full.groupBy("photo", spot.alias("place")).agg(
        F.min("name").alias("name"), F.min("c.level").alias("level"), F.min("c.country").alias("country"), F.min("lat").alias("latitude"), F.min("lon").alias("longitude"),
        F.max(score).alias("best"), F.countDistinct("source", F.coalesce(F.col("by_owner").cast("string"), F.lit("unknown"))).alias("sources"), F.bool_or(reference).alias("reference"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("excerpt") != "", F.substring("excerpt", 1, characters)))), 1, excerpts).alias("excerpts"),
    )
    total = F.col("best") + 4 * F.least(F.lit(3), F.col("sources") - 1)
    entry = F.struct((-total).alias("a"), (-F.col("sources")).alias("b"), "place", "latitude", "longitude", "name", "level", "country", "reference", "evidence_ids", "excerpts")
    ranked = rolled.groupBy("photo").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    top = F.col("all")[0]
    spread = F.array_max(F.transform("all", lambda p: geo.haversine_km(top["latitude"], top["longitude"], p["latitude"], p["longitude"])))
    coarse = top["level"].isin("country", "region")
    flags = F.array_compact(F.array(
        F.lit("provisional_not_human_georeferenced"), F.when(F.size("all") > 1, "multiple_place_candidates"), F.when(spread > clues.MOST_SPREAD_KM, "widely_separated_candidates"),
        F.when(coarse, "coarse_administrative_reference_point"), F.when(top["country"].isNull(), "country_not_resolved"),
    ))
    method = F.when(top["reference"], "text_coordinate_reference").when(coarse, "administrative_reference_point").otherwise("gazetteer_place_reference")
    return ranked.select(
        "photo", method.alias("method"), *[top[c].alias(c) for c in ("place", "name", "level", "country", "latitude", "longitude")], F.size("all").cast("long").alias("candidates"),
        F.bround(spread, 1).alias("spread_km"), flags.alias("flags"), top["evidence_ids"].alias("evidence_ids"), top["excerpts"].alias("excerpts"), F.transform(F.slice("all", 2, keep), lambda p: p["place"]).alias("alternatives"),
    )
