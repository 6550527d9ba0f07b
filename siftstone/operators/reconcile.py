"""Joining sources with reviews and cached responses, under checks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_overlay, without_keys_like
from .checks import duplicates, require_none

#: What a round of reviews says of an image, by how it is read.
ROUND_COUNTS = ("review_count", "reviewer_count")
ROUND_FLAGS = ("unanimous", "has_conflicting_reviews")
ROUND_TEXTS = ("unanimous_result", "strict_majority_result", "first_saved_at_utc", "last_updated_at_utc", "result_counts_json")
#: A source's own coordinates, and how a source says where its coordinates are from.
SOURCE_POINT = ("latitude", "longitude", "accuracy")
SEARCHED = "flickr.photos.search"


def reconcile(source: DataFrame, reviews: DataFrame, key: Sequence[str], flag: str = "has_saved_review", check: bool = True) -> DataFrame:
    """``source`` with the review of each row, one to one; ``flag`` says whether there is one.

    Repeated keys on either side, and reviews without a source, are errors.
    """
    if check:
        require_none(duplicates(source, key), "the source repeats keys")
        require_none(duplicates(reviews, key), "the reviews repeat keys")
        require_none(reviews.join(source, list(key), "left_anti").select(*key), "reviews without a source")
    return source.join(reviews.withColumn(flag, F.lit(True)), list(key), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def enrich(df: DataFrame, responses: DataFrame, key: str, kind: str, kinds: Sequence[str], value: str, missing: str = "pending") -> DataFrame:
    """``df`` with a column for each kind of response: its value, or ``missing``."""
    wide = responses.groupBy(key).pivot(kind, list(kinds)).agg(F.first(value, ignorenulls=True))
    out = df.join(wide, key, "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(missing)) for k in kinds})


def coalesced_update(table: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``table`` with the columns of ``changes`` where it has a row for the key: UPDATE ... FROM."""
    new = changes.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = table.join(new, list(key), "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def compare_and_set(table: DataFrame, changes: DataFrame, key: Sequence[str], column: str, old: str, new: str) -> DataFrame:
    """``table`` with new values where the old one is as expected, and ``outcome`` for each row."""
    c = changes.select(*key, F.lit(True).alias("__hit"), F.col(old).alias("__old"), F.col(new).alias("__new"))
    out = table.join(c, list(key), "left")
    same = F.col(column).eqNullSafe(F.col("__old"))
    outcome = F.when(F.col("__hit").isNull(), "unchanged").when(same, "set").otherwise("conflict")
    value = F.when(F.col("__hit") & same, F.col("__new")).otherwise(F.col(column))
    return out.withColumn("outcome", outcome).withColumn(column, value).drop("__hit", "__old", "__new")


def routed(df: DataFrame, name: str, *routes: tuple[str, Column]) -> DataFrame:
    """A row of ``df`` for each route whose condition holds: the sheets that it belongs on."""
    places = F.array(*[F.when(c, F.lit(n)) for n, c in routes])
    return df.withColumn(name, F.explode(F.filter(places, lambda p: p.isNotNull())))


def attach_guarded(table: DataFrame, plan: DataFrame, key: str, identity: Sequence[str], column: str, member: str, open_statuses: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``table`` with the plan's ``payload`` laid into ``column``, a JSON object, as ``member``; and (``key``, ``outcome``) of each planned row.

    Outcomes: ``gone`` (no such row), ``identity`` (another image stands there), ``no object``
    (the column holds other JSON), ``settled`` (there is another payload whose status isn't
    in ``open_statuses``: a person decided), ``already attached`` and ``attached``.  Only the
    last changes a row; other members stay as they are written.  A null column is an empty
    object.  A key that the plan or table repeats aborts.  ``sources.commits.update`` repeats
    this on what other writers published meanwhile.
    """
    require_none(duplicates(plan, [key]), "the plan repeats keys")
    require_none(duplicates(table, [key]), "the table repeats keys")
    asked = plan.select(key, F.col("payload").alias("__payload"), *[F.col(c).alias(f"__{c}") for c in identity])
    out = table.withColumn("__there", F.lit(True)).join(asked.withColumn("__asked", F.lit(True)), key, "full")
    old = F.coalesce(F.col(column), F.lit("{}"))
    parsed = F.try_parse_json(old)
    there = F.try_variant_get(parsed, f"$['{member}']", "variant")
    known = there.isNotNull() & ~F.is_variant_null(there)
    same = F.to_json(there).eqNullSafe(F.to_json(F.try_parse_json("__payload")))
    still_open = F.coalesce(F.try_variant_get(there, "$.status", "string").isin(*open_statuses), F.lit(False))
    outcome = (
        F.when(F.col("__there").isNull(), "gone")
        .when(~F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), False) for c in identity], F.lit(True)), "identity")
        .when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "no object")
        .when(known & same, "already attached")
        .when(known & ~still_open, "settled")
        .otherwise("attached")
    )
    out = out.withColumn("__outcome", F.when(F.col("__asked"), outcome))
    over = F.concat(F.lit(f"{{{json.dumps(member)}:"), "__payload", F.lit("}"))
    merged = F.when(F.col("__outcome") == "attached", json_overlay(F.when(F.col("__outcome") == "attached", old), over)).otherwise(F.col(column))
    changed = out.filter("__there").withColumn(column, merged).select(*table.columns)
    return changed, out.filter("__asked").select(key, F.col("__outcome").alias("outcome"))


def _round(name: str) -> dict[str, Column]:
    """A round's columns out of saved texts: counts are 0 without a review, flags and empty texts null, the reviews a list."""
    text = lambda c: F.nullif(F.trim(F.col(f"`{name}_{c}`").cast("string")), F.lit(""))
    reviews = F.col(f"`{name}_reviews_json`")
    return (
        {f"{name}_{c}": F.coalesce(text(c).cast("bigint"), F.lit(0)) for c in ROUND_COUNTS}
        | {f"{name}_{c}": F.when(text(c).isNotNull(), F.lower(text(c)) == "true") for c in ROUND_FLAGS}
        | {f"{name}_{c}": F.nullif(F.col(f"`{name}_{c}`").cast("string"), F.lit("")) for c in ROUND_TEXTS}
        | {f"{name}_reviews_json": F.coalesce(without_keys_like()(reviews), F.lit("[]"))}
    )


def joined_images(source: DataFrame, reviews: DataFrame, located: DataFrame, key: Sequence[str], photo: str, rounds: Sequence[str] = ("first_round", "second_round"), rest: Sequence[str] = ()) -> DataFrame:
    """Each row of ``source`` with its saved review, both rounds typed, and the best coordinates known of it.

    ``source`` and ``reviews`` share ``key``; both must hold a key once, and no review may lack
    its source.  Reviews hold texts: ``image_id``, what :data:`ROUND_COUNTS` and the others
    name for each round, and ``rest``.  Keys like addresses of persons are removed from their JSON.

    The source's own coordinates are placeholders and go; ``located`` (``photo``, ``latitude``,
    ``longitude``, ``accuracy``, ``geolocation_source``), one row a photo, takes their place.  Only
    where that has none do the source's count: if they are a point with an accuracy of 1 to 16.
    Its comments are renamed, as they are of the discovery.
    """
    require_none(duplicates(located, [photo]), "responses repeat photos")
    asked = reviews.select(*key, F.col("image_id").alias("veritaxa_image_id"), *[F.col(f"`{r}_{c}`") for r in rounds for c in (*ROUND_COUNTS, *ROUND_FLAGS, *ROUND_TEXTS, "reviews_json")], *rest)
    own = {c: F.col(c).try_cast("double") if c != "accuracy" else F.col(c).try_cast("int") for c in SOURCE_POINT}
    first = source.withColumns({f"__{c}": v for c, v in own.items()}).drop(*SOURCE_POINT)
    first = first.withColumnsRenamed({c: f"discovery_{c}" for c in ("comments_text", "comments_count")})
    out = reconcile(first, asked, key).join(located.select(photo, *SOURCE_POINT, "geolocation_source"), photo, "left")
    usable = F.col("latitude").isNull() & F.coalesce(F.col("__latitude").between(-90, 90) & F.col("__longitude").between(-180, 180) & F.col("__accuracy").between(1, 16), F.lit(False))
    found = {c: F.when(usable, F.col(f"__{c}")).otherwise(F.col(c)) for c in SOURCE_POINT} | {"geolocation_source": F.when(usable, SEARCHED).otherwise(F.col("geolocation_source"))}
    typed = {n: c for r in rounds for n, c in _round(r).items()}
    return out.withColumns(found | typed).drop(*[f"__{c}" for c in SOURCE_POINT])
