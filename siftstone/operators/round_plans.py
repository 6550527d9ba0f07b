"""Rounds of review as plans: pure functions from the tables of the review model to new ones.

A plan is a dry run: it returns frames that can be counted and checked, and nothing changes
until they are written.  Items have (``id``, ``batch_id``, ``position``, ``source_provider``,
``image_id``, ``pipeline_metadata``), reviews (``id``, ``item_id``, ``reviewer_id``,
``label``, ``updated_at``), batches (``id``, ``campaign_id``, ``batch_code``, ``status``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import has_key, json_point
from .checks import duplicates, not_contiguous, require_none
from .rounds import append_positions, balanced, digest_positions, group_numbers, ranked
from .staging import staged

#: The key that marks items of a second round, and labels whose category has a value of its own.
ROUND_KEY = "rereview"
TARGET, KEYWORD = "target_scientific_name", "flickr_keyword_match"
SCIENTIFIC, SEARCHED = "scientific_name:", "flickr_keyword:"


def category(label: Column, scientific_name: Column, keyword: Column) -> Column:
    """The category of a vote: its label, or the name or keyword that it confirms."""
    return F.when(label == TARGET, F.concat(F.lit(SCIENTIFIC), scientific_name)).when(label == KEYWORD, F.concat(F.lit(SEARCHED), keyword)).otherwise(label)


def rereview_round(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Members of a second round: one for each category and image that first-round votes name.

    An image with different votes is in several categories.  Of its items the one reviewed
    last (then the least) stands for it, and all votes of the category are frozen with it, in
    the order of time.  Groups are numbered, and members shuffled by a digest within them.
    """
    old = items.filter(~has_key(F.col("pipeline_metadata"), ROUND_KEY)).select(F.col("id").alias("item_id"), "source_provider", "image_id", "target_scientific_name")
    votes = reviews.select(
        F.col("id").alias("review_id"), "item_id", "label", "updated_at", category(F.col("label"), F.col("scientificName"), F.col("flickrKeyword")).alias("category")
    ).filter("category IS NOT NULL")
    snapshot = F.struct("updated_at", F.col("review_id").alias("id"), "label")
    first = F.min_by("item_id", F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("late"), "review_id"))
    keys = ["category", "source_provider", "image_id"]
    members = staged(votes.join(old, "item_id").groupBy(*keys).agg(
        first.alias("item_id"), F.min("target_scientific_name").alias("target_scientific_name"), F.array_sort(F.collect_list(snapshot)).alias("votes")
    ))  # kept, as the groups, the ranges and the ranks all read it
    groups = group_numbers(members, ["category", "target_scientific_name", "source_provider"])
    same = [members[c].eqNullSafe(groups[c]) for c in ("category", "target_scientific_name", "source_provider")]
    numbered = members.join(groups, same[0] & same[1] & same[2]).select(members["*"], F.col("group_number").cast("long").alias("group_number"), "members")
    return digest_positions(numbered, ["group_number"], "source_provider", "image_id", ["image_id"])


def latest_groups(items: DataFrame, reviews: DataFrame, begin: str, end: str, answer: Column, legacy: Sequence[str] = (KEYWORD,)) -> DataFrame:
    """(``source_provider``, ``image_id``, ``item_id``, ``review_id``, ``answer``): the latest answer for each eligible image.

    An image is eligible if any of its votes was made or changed in the half-open window, and
    not before its item was; then all of its votes compete, the latest wins, and of equal
    times the greater identifier.  A latest answer in ``legacy`` stops the plan.
    """
    rows = reviews.select(F.col("id").alias("review_id"), "item_id", "label", "scientificName", F.col("created_at").alias("made"), "updated_at").join(
        items.select(F.col("id").alias("item_id"), "source_provider", "image_id", "target_scientific_name", F.col("created_at").alias("item_made")), "item_id"
    )

    def inside(c: str) -> Column:
        return (F.col(c) >= F.lit(begin).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))

    keys = ["source_provider", "image_id"]
    eligible = rows.filter((inside("made") | inside("updated_at")) & (F.col("updated_at") >= F.col("item_made"))).select(*keys).distinct()
    latest = rows.join(eligible, keys, "left_semi").groupBy(*keys).agg(F.max_by(F.struct("item_id", "review_id", "label", "scientificName", "target_scientific_name"), F.struct("updated_at", "review_id")).alias("r"))
    latest = staged(latest.select(*keys, "r.*"))
    require_none(latest.filter(F.col("label").isin(*legacy)), "latest answers with labels of old versions")
    return latest.withColumn("answer", answer).select(*keys, "item_id", "review_id", "answer")


def appended(groups: DataFrame, existing: DataFrame, batch: str = "answer") -> DataFrame:
    """Members that a published round lacks, at the end of their batch.  ``existing`` has (provider, image, ``batch``, ``position``)."""
    new = groups.join(existing.select("source_provider", "image_id").distinct(), ["source_provider", "image_id"], "left_anti")
    return append_positions(existing, new, [batch], "position", ["source_provider", "image_id"])


def regrouped(members: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One folder for each option of a round, and its batches.

    ``members`` has (``item_id``, ``batch_id``, ``position``, ``option``).  All members of an
    option move to the first of its batches (open ones first, then by identifier); positions
    go on without gaps in the order of batch and position, and emptied batches close.
    """
    status = batches.select(F.col("id").alias("batch_id"), "status")
    known = members.join(status, "batch_id")
    to = known.groupBy("option").agg(F.min_by("batch_id", F.struct((F.col("status") != "open").alias("shut"), "batch_id")).alias("destination"))
    moved = ranked(known.join(to, "option"), ["destination"], ["batch_id", "position", "item_id"], "new_position")
    items = moved.select("item_id", "option", F.col("batch_id").alias("old_batch_id"), F.col("destination").alias("batch_id"), F.col("new_position").alias("position"))
    return items, closed_if_empty(batches, members.select("batch_id"), items.select("batch_id"))


def closed_if_empty(batches: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``batches`` with those closed that had items (``batch_id``) and have none now."""
    had = before.select(F.col("batch_id").alias("id")).distinct().withColumn("__had", F.lit(True))
    has = after.select(F.col("batch_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    out = batches.join(had, "id", "left").join(has, "id", "left")
    return out.withColumn("status", F.when(F.col("__had") & F.col("__has").isNull(), "closed").otherwise(F.col("status"))).drop("__had", "__has")


def geotag_partition(items: DataFrame, batches: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Items with a point and items without apart: where each item goes, and the batches after it.

    Items without a valid point in ``pipeline_metadata`` leave for new batches of ``most``
    items at most, as equal as can be: first-round items by campaign, second-round ones by
    target and provider.  The others keep their batch and get positions without gaps.
    ``stamp`` is a label for the metadata, with the reason for what has no point.
    """
    lat, lon = json_point(F.col("pipeline_metadata"))
    second = has_key(F.col("pipeline_metadata"), ROUND_KEY)
    rows = items.join(batches.select(F.col("id").alias("batch_id"), "campaign_id"), "batch_id")
    placed = rows.withColumns({"latitude": lat, "longitude": lon})
    group = F.when(second, F.concat_ws("|", F.lit("second"), F.coalesce("target_scientific_name", F.lit("")), "source_provider")).otherwise(F.concat(F.lit("first|"), F.col("campaign_id").cast("string")))
    without = placed.filter(F.col("latitude").isNull()).withColumn("grp", group)
    dealt = balanced(without.select(F.col("id").alias("item_id"), F.col("batch_id").alias("old_batch_id"), "grp"), ["grp"], ["item_id"], most)
    moved = dealt.select("item_id", "old_batch_id", F.concat_ws("#", "grp", F.col("bucket").cast("string")).alias("new_batch"), F.col("bucket_position").alias("position"), F.lit("no_geotag").alias("stamp"))
    stay = ranked(placed.filter(F.col("latitude").isNotNull()).select("id", "batch_id", F.col("position").alias("old_position")), ["batch_id"], ["old_position", "id"], "position")
    kept = stay.select(F.col("id").alias("item_id"), F.col("batch_id").alias("old_batch_id"), F.lit(None).cast("string").alias("new_batch"), "position", F.lit("geotagged").alias("stamp"))
    return moved.unionByName(kept), closed_if_empty(batches, items.select("batch_id"), stay.select("batch_id"))


def refreshed(items: DataFrame, batches: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open batches without the items whose image anyone has reviewed anywhere, renumbered; emptied batches close.

    An image is told by provider and identifier.  A second run changes nothing.
    """
    seen = items.select(F.col("id").alias("item_id"), "source_provider", "image_id").join(reviews.select("item_id").distinct(), "item_id", "left_semi").select("source_provider", "image_id").distinct()
    open_ = items.join(batches.filter("status = 'open'").select(F.col("id").alias("batch_id")), "batch_id", "left_semi")
    left = open_.join(seen, ["source_provider", "image_id"], "left_anti").select("id", "batch_id", F.col("position").alias("old_position"))
    kept = ranked(left, ["batch_id"], ["old_position", "id"], "position").drop("old_position")
    return kept, closed_if_empty(batches, open_.select("batch_id"), kept.select("batch_id"))


def second_round_label(label: Column, metadata: Column) -> Column:
    """The label that an answer in the second round also stores there; null in the first."""
    return F.when(has_key(metadata, ROUND_KEY), label)


def published(batches: DataFrame, items: DataFrame, opened: DataFrame, closed: DataFrame) -> DataFrame:
    """``batches`` after a round is published: those of ``opened`` (``id``) are open, those of ``closed`` closed.

    Nothing opens unless its items have positions from 1 without gaps and no image twice, and
    it has items at all; else the plan stops.
    """
    new = items.join(opened.select(F.col("id").alias("batch_id")), "batch_id", "left_semi")
    require_none(opened.join(new.select(F.col("batch_id").alias("id")), "id", "left_anti"), "batches without items")
    require_none(not_contiguous(new, ["batch_id"], "position"), "positions have gaps")
    require_none(duplicates(new, ["batch_id", "source_provider", "image_id"]), "images repeat in a batch")
    marks = opened.select("id", F.lit("open").alias("__to")).unionByName(closed.select("id", F.lit("closed").alias("__to")))
    require_none(duplicates(marks, ["id"]), "batches both opened and closed")
    return batches.join(marks, "id", "left").withColumn("status", F.coalesce("__to", "status")).drop("__to")


def with_latest_members(items: DataFrame, members: DataFrame, *ties: str) -> DataFrame:
    """``items`` with the latest member (``position``, ``stamp``) of a shuffled round that names them as its original; others drop out.

    Of members made at once at one position that with the smallest ``ties`` counts, such as
    where it stands in its input.  A null time or position is later than any.
    """
    zero = F.lit(0) if isinstance(members.schema["made"].dataType, NumericType) else F.lit("1970-01-01").cast(members.schema["made"].dataType)
    order = F.struct((zero - F.col("made")).alias("made"), (-F.col("position")).alias("position"), *ties)  # falling, as ties may be texts
    latest = members.groupBy("original_id").agg(F.min_by(F.struct("position", "stamp"), order).alias("m"))
    return items.join(latest, F.col("id") == F.col("original_id")).select(items["*"], F.col("m.position").alias("member_position"), F.col("m.stamp").alias("member_stamp"))
