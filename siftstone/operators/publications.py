"""Rounds and imports as whole publications: campaigns, batches and items that are made together.

Each returns the three tables as they are afterwards, after it has proved that what was there
before is there unchanged, that every member is in once, and that positions have no gaps.
Nothing is written here: :func:`sinks.publish_tables` makes the tables one version, so readers
see all of a publication or nothing of it.

Campaigns have (``id``, ``campaign_code``, ``title``, ``target_scientific_name``,
``status``), batches (``id``, ``campaign_id``, ``batch_code``, ``title``, ``position``,
``status``), and items what :mod:`round_plans` says; further columns of theirs stay, null for
new campaigns and batches.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_name, has_key, json_with
from . import round_plans
from .checks import CheckFailed, duplicates, lost_or_changed, not_contiguous, require_none
from .rounds import ranked
from .staging import staged

#: What codes of second rounds begin with, characters of a category's name in a title, and bytes of metadata that must be archived first.
ROUND, BATCH, TITLE, BULKY = "REREVIEW-", "RR-", 111, 8192
ARCHIVED = "archive_record"
UNSPECIFIED = "(unspecified)"
#: Categories with names of their own.
NAMES = {"artifact_or_illustration": "Object, artwork or illustration", "no_biological_subject": "No clear biological subject", "arachnid": "Spider or other arachnid"}
#: Groups of latest answers, in order, with their titles.
GROUPS = {"yes_target": "Yes — {target}", "no_target": "No — other butterfly", "no_butterfly": "No butterfly / other or unresolved"}


class Published(NamedTuple):
    campaigns: DataFrame
    batches: DataFrame
    items: DataFrame


def _code(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%03d", number))


def category_name(category: Column) -> Column:
    """What a category is called in a title."""
    plain = display_name(category, [round_plans.SCIENTIFIC], NAMES)
    named = F.when(category.startswith(round_plans.SCIENTIFIC), F.substring(category, len(round_plans.SCIENTIFIC) + 1, 1_000_000))
    word = F.concat(F.lit("Keyword match: "), F.substring(category, len(round_plans.SEARCHED) + 1, 1_000_000))
    return F.coalesce(named, F.when(category.startswith(round_plans.SEARCHED), word), plain)


def with_fallbacks(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """``reviews`` whose names and keywords are never missing: the campaign's target, or the term that found the item, stand in."""
    of = items.select(F.col("id").alias("__item"), F.col("target_scientific_name").alias("__target"), F.col("flickr_search_term").alias("__term"))
    out = reviews.join(of, F.col("item_id") == F.col("__item"), "left")
    name = F.coalesce(F.when(F.col("scientificName") != "", F.col("scientificName")), "__target", F.lit(UNSPECIFIED))
    return out.withColumns({"scientificName": name, "flickrKeyword": F.coalesce("flickrKeyword", "__term", F.lit(""))}).drop("__item", "__target", "__term")


def _next_id(table: DataFrame) -> int:
    return int(table.agg(F.max("id")).first()[0] or 0) + 1  # one number


def _added(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with new rows below, in its own types."""
    kinds = {f.name: f.dataType for f in table.schema}
    fitting = rows.select(*[F.col(c).cast(kinds[c]) for c in rows.columns if c in kinds])
    return table.unionByName(fitting, allowMissingColumns=True)


def _prove(before: Published, after: Published, members: int, code: str) -> None:
    """Raises unless old items are unchanged, and the round has so many members, each once, in places without gaps."""
    require_none(lost_or_changed(before.items, after.items, ["id"], [c for c in before.items.columns if c != "id"]), "rows have changed")
    own = after.campaigns.filter(F.col("campaign_code").startswith(code)).select(F.col("id").alias("campaign_id"))
    batches = after.batches.join(own, "campaign_id", "left_semi").select(F.col("id").alias("batch_id"))
    new = after.items.join(batches, "batch_id", "left_semi")
    found = new.groupBy("batch_id", "source_provider", "image_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.max("n").alias("most")).first()  # one row
    if found["all"] != members:
        raise CheckFailed(f"the round's members are not as many as planned: {found['all']}, not {members}")
    if members and found["most"] > 1:
        require_none(duplicates(new, ["batch_id", "source_provider", "image_id"]), "images repeat in a batch")
    require_none(not_contiguous(new, ["batch_id"], "position"), "positions have gaps")


def _retired(campaigns: DataFrame, batches: DataFrame, code: str, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Other second rounds (of one target) are archived with their batches; their data stay."""
    old = F.col("campaign_code").startswith(ROUND) & ~F.col("campaign_code").startswith(code)
    if target is not None:
        old = old & (F.col("target_scientific_name") == target)
    gone = campaigns.filter(old).select(F.col("id").alias("__old"))
    kept = batches.join(gone, F.col("campaign_id") == F.col("__old"), "left").withColumn("status", F.when(F.col("__old").isNotNull(), "archived").otherwise(F.col("status"))).drop("__old")
    return campaigns.withColumn("status", F.when(old, "archived").otherwise(F.col("status"))), kept


def rereview(campaigns: DataFrame, batches: DataFrame, items: DataFrame, reviews: DataFrame, code: str, at: str, replace: bool = False) -> Published:
    """A second round of all first-round votes: a campaign with one batch for each category, target and provider.

    Aborts if the round exists, if there are no votes, or if metadata are too long and not
    archived.  Members carry the round, the category, the item that stands for them and all
    votes of theirs as they are now.  ``replace`` archives other second rounds.
    """
    own = f"{ROUND}{code}-"
    require_none(campaigns.filter(F.col("campaign_code").startswith(own)).select("campaign_code"), "the round exists")
    bulky = items.filter((F.octet_length("pipeline_metadata") >= BULKY) & ~has_key(F.col("pipeline_metadata"), ARCHIVED))
    require_none(bulky.select("id"), "metadata must be archived first")
    members = round_plans.rereview_round(items, with_fallbacks(reviews, items))
    groups = staged(members.select("group_number", "category", "target_scientific_name", "members").distinct())  # a row for each batch
    count = groups.agg(F.sum("members")).first()[0]
    if not count:
        raise ValueError("no reviews to look at again")
    title = F.concat(F.lit("Round 2: "), F.substring(category_name(F.col("category")), 1, TITLE))
    campaign, batch, item = _next_id(campaigns), _next_id(batches), _next_id(items)
    number = F.col("group_number")
    new_campaigns = groups.select((number + campaign - 1).alias("id"), _code(own, number).alias("campaign_code"), title.alias("title"), "target_scientific_name", F.lit("open").alias("status"))
    new_batches = groups.select((number + batch - 1).alias("id"), (number + campaign - 1).alias("campaign_id"), F.concat(_code(f"{BATCH}{code}-", number), F.lit("-001")).alias("batch_code"), title.alias("title"), F.lit(1).alias("position"), F.lit("open").alias("status"))
    stamp = F.to_json(F.struct(F.lit(code).alias("round_code"), "category", F.lit(at).alias("snapshot_at"), F.col("item_id").alias("original_item_id"), F.col("votes").alias("source_reviews")))
    placed = _numbered(members.withColumn("__stamp", stamp), groups.select("group_number", "members"), "group_number", "position")
    new_items = _members(items, placed, (number + batch - 1), F.col("position"), item)
    if replace:
        campaigns, batches = _retired(campaigns, batches, own)
    out = Published(_added(campaigns, new_campaigns), _added(batches, new_batches), _added(items, new_items))
    _prove(Published(campaigns, batches, items), out, count, own)
    return out


def _numbered(placed: DataFrame, sizes: DataFrame, group: str, position: str) -> DataFrame:
    """``placed`` with ``__n``, its number from 1 over all groups in their order; positions have no gaps, and ``sizes`` says how long groups are."""
    before = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    g, n = sizes.columns
    starts = sizes.select(F.col(g).alias("__g"), F.col(n).alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    return placed.join(starts, F.col(group) == F.col("__g")).withColumn("__n", F.col("__before") + F.col(position)).drop("__g", "__size", "__before")


def _members(items: DataFrame, placed: DataFrame, batch: Column, position: Column, first: int) -> DataFrame:
    """Copies of the items that stand for members (``item_id``, ``__stamp``, ``__n``), stamped, in their new places.

    They are made once and kept: the proof and the readers see the same rows.
    """
    to = placed.select(F.col("item_id").alias("__of"), (F.col("__n") + first - 1).alias("__id"), batch.alias("__batch"), position.alias("__position"), "__stamp")
    rows = items.join(to, F.col("id") == F.col("__of"))
    stamped = json_with(F.coalesce("pipeline_metadata", F.lit("{}")), F.lit(round_plans.ROUND_KEY), F.col("__stamp"))
    return rows.withColumns({"id": F.col("__id"), "batch_id": F.col("__batch"), "position": F.col("__position"), "pipeline_metadata": stamped}).select(*items.columns).transform(staged)


def latest_grouping(
    campaigns: DataFrame, batches: DataFrame, items: DataFrame, members: DataFrame, code: str, target: str, rule: Mapping[str, str], at: str, append: bool = False, reopen: DataFrame | None = None
) -> Published:
    """Latest answers (``source_provider``, ``image_id``, ``item_id``, ``review_id``, ``answer`` of ``GROUPS``) as a round of three campaigns.

    With ``append`` the round exists and is open: images that it has stay where they are, and
    new ones go behind the last of their group.  Each image is in the round once.  Members
    are stamped with the round, the group, the review that decided, and ``rule``.  Other
    second rounds of the target are archived; closed batches of the campaigns in ``reopen``
    (``campaign_code``) open again.
    """
    own = f"{ROUND}{code}-"
    known = [F.struct(F.lit(k).alias("number"), F.lit(g).alias("answer"), F.lit(title.format(target=target)).alias("name")) for k, (g, title) in enumerate(GROUPS.items(), 1)]
    groups = items.sparkSession.range(1).select(F.inline(F.array(*known)))
    require_none(members.join(groups, "answer", "left_anti").select("answer"), "answers that no group takes")
    found = campaigns.filter(F.col("campaign_code").startswith(own))
    number = F.col("number")
    if append:
        there = groups.join(found.filter("status = 'open'").select(F.col("id").alias("campaign_id"), "campaign_code"), F.col("campaign_code") == _code(own, number))
        there = there.join(batches.filter("status = 'open'").select(F.col("id").alias("to"), "campaign_id"), "campaign_id").select("answer", "to")
        require_none(groups.join(there.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).filter("n = 1"), "answer", "left_anti").select("answer"), "groups without one open batch")
        new_campaigns, new_batches = campaigns.limit(0), batches.limit(0)
    else:
        require_none(found.select("campaign_code"), "the round exists")
        campaign, batch = _next_id(campaigns), _next_id(batches)
        title = F.concat(F.lit("Round 2: "), F.substring("name", 1, TITLE))
        there = groups.select("answer", (number + batch - 1).alias("to"))
        new_campaigns = groups.select((number + campaign - 1).alias("id"), _code(own, number).alias("campaign_code"), title.alias("title"), F.lit(target).alias("target_scientific_name"), F.lit("open").alias("status"))
        new_batches = groups.select((number + batch - 1).alias("id"), (number + campaign - 1).alias("campaign_id"), _code(f"{BATCH}{code}-", number).alias("batch_code"), title.alias("title"), number.alias("position"), F.lit("open").alias("status"))
    rounds_ = batches.join(found.select(F.col("id").alias("campaign_id")), "campaign_id", "left_semi").select(F.col("id").alias("batch_id"))
    old = items.join(rounds_, "batch_id", "left_semi")
    had = old.count()
    fresh = staged(members.join(old.select("source_provider", "image_id"), ["source_provider", "image_id"], "left_anti"))
    last = old.groupBy(F.col("batch_id").alias("__b")).agg(F.max("position").alias("__last"))
    told = F.struct(*[F.lit(v).alias(k) for k, v in rule.items()])
    stamp = F.to_json(F.struct(
        F.lit(code).alias("round_code"), F.col("answer").alias("category"), told.alias("eligibility"), F.lit(at).alias("snapshot_at"), F.col("item_id").alias("original_item_id"), F.col("review_id").alias("effective_review_id")
    ))
    placed = round_plans.digest_positions(fresh.join(there, "answer").withColumn("__stamp", stamp), ["to"], "source_provider", "image_id", ["source_provider", "image_id"], "__rank")
    placed = _numbered(placed, placed.groupBy("to").agg(F.count(F.lit(1)).alias("n")), "to", "__rank").join(last, F.col("to") == F.col("__b"), "left")
    new_items = _members(items, placed, F.col("to"), F.coalesce("__last", F.lit(0)) + F.col("__rank"), _next_id(items))
    kept_campaigns, kept_batches = _retired(campaigns, batches, own, target)
    if reopen is not None:
        open_ = kept_campaigns.filter((F.col("status") == "open") & (F.col("target_scientific_name") == target)).join(reopen.select("campaign_code").distinct(), "campaign_code", "left_semi").select(F.col("id").alias("__open"))
        kept_batches = kept_batches.join(open_, F.col("campaign_id") == F.col("__open"), "left").withColumn("status", F.when(F.col("__open").isNotNull() & (F.col("status") == "closed"), "open").otherwise(F.col("status"))).drop("__open")
    out = Published(_added(kept_campaigns, new_campaigns), _added(kept_batches, new_batches), _added(items, new_items))
    _prove(Published(campaigns, batches, items), out, had + fresh.count(), own)
    return out


def imported(campaigns: DataFrame, batches: DataFrame, items: DataFrame, planned: DataFrame, code: str, title: str, target: str, prefix: str, size: int, status: str = "draft") -> Published:
    """A campaign with the batches and items of a plan (``batch_number``, ``position`` from 1, and columns of items).

    Aborts if the code is taken, if the status is neither draft nor open, or unless all batches
    but the last are full.
    """
    if status not in ("draft", "open"):
        raise ValueError("imported campaigns are draft or open")
    require_none(campaigns.filter(F.col("campaign_code") == code).select("campaign_code"), "the campaign exists")
    sizes = planned.groupBy("batch_number").agg(F.count(F.lit(1)).alias("n"))
    last = sizes.agg(F.max("batch_number").alias("last"), F.count(F.lit(1)).alias("all"))
    require_none(sizes.join(F.broadcast(last)).filter((F.col("all") != F.col("last")) | (F.col("n") > size) | (F.col("n") < size) & (F.col("batch_number") < F.col("last"))), "batches aren't full, or are missing")
    campaign, batch, item = _next_id(campaigns), _next_id(batches), _next_id(items)
    spark, number = items.sparkSession, F.col("batch_number")
    new_campaigns = spark.createDataFrame([(campaign, code, title, target, status)], "id long, campaign_code string, title string, target_scientific_name string, status string")
    name = _code(f"{prefix}-", number)
    new_batches = sizes.select((number + batch - 1).alias("id"), F.lit(campaign).alias("campaign_id"), name.alias("batch_code"), F.concat(F.lit("Batch "), name).alias("title"), number.alias("position"), F.lit(status).alias("status"))
    numbered = ranked(planned, [], ["batch_number", "position"], "__n")
    new_items = numbered.withColumns({"id": F.col("__n") + item - 1, "batch_id": number + batch - 1, "target_scientific_name": F.lit(target)})
    out = Published(_added(campaigns, new_campaigns), _added(batches, new_batches), _added(items, new_items.select(*[c for c in items.columns if c in new_items.columns])))
    _prove(Published(campaigns, batches, items), out, planned.count(), code)
    return out
