"""Exports of reviews and of their consensus, with fixed columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .consensus import plurality, with_flags

#: The columns of the exports, and those that lean ones leave out.
RAW_COLUMNS = (
    "campaign_code target_scientific_name batch_code image_id source_provider source_record_id image_url display_url flickr_search_term flickrKeyword scientificName "
    "source_labels pipeline_metadata human_label comment reviewer_uuid identifiedBy reviewed_at schema_version client_version"
).split()
CONSENSUS_COLUMNS = (
    "campaign_code target_scientific_name batch_code image_id source_provider source_record_id image_url display_url flickr_search_term source_labels pipeline_metadata "
    "human_label review_count reviews_unanimous consensus_tied reviewed_at schema_version"
).split()
BULKY = ("source_labels", "pipeline_metadata")
#: Labels, the first wins a tie, and what is derived from them.
LABELS = (
    "model_scientific_name target_scientific_name adult_butterfly caterpillar moth other_insect arachnid other_arthropod mammal_or_person bird other_animal plant fungus "
    "artifact_or_illustration no_biological_subject uncertain image_unavailable target_not_present no_butterfly flickr_keyword_match"
).split()
EXCLUDED = "excluded_from_automatic_training"
DERIVED = {
    "matches_flickr_keyword": ["flickr_keyword_match"],
    "matches_target_scientific_name": ["target_scientific_name"],
    "target_not_present": ["target_not_present"],
    "is_insecta_positive": ["adult_butterfly", "caterpillar", "moth", "other_insect"],
    "is_lepidoptera_evidence": ["adult_butterfly", "caterpillar", "moth"],
    "is_butterfly_positive": ["adult_butterfly"],
    "is_butterfly_negative": ["no_butterfly"],
    "is_butterfly_hard_negative": ["moth", "other_insect", "arachnid", "other_arthropod"],
    EXCLUDED: ["uncertain", "image_unavailable", "target_not_present", "no_butterfly", "model_scientific_name"],
}


def label_dimension(spark: SparkSession) -> DataFrame:
    """(``code``, ``priority`` from 0, ``groups``): the labels and what is derived from them."""
    rows = [(x, k, sorted(g for g, members in DERIVED.items() if x in members)) for k, x in enumerate(LABELS)]
    return spark.createDataFrame(rows, "code string, priority int, groups array<string>")


def _described(campaigns: DataFrame, batches: DataFrame, items: DataFrame, campaign: str | None) -> DataFrame:
    """Items with what is known of their batch and campaign."""
    c = campaigns.select(F.col("id").alias("campaign_id"), "campaign_code", "target_scientific_name")
    if campaign is not None:
        c = c.filter(F.col("campaign_code") == campaign)
    b = batches.select(F.col("id").alias("batch_id"), "campaign_id", "batch_code", F.col("position").alias("batch_position"))
    return items.drop("target_scientific_name").withColumnsRenamed({"id": "item_id", "position": "item_position", "created_at": "item_created_at"}).join(b.join(c, "campaign_id"), "batch_id")


def raw_export(campaigns: DataFrame, batches: DataFrame, items: DataFrame, reviews: DataFrame, schema_version: str, campaign: str | None = None, lean: bool = False, derived: bool = False) -> DataFrame:
    """A row for each review, in the order of batch, item, time and identifier.

    ``lean`` leaves the bulky columns out before they are read; ``derived`` adds the flags
    of ``DERIVED``, null for a null label.
    """
    rows = reviews.join(_described(campaigns, batches, items, campaign), "item_id").withColumns(
        {"human_label": F.col("label"), "reviewer_uuid": F.col("reviewer_id"), "reviewed_at": F.col("updated_at"), "schema_version": F.lit(schema_version)}
    )
    out = rows.orderBy("batch_position", "item_position", "created_at", "id").select(*[c for c in RAW_COLUMNS if not (lean and c in BULKY)])
    return out.withColumns({name: F.col("human_label").isin(labels) for name, labels in DERIVED.items()}) if derived else out


def consensus_export(campaigns: DataFrame, batches: DataFrame, items: DataFrame, reviews: DataFrame, schema_version: str, campaign: str | None = None, lean: bool = False, derived: bool = False) -> DataFrame:
    """A row for each item with reviews: the label of most, ties broken by ``LABELS``; in bytewise order of campaign, batch and image.

    With ``derived`` a tied label is excluded from training whatever it is.
    """
    votes = plurality(reviews, ["item_id"], "label", "updated_at", LABELS)
    rows = _described(campaigns, batches, items, campaign).join(votes, "item_id").withColumns(
        {"human_label": F.col("consensus_label"), "reviews_unanimous": F.col("unanimous"), "consensus_tied": F.col("tied"), "schema_version": F.lit(schema_version)}
    )
    if derived:
        rows = with_flags(rows, "human_label", DERIVED, "consensus_tied", EXCLUDED)
    columns = [c for c in CONSENSUS_COLUMNS if not (lean and c in BULKY)] + list(DERIVED) * derived
    return rows.orderBy("campaign_code", "batch_code", "image_id").select(*columns)
