"""The review cursor: which item comes, what stands around it, and what is known of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .progress import batch_progress, prior_review, resume, seek

#: Fixed value: a label of old versions, which is shown as none.
LEGACY_LABEL = "flickr_keyword_match"


def predictions(items: DataFrame, item: str, metadata: str, model: str) -> DataFrame:
    """(item, ``name``, ``cosine``): what a model says of each item; items without a sound answer have no row.

    ``metadata`` is JSON.  The first of the ten best, else of the five best, counts; its name
    has 1 to 500 characters and no blanks around it, its cosine is a number from -1 to 1.
    """

    def of(path: str) -> Column:
        return F.get_json_object(metadata, path)

    name = F.coalesce(of("$.bioclip.top10[0].scientific_name"), of("$.bioclip.top5[0].scientific_name"))
    value = F.coalesce(of("$.bioclip.top10[0].cosine"), of("$.bioclip.top5[0].cosine")).try_cast("double")
    found = items.filter(of("$.bioclip.attestation.model") == model).select(item, name.alias("name"), value.alias("cosine"))
    return found.filter((F.trim("name") == F.col("name")) & F.char_length("name").between(1, 500) & F.col("cosine").between(-1, 1))


def shown_label(label: Column) -> Column:
    """A label as reviewers see it."""
    return F.when(label != LEGACY_LABEL, label)


def queue_limit(asked: Column) -> Column:
    """How many items a queue hands out: one or two, two unless asked otherwise."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(2)), F.lit(1)), F.lit(2))


def canonical(provider: str = "source_provider", record: str = "source_record_id", image: str = "image_id") -> list[Column]:
    """What tells an image apart wherever it is: its provider with its record, or its own identifier if it has none."""
    return [F.col(provider).alias("key_provider"), F.coalesce(F.when(F.col(record) != "", F.col(record)), F.col(image)).alias("key_record")]


def review_cursor(batches: DataFrame, items: DataFrame, reviews: DataFrame, caller: str, model: str, shown: Sequence[str] = ("image_id", "source_provider")) -> DataFrame:
    """One row for each open batch with items: the item with which ``caller`` goes on.

    It is the first that the caller hasn't reviewed, else the first.  Around it stand the
    next and the previous position (the ends meet), the batch's progress, the model's
    prediction, the caller's own label, and whether the image was reviewed in another batch.
    """
    open_ = batches.filter("status = 'open'").select(F.col("id").alias("batch_id"), "batch_code")
    rows = items.select(F.col("id").alias("item_id"), "batch_id", "position", "pipeline_metadata", *canonical(), *shown).join(open_.select("batch_id"), "batch_id")
    own = reviews.filter(F.col("reviewer_id") == caller).groupBy("item_id").agg(F.max_by("label", F.struct("updated_at", "id")).alias("own_label"))
    marked = rows.join(own.withColumn("reviewed", F.lit(True)), "item_id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    first = resume(marked, ["batch_id"], "position", "item_id", "reviewed").select("batch_id", "item_id", "position")
    around = seek(rows, first.select("batch_id", F.col("position").alias("anchor")), ["batch_id"], "position", "anchor").drop("anchor")
    progress = batch_progress(open_, rows.select("batch_id", "item_id"), reviews.select("item_id", "reviewer_id"), "batch_id", "item_id", "reviewer_id", caller)
    everywhere = items.select(F.col("id").alias("item_id"), "batch_id", *canonical()).join(reviews.select("item_id").distinct(), "item_id", "left_semi")
    detail = marked.drop("position", "batch_id").join(first, "item_id")
    prior = prior_review(detail, everywhere, ["key_provider", "key_record"], "batch_id")
    said = predictions(rows, "item_id", "pipeline_metadata", model)
    out = prior.join(said, "item_id", "left").join(around, "batch_id").join(progress, "batch_id")
    return out.select(
        "batch_id", "batch_code", "item_id", "position", *shown, "next_position", "previous_position", "total", "team", "personal", "complete",
        F.col("name").alias("predicted_name"), "cosine", shown_label(F.col("own_label")).alias("own_label"), "previously_reviewed",
    )
