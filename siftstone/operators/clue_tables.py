"""What is made of a clue analysis: hints, grouped payloads, subsets, and the validator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clues import GROUPS
from .evidence import tags

HOUR, DAY = "within_1_hour", "within_24_hours"


def hint(parts: dict[str, Column]) -> Column:
    """A line that sums up what speaks for a place: the parts that aren't null, by name, with bars between them."""
    return F.concat_ws(" | ", *[F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"))) for name, value in parts.items()])


def clue_payload(clues: DataFrame, key: str, kind: str, value: str, at: str) -> DataFrame:
    """(key, ``payload``, ``content_sha256``): a photo's clues as JSON: their kinds, the first by ``GROUPS``, and the latest value of each kind.

    The digest is that of the payload without itself.  Kinds that ``GROUPS`` lacks abort.
    """
    known = F.when(F.col(kind).isin(*GROUPS), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown clue: "), F.coalesce(F.col(kind), F.lit("null")))))
    rows = clues.withColumn(kind, known)
    latest = rows.groupBy(key, kind).agg(F.max_by(value, F.struct(at, value)).alias("v"))
    values = latest.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "v")))).alias("latest"))
    found = tags(rows, key, kind, GROUPS).join(values, key)
    body = F.to_json(F.struct(F.col("latest"), F.col("primary_tag").alias("primary"), F.col("tags").alias("tags")))
    return found.select(key, body.alias("payload"), F.sha2(body, 256).alias("content_sha256"))


def neighbour_subsets(summary: DataFrame, neighbours: DataFrame, key: str, priority: Column) -> DataFrame:
    """(key, ``subset``): photos with a neighbour within an hour before, or after, and those that are a priority."""
    hour = neighbours.filter(F.col("time_window") == HOUR)
    before = hour.filter("relation = 'earlier'").select(key, F.lit("hour_before").alias("subset"))
    after = hour.filter("relation = 'later'").select(key, F.lit("hour_after").alias("subset"))
    first = summary.filter(priority).select(key, F.lit("priority").alias("subset"))
    return before.unionByName(after).unionByName(first).distinct()


def violations(photos: DataFrame, summary: DataFrame, evidence: DataFrame, neighbours: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """(``rule``, ``rows``): how many rows of an analysis break each rule; zeros stay.

    Every photo has one summary and no other has any; evidence and neighbours belong to
    photos and have known kinds; a neighbour is within its window, and of each photo, window
    and relation there is one at most.
    """
    limit = F.when(F.col("time_window") == HOUR, 60).otherwise(1440)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    each = neighbours.groupBy(key, "time_window", "relation").agg(F.count(F.lit(1)).alias("near"), F.count_if(F.abs("minutes") > limit).alias("outside"))
    tables = [
        (photos.select(key).distinct(), {"own": one}),
        (summary, {"summed": one}),
        (evidence, {"evidence": one, "unknown": (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).cast("long")}),
        (each, {"near": F.col("near"), "outside": F.col("outside"), "repeated": (F.col("near") > 1).cast("long")}),
    ]
    names = [n for _, columns in tables for n in columns]
    # one row of counts for each key, from a single pass over each table
    counted = reduce(DataFrame.unionByName, [df.select(key, *[columns.get(n, none).alias(n) for n in names]) for df, columns in tables]).groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    owned = (F.col("own") > 0) & F.col(key).isNotNull()
    rows = {
        "photos without a summary": F.count_if((F.col("own") > 0) & ~(owned & (F.col("summed") > 0))),
        "summaries without a photo": F.sum(F.when(~owned, F.col("summed"))),
        "photos with several summaries": F.count_if(F.col("summed") > 1),
        "evidence without a photo": F.sum(F.when(~owned, F.col("evidence"))),
        "evidence of unknown kind": F.sum("unknown"),
        "neighbours without a photo": F.sum(F.when(~owned, F.col("near"))),
        "neighbours outside their window": F.sum("outside"),
        "repeated neighbours": F.sum("repeated"),
    }
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(n, none).alias("rows")) for name, n in rows.items()])
    return counted.agg(rules.alias("rules")).select(F.explode("rules").alias("r")).select("r.*")
