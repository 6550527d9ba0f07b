"""The map's snapshot: one JSON document named by its digest, and a pointer that vouches for it.

The document is bounded by the map's rules (100,000 images, 16 MiB), so one task may hold it;
both bounds are checked before anything is put together, and again before anything is read.
"""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import CheckFailed
from ..operators.map_rows import checked
from .sinks import _fs, publish

MOST_BYTES = 16 << 20
SHAPE = (
    "schema_version int, revision string, title string, image_count int, images array<struct<key: string, latitude: double, longitude: double, image_url: string, "
    "fallback_url: string, label: string, dataset_label: string, day: date, date: string>>, snapshot_url string, sha256 string"
)


def publish_map(images: DataFrame, title: str, folder: str, expected: int | None = None) -> str:
    """Checks ``images``, writes them once under their revision, and points ``current`` to it; returns the revision."""
    if not title.strip() or len(title) > 200:
        raise CheckFailed("a map needs a title of at most 200 characters")
    spark = images.sparkSession
    fields = [f.name for f in spark.createDataFrame([], SHAPE).schema["images"].dataType.elementType]
    row = checked(images, expected).select("key", F.to_json(F.struct(*fields)).alias("j"))
    size = row.agg(F.sum(F.octet_length("j") + 1).alias("s"), F.count(F.lit(1)).alias("n")).first()
    if size["s"] > MOST_BYTES - 2048:
        raise CheckFailed("the map's snapshot is too large")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "j"))), lambda x: x["j"]), ",")
    body = F.concat(F.lit(f'"title":{json.dumps(title)},"images":['), ordered, F.lit("]"))
    identity = row.agg(body.alias("body")).withColumn("revision", F.sha2("body", 256))
    document = identity.select("revision", F.concat(F.lit('{"schema_version":1,"revision":"'), "revision", F.lit(f'","image_count":{size["n"]},'), "body", F.lit("}")).alias("value"))
    found = document.select("revision", F.sha2("value", 256).alias("sha256")).first()
    target = f"{folder}/{found['revision']}"
    fs, p = _fs(spark, target)
    if not fs.exists(p):
        document.select("value").coalesce(1).write.text(target)
    pointer = {"schema_version": 2, "snapshot_url": target, "sha256": found["sha256"], "revision": found["revision"], "image_count": size["n"]}
    publish(spark.createDataFrame([(json.dumps(pointer),)], "value string"), f"{folder}/current", single=True)
    return found["revision"]


def _document(spark: SparkSession, path: str) -> DataFrame:
    fs, p = _fs(spark, path)
    if not fs.exists(p) or fs.getContentSummary(p).getLength() > MOST_BYTES:
        raise CheckFailed(f"{path}: no map data, or too large")
    return spark.read.parquet(path) if path.rstrip("/").endswith("current") else spark.read.text(path)


def read_map(spark: SparkSession, reference: str) -> DataFrame:
    """The images of a snapshot, or of what a pointer names; raises unless all that they say of themselves holds.

    A pointer needs a digest and a target on its own host; the document must have that digest,
    and the revision and number of images that the pointer tells.  Images are checked as for
    publishing.
    """
    said = _document(spark, reference).select(F.from_json("value", SHAPE).alias("d"), F.sha2("value", 256).alias("sha")).select("d.*", "sha")
    head = said.drop("images").first()
    if head is not None and head["schema_version"] == 2:
        pointer, target = head, head["snapshot_url"] or ""
        if not target or not re.fullmatch("[0-9a-f]{64}", pointer["sha256"] or ""):
            raise CheckFailed(f"{reference} isn't a pointer")
        if urlsplit(target)[:2] != urlsplit(reference)[:2]:
            raise CheckFailed(f"{reference} points to another host")
        said = _document(spark, target).select(F.from_json("value", SHAPE).alias("d"), F.sha2("value", 256).alias("sha")).select("d.*", "sha")
        head = said.drop("images").first()
        if head is None or (head["sha"], head["revision"], head["image_count"]) != (pointer["sha256"], pointer["revision"], pointer["image_count"]):
            raise CheckFailed(f"{target} isn't what {reference} vouches for")
    if head is None or head["schema_version"] != 1 or not (head["title"] or "").strip() or not 0 < len(head["revision"] or "") <= 128:
        raise CheckFailed(f"{reference} isn't a map")
    return checked(said.select(F.explode("images").alias("i")).select("i.*"), head["image_count"] or 0)
