"""Rows of the review map: made from items, held to its rules, selected for download."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_years
from ..functions.geo import cell, cell_centre, valid_point
from .checks import CheckFailed, require_none

#: The map's northernmost latitude, its most images, and the most characters of its texts.
MOST_LATITUDE, MOST_IMAGES = 86.0, 100_000
KEY_LENGTH, LABEL_LENGTH, DATASET_LENGTH, URL_LENGTH = 128, 500, 120, 4096
#: Names that the map offers before any data set's own.
FIRST_GROUPS = ("Papilio demoleus", "Papilio demodocus", "Other")


def image_key(provider: Column, source_key: Column) -> Column:
    """The opaque key of an image: the first half of a digest of provider and source key."""
    return F.substring(F.sha2(F.concat(provider, F.lit("\n"), source_key), 256), 1, 32)


def _secure(url: Column) -> Column:
    plain = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(plain & (F.char_length(url) <= URL_LENGTH) & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))


def problems(images: DataFrame) -> DataFrame:
    """``images`` with ``problem``: the first of the map's rules that a row breaks, or null.

    Columns: ``key``, ``latitude``, ``longitude``, ``label``, ``dataset_label``, ``image_url``
    and ``fallback_url``.  Labels and the fallback may be null or empty.  Of rows with one key,
    all break a rule.  Other columns stay.
    """
    control = r"[\x00-\x1f]"
    label, dataset = F.coalesce("label", F.lit("")), F.coalesce("dataset_label", F.lit(""))
    repeated = images.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    rules = (
        ("no usable key", F.coalesce(F.char_length("key"), F.lit(0)).between(1, KEY_LENGTH)),
        ("a key that repeats", F.col("__n").isNull()),
        ("no usable coordinates", valid_point(F.col("latitude"), F.col("longitude"), MOST_LATITUDE)),
        ("a bad label", (F.char_length(label) <= LABEL_LENGTH) & ~label.rlike(control)),
        ("a bad image address", _secure(F.col("image_url"))),
        ("a bad fallback address", (F.coalesce("fallback_url", F.lit("")) == "") | _secure(F.col("fallback_url"))),
        ("a bad data set", (F.char_length(dataset) <= DATASET_LENGTH) & (F.trim(dataset) == dataset) & ~dataset.rlike(control)),
    )
    found = F.coalesce(*[F.when(~holds, F.lit(name)) for name, holds in rules])
    return images.join(repeated, "key", "left").withColumn("problem", found).drop("__n").select(*images.columns, "problem")


def checked(images: DataFrame, expected: int | None = None, most: int = MOST_IMAGES) -> DataFrame:
    """``images`` as they are; raises if one breaks a rule, or there are none, more than ``most`` or not as many as expected."""
    n = images.count()
    if not 0 < n <= most or expected not in (None, n):
        raise CheckFailed(f"{n} images")
    require_none(problems(images).filter("problem IS NOT NULL").select("key", "problem"), "images break the map's rules")
    return images


def placed(images: DataFrame) -> DataFrame:
    """``images`` with their display cell: its name and its centre, which is all that leaves the server."""
    column, row = cell(F.col("latitude"), F.col("longitude"))
    whole = images.withColumns({"cell_column": column, "cell_row": row})
    lat, lon = cell_centre(F.col("cell_column"), F.col("cell_row"))
    return whole.withColumns({"cell": F.concat_ws(":", "cell_column", "cell_row"), "cell_latitude": lat, "cell_longitude": lon}).drop("cell_column", "cell_row")


def selected(images: DataFrame, wanted: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """(``place``, ``image_url``, ``date``, ``geotag``, ``label``) of the images of ``wanted`` (``place``, ``key``).

    Exactly what was asked for: a key that repeats, or of no image that ``years`` leaves
    visible, aborts.  The geotag is the cell's centre; labels are safe for spreadsheets.
    ``day`` and ``date`` are the image's resolved day and its text.
    """
    shown = images.filter(in_years(F.col("day"), *years)) if years else images
    require_none(wanted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR key IS NULL"), "the selection repeats keys")
    require_none(wanted.join(shown, "key", "left_anti").select("key"), "the selection has changed")
    label = F.coalesce("label", F.lit(""))
    found = placed(shown.join(wanted.select("place", "key"), "key"))
    return found.select(
        "place", F.coalesce(F.when(F.col("fallback_url") != "", F.col("fallback_url")), F.col("image_url")).alias("image_url"), F.coalesce("date", F.lit("")).alias("date"),
        F.format_string("%.6f, %.6f", "cell_latitude", "cell_longitude").alias("geotag"), F.when(label.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), label)).otherwise(label).alias("label"),
    )


def groups(images: DataFrame) -> DataFrame:
    """(``place``, ``name``): groups that can be selected, the fixed ones first, then data sets by name."""
    own = images.filter(F.coalesce("dataset_label", F.lit("")) != "").select(F.col("dataset_label").alias("name")).distinct().filter(~F.col("name").isin(*FIRST_GROUPS))
    first = images.sparkSession.createDataFrame([*enumerate(FIRST_GROUPS)], "place int, name string")
    return first.unionByName(own.select(F.lit(len(FIRST_GROUPS)).alias("place"), "name"))
