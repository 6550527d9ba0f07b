"""Exact dedup by content sort.

Rows are range-partitioned by their normalised bytes: Spark samples splitters from the
data, shuffles each row once, and sorts every range with its external (spilling) sorter, so
that equal texts stand next to each other.  A window over the sorted rows compares whole
neighbouring texts and keeps one row of each run of equals.

The splitter is the normalised text's first bytes followed by a hash of the whole text:
equal texts have equal splitters, a splitter that the driver samples has a bounded size
however long the texts are, and texts with one long common beginning still spread out.

Hot groups.  A text that more than ``1 / HOT_SHARE`` of all rows share is dealt over
several ranges by a salt made of the identifier, so that no range holds more than about
that share; at most ``HOT_SHARE`` texts can be so frequent.  What the ranges of a salted
text found is replaced by one aggregate over that text, combined before its shuffle.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: A text is hot from this share of the rows (one in so many) ...
HOT_SHARE = 1000
#: ... but never below so many rows.
HOT_LEAST = 64
#: Characters of the normalised text in a splitter.
SPLITTER = 48


def _coarse(text: Column) -> Column:
    """Equal for texts that are equal after normalisation, cheaper than normalising."""
    return F.xxhash64(F.lower(text))


def _runs(df: DataFrame, id_col: str, text_col: str, largest: bool, payload: bool) -> DataFrame:
    """``df``'s rows with what is known of their group.

    Adds ``__id``, ``__keep``, ``__size``, ``__kept``, ``__sha`` (and drops the text unless
    ``payload``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.count()
    least = max(HOT_LEAST, rows // HOT_SHARE)
    hot = (
        df.select(_coarse(text).alias("__hot"))
        .groupBy("__hot")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > least)
        .select("__hot", F.ceil(F.col("__n") / F.lit(least)).cast("int").alias("__salts"))
    )  # at most HOT_SHARE rows, since each stands for more than 1 / HOT_SHARE of the input
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row") if payload else F.lit(0).alias("__row"),
        F.col(id_col).alias("__id"),
        text.alias("__text"),
        ascii_lower(F.substring(text, 1, SPLITTER)).alias("__splitter"),
        _coarse(text).alias("__hash"),
    )
    salted = keyed.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__id"), F.col("__salts")).cast("int"))
    )
    ranged = salted.repartitionByRange("__splitter", "__hash", "__salt").withColumn("__norm", ascii_lower(F.col("__text")))
    run = Window.partitionBy("__splitter", "__hash", "__salt", "__norm")
    first = run.orderBy(F.desc_nulls_last("__id") if largest else F.asc_nulls_last("__id"))
    found = ranged.select(
        "__row",
        "__id",
        F.col("__hot").isNotNull().alias("__was_hot"),
        F.first("__id").over(first).alias("__lead"),
        F.row_number().over(first).alias("__rank"),
        F.count(F.lit(1)).over(run).alias("__n"),
        F.sha2("__norm", 256).alias("__sha"),
    )
    of_hot = (
        keyed.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"))
        .groupBy(ascii_lower(F.col("__text")).alias("__norm"))
        .agg((F.max if largest else F.min)("__id").alias("__hot_lead"), F.count(F.lit(1)).alias("__hot_n"))
        .select(F.sha2("__norm", 256).alias("__hot_sha"), "__hot_lead", "__hot_n")
    )
    return found.join(of_hot, F.col("__was_hot") & (F.col("__sha") == F.col("__hot_sha")), "left").select(
        "__row",
        "__id",
        F.when(F.col("__was_hot"), F.col("__hot_lead")).otherwise(F.col("__lead")).alias("__keep"),
        F.when(F.col("__was_hot"), F.col("__hot_n")).otherwise(F.col("__n")).alias("__size"),
        ((F.col("__rank") == 1) & (~F.col("__was_hot") | F.col("__lead").eqNullSafe(F.col("__hot_lead")))).alias("__kept"),
        "__sha",
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``df``: its identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z.  ``keep`` says whether
    the smallest or the largest identifier of a group stays.  A null text counts as empty.
    Null identifiers yield to any other; of rows that share the winning identifier (repeated
    rows) exactly one is ``kept``.  An empty table gives an empty result.  Other columns of
    ``df`` are not read, whatever their names.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return _runs(narrow, "i", "t", _largest(keep), False).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").cast("long").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all of its columns; rules as in :func:`exact_groups`."""
    return _runs(df, id_col, text_col, _largest(keep), True).filter("__kept").select("__row.*")


def _largest(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return keep == "largest"
