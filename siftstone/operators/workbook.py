"""Rows of workbooks: sheets, their names, and cells that are too long for one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utf16_parts
from .consensus import strict_majority
from .evidence import distinct_names
from .hygiene import location_group
from .rounds import ranked

#: UTF-16 units of a cell, characters of a sheet's name and those that it can't hold.
CELL_UNITS, NAME_LENGTH, FORBIDDEN = 32_767, 31, r"[\[\]:*?/\\]"
ALL, CLASSIFIED, OPEN = "All", "Classified", "Non-classified"


def continued(df: DataFrame, columns: Sequence[str], most: int = CELL_UNITS) -> DataFrame:
    """``df`` with texts cut into cells of ``most`` UTF-16 units: what goes on stands in ``<column>__part_2`` and so on.

    There are as many further columns as the longest text needs, which one aggregate tells;
    rows with shorter texts hold null there.
    """
    parts = df.withColumns({f"__{c}": utf16_parts(F.col(c), F.lit(most)) for c in columns})
    need = parts.agg(*[F.coalesce(F.max(F.size(f"__{c}")), F.lit(1)).alias(c) for c in columns]).first()
    out = parts
    for c in columns:
        out = out.withColumn(c, F.get(f"__{c}", 0))
        for k in range(2, need[c] + 1):
            out = out.withColumn(f"{c}__part_{k}", F.get(f"__{c}", k - 1))
    return out.drop(*[f"__{c}" for c in columns])


def capacities(df: DataFrame, columns: Sequence[str], most: int = CELL_UNITS) -> DataFrame:
    """One row: how many cells the longest text of each column takes."""

    def cells(c: str) -> Column:
        text = F.col(c)
        plain = ~text.rlike(r"[\x{10000}-\x{10FFFF}]")  # no character of two units, which a cut may not part
        return F.when(plain, F.greatest(F.ceil(F.char_length(text) / most), F.lit(1))).otherwise(F.size(utf16_parts(F.when(~plain, text), F.lit(most))))

    return df.agg(*[F.coalesce(F.max(cells(c)), F.lit(1)).cast("long").alias(c) for c in columns])


def sheet_names(titles: Sequence[str]) -> dict[str, str]:
    """A name for each title: without what names can't hold, 31 characters at most, and unlike any other in whatever case."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for title in titles:
        plain = re.sub(FORBIDDEN, " ", title).strip().strip("'")[:NAME_LENGTH] or "Sheet"
        name, k = plain, 2
        while name.casefold() in taken:
            end = f" ({k})"
            name, k = plain[: NAME_LENGTH - len(end)] + end, k + 1
        taken.add(name.casefold())
        out[title] = name
    return out


def review_sheets(df: DataFrame, label: str) -> DataFrame:
    """Each row in the sheet of all and in that of its kind (``sheet``): with or without a label."""
    own = F.when(F.col(label).isNotNull() & (F.col(label) != ""), CLASSIFIED).otherwise(OPEN)
    return df.withColumn("sheet", F.explode(F.array(F.lit(ALL), own)))


def classification_sheets(votes: DataFrame, item: Sequence[str], label: str, disputed: str = "Disputed") -> DataFrame:
    """(item, ``result``, ``place``): the result by strict majority; sheets stand in the order of their names, disputed ones last."""
    found = strict_majority(votes, item, label, disputed)
    # a row for each label, of which there may be many: their order is a rank, not an expression
    kinds = ranked(found.select((F.col("result") == disputed).alias("__last"), F.col("result").alias("__r")).distinct(), [], ["__last", "__r"], "place")
    return found.join(kinds.select("__r", "place"), F.col("result") == F.col("__r")).drop("__r")


def location_sheets(images: DataFrame, status: str, hints: Sequence[str], key: str) -> DataFrame:
    """``images`` with ``sheet``; every image is in exactly one, and an unknown status aborts.

    ``hints`` are columns of clues; one that isn't null (or empty, or zero) makes an image a
    priority.
    """
    has = F.lit(False)
    for c in hints:
        kind = images.schema[c].dataType.typeName()
        has = has | F.coalesce((F.size(c) > 0) if kind == "array" else (F.col(c) > 0) if kind in ("integer", "long") else F.col(c).isNotNull(), F.lit(False))
    return images.withColumn("priority", has).withColumn("sheet", location_group(F.col("priority"), F.col(status)))


def sheet_receipt(sheets: DataFrame, key: str, name: str) -> DataFrame:
    """(``sheet``, ``images``, ``rows``, ``names``): what a writer reports; ``images`` equals ``rows`` if no image repeats."""
    counts = sheets.groupBy("sheet").agg(F.countDistinct(key).alias("images"), F.count(F.lit(1)).alias("rows"))
    return counts.join(distinct_names(sheets, ["sheet"], name), "sheet")
