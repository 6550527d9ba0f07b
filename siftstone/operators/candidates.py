"""Candidate rows: normalising, checking, collecting what isn't known."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import https_url
from .rounds import ranked
from .staging import staged


def trimmed(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def normalise(df: DataFrame, required: Mapping[str, int], optional: Mapping[str, int], url: str) -> DataFrame:
    """``df`` with trimmed texts and ``problem``: the first rule that a row breaks, or null.

    ``required`` and ``optional`` give the most characters of each column.
    """
    out = df.withColumns({c: trimmed(F.col(c)) for c in (*required, *optional)})
    problem = F.lit(None).cast("string")
    for name, most in reversed([*required.items(), *optional.items()]):
        problem = F.when(F.char_length(name) > most, f"{name} is too long").otherwise(problem)
    for name in reversed([*required]):
        problem = F.when(F.col(name).isNull(), f"{name} is missing").otherwise(problem)
    problem = F.coalesce(problem, F.when(~https_url(F.col(url)), f"{url} isn't a plain https address"))
    return out.withColumn("problem", problem)


def parsed_json(df: DataFrame, column: str, fallback: str | None = None, object_: bool = False) -> DataFrame:
    """``df`` of :func:`normalise` with ``column`` as JSON text that parses, or null; ``problem`` says where it doesn't.

    Where the column is null that of ``fallback`` counts.  An empty text, a number that isn't
    finite and, with ``object_``, anything but an object are problems; a problem found before
    comes first.
    """
    value = F.coalesce(F.col(column), F.col(fallback)) if fallback else F.col(column)
    known = F.try_parse_json(value)
    bad = F.when(value.isNotNull() & known.isNull(), f"{column} isn't JSON")
    if object_:
        bad = F.coalesce(bad, F.when(~F.schema_of_variant(known).startswith("OBJECT"), f"{column} isn't an object"))
    return df.withColumns({"problem": F.coalesce("problem", bad), column: F.when(known.isNotNull(), value)})


def with_extras(df: DataFrame, known: Sequence[str], metadata: str) -> DataFrame:
    """Columns beyond ``known`` go into the map ``metadata`` and win over keys that it has; nulls and NaN are left out."""
    extras = [c for c in df.columns if c not in known and c != metadata]
    entries = []
    for c in extras:
        kind = df.schema[c].dataType.simpleString()
        value = F.col(c).cast("string")
        gone = F.isnan(c) if kind in ("double", "float") else F.lit(False)
        entries.append(F.struct(F.lit(c).alias("key"), F.when(~gone, value).alias("value")))
    own = F.filter(F.array(*entries), lambda e: e["value"].isNotNull()) if entries else F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)")
    base = F.coalesce(F.map_entries(metadata), F.slice(own, 1, 0))
    kept = F.filter(base, lambda e: ~F.exists(own, lambda x: x["key"] == e["key"]))
    return df.withColumn(metadata, F.map_from_entries(F.concat(kept, own))).drop(*extras)


def repeated_in_batch(df: DataFrame, batch: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Keys that occur twice within one batch, which is what counts after a shuffle."""
    return df.groupBy(*batch, *key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: Rows of a block, in rows of a chunk, and at least.
BLOCK_CHUNKS, BLOCK_ROWS = 32, 1 << 15


def _next(sizes: np.ndarray, most_bytes: int, most_rows: int) -> np.ndarray:
    """For each row the one where a chunk that begins with it would end."""
    ends = np.concatenate([[0], sizes.cumsum()])
    at = np.arange(len(sizes))
    fits = np.searchsorted(ends, ends[:-1] + most_bytes, "right") - 1
    return np.minimum(np.maximum(fits, at + 1), at + most_rows)


def byte_chunks(df: DataFrame, group: str, order: Sequence[str], size: str, most_bytes: int, most_rows: int, name: str = "chunk") -> DataFrame:
    """Numbers chunks of consecutive rows of each group: full at so many bytes or rows, then a new one begins.

    A chunk's begin depends on where the last one ended, but a group goes through no single
    pass: its rows are cut into blocks, and each block tells, for every row with which the
    first chunk that begins in it could begin (a chunk has ``most_rows`` rows at most, so
    these are few), how many chunks begin in it and where the next block's first one does.
    These small tables are followed from block to block, and then each block numbers its own
    rows.  Sizes that are null count as nothing.
    """
    block = max(BLOCK_ROWS, BLOCK_CHUNKS * most_rows)
    rows = staged(ranked(df, [group], order, "__i").withColumn("__i", F.col("__i") - 1))
    kind = df.schema[group].dataType.simpleString()
    sizes = rows.select(F.col(group).alias("__g"), "__i", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("__s"))
    of = F.floor(F.col("__i") / block).cast("long")
    # A block also sees the rows that its last chunk may reach.
    seen = sizes.withColumn("__b", F.explode(F.when((F.col("__i") % block < most_rows) & (of > 0), F.array(of, of - 1)).otherwise(F.array(of))))

    def sorted_(part: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        part = part.sort_values("__i")
        begin = int(part["__b"].iloc[0]) * block
        return begin, int((part["__i"] < begin + block).sum()), _next(part["__s"].to_numpy(np.int64), most_bytes, most_rows)

    def table(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        begin, own, after = sorted_(part)
        chunks, leaves = np.zeros(own, np.int64), after[:own].copy()
        for k in range(own - 1, -1, -1):  # where the chain of chunks from each row leaves the block
            if leaves[k] < own:
                chunks[k], leaves[k] = chunks[leaves[k]] + 1, leaves[leaves[k]]
            else:
                chunks[k] = 1
        few = min(most_rows, own)
        return pd.DataFrame({"__g": [key[0]] * few, "__b": begin // block, "e": np.arange(few), "n": chunks[:few], "x": leaves[:few] - own})

    tables = seen.groupBy("__g", "__b").applyInPandas(table, f"__g {kind}, __b long, e long, n long, x long")
    # Of a group's blocks one row for each: the tables as arrays, followed in order.
    lists = tables.groupBy("__g", "__b").agg(F.sort_array(F.collect_list(F.struct("e", "n", "x"))).alias("t"))

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__b", ignore_index=True)
        enters, firsts, enter, first = [], [], 0, 0
        for t in part["t"]:
            enters.append(enter)
            firsts.append(first)
            if enter < len(t):
                first, enter = first + int(t[enter]["n"]), int(t[enter]["x"])
            else:  # a chunk that covers the whole of a short last block
                enter = 0
        return part[["__g", "__b"]].assign(enter=enters, first=firsts)

    states = lists.groupBy("__g").applyInPandas(follow, f"__g {kind}, __b long, enter long, first long")

    def number(key: tuple, part: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        begin, own, after = sorted_(part)
        at, chunk = int(state["enter"].iloc[0]), int(state["first"].iloc[0])
        out = np.full(own, chunk, np.int64)  # what comes before belongs to the last block's chunk
        while at < own:
            chunk += 1
            out[at : after[at]] = chunk
            at = int(after[at])
        return pd.DataFrame({"__g": [key[0]] * own, "__j": begin + np.arange(own), name: out})

    numbered = seen.groupBy("__g", "__b").cogroup(states.groupBy("__g", "__b")).applyInPandas(number, f"__g {kind}, __j long, {name} int")
    return rows.join(numbered, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__i") == F.col("__j"))).drop("__g", "__j", "__i")
