"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has a bit for the majority of each bit of the shingles' hashes.  To find all
pairs of fingerprints within ``radius`` bits, each bit position gets a non-zero vector of
``radius + 1`` bits, and each non-zero vector ``v`` a table: its mask keeps the positions
whose vector has an odd product with ``v``.  Two fingerprints that differ in ``radius``
positions at most differ, for some ``v``, in none of the kept ones (so many linear
equations in one more unknown have a solution other than zero), so they are certain to
share a bucket in some table; nothing within the radius is missed.

Equal fingerprints are one node from the start.  Buckets are compared inside a task, which
returns a spanning set of links, not all pairs.  Buckets above ``HOT_BUCKET`` fingerprints
take an exact way without comparisons: fingerprints of one bucket that agree after
clearing the same ``radius`` positions of those that the mask leaves free form a group of
``2 ** radius`` at most, all within the radius, and every link in the bucket is in one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import least_reachable

BITS = 64
SEED = 42
#: Decides the vectors of positions where there are more of them than positions.
MASK_SEED = 158
#: A bucket of more fingerprints takes the other way.
HOT_BUCKET = 512
#: Buckets up to this size are compared all at once.
SMALL_BUCKET = 24


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The kept positions of each table.

    If there are more vectors than positions, positions get distinct ones at random.
    """
    count = (1 << radius + 1) - 1
    vectors = [1 + i % count for i in range(bits)] if count <= bits else random.Random(MASK_SEED).sample(range(1, count + 1), bits)
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, count + 1)]
    assert len(set(kept)) == count and all(bits <= 4 * m.bit_count() <= 3 * bits for m in kept), "a mask keeps far from half of the bits"
    return kept


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def fingerprint(text: str | None, width: int, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, unsigned.

    Words are what stands between ASCII white space, after lower-casing A-Z; a text with
    fewer words than a shingle is one shingle, and a text without words has fingerprint 0.
    A bit is 1 if it is set in more than half of the shingles' hashes, repeats included.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    counts = np.zeros(BITS, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + width - 1]
        hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(width)), strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``fp``): fingerprints as signed 64-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch["t"].tolist()]
            yield pd.DataFrame({"id": batch["i"], "fp": np.array(fps, np.uint64).view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInPandas(run, "id string, fp bigint")
    return rows.withColumn("id", F.col("id").cast(kind))  # as strings, since pandas has no null among integers


def spanning(words: list[np.ndarray], group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are linked, enough pairs to connect what all links connect.

    ``words`` are the fingerprints' 64-bit words; ``group`` tells buckets apart and ascends.
    """

    def near(i, j) -> np.ndarray:
        return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words) <= limit

    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[begins, len(group)])
    xs, ys = [group[:0]], [group[:0]]
    # Small buckets: all of them at once, each row with the next, the one after, ...
    ahead = np.where(np.repeat(sizes, sizes) <= SMALL_BUCKET, np.repeat(begins + sizes, sizes) - np.arange(len(group)), 0)
    at, lag = np.arange(len(group)), 1
    while len(at := at[ahead[at] > lag]):
        hit = at[near(at, at + lag)]
        xs.append(hit)
        ys.append(hit + lag)
        lag += 1
    # Large ones: grow one component after the other; what is reached is compared no more.
    for begin, size in zip(begins[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist(), strict=True):
        rest = np.arange(begin, begin + size)
        front: list[int] = []
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
            here = front.pop()
            hit = near(here, rest)
            reached, rest = rest[hit], rest[~hit]
            xs.append(np.full(len(reached), here))
            ys.append(reached)
            front += reached.tolist()
    return np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (``a``, ``b``) between fingerprints (column ``fp``) that connect exactly what those within ``radius`` bits connect."""
    kept = masks(radius)
    exploded = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in kept])).alias("tab", "kept")
    rows = nodes.select("fp", exploded).select(F.xxhash64("tab", "kept").alias("key"), "tab", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = held["key"].to_numpy()
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1 if len(held) else 0
            yield compared(held.iloc[:last])
            held = held.iloc[last:]
        if held is not None:
            yield compared(held)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        fp, key = rows["fp"].to_numpy(np.int64), rows["key"].to_numpy()
        if not len(fp):
            return pd.DataFrame({"a": fp, "b": fp})
        x, y = spanning([fp.view(np.uint64)], np.cumsum(np.r_[False, key[1:] != key[:-1]]), radius)
        return pd.DataFrame({"a": fp[x], "b": fp[y]}).drop_duplicates()

    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BUCKET).select("key", F.lit(True).alias("hot"))
    marked = written(rows.join(hot, "key", "left"), "buckets")
    cleared = F.lit(None)
    for t, m in enumerate(kept):
        free = [i for i in range(BITS) if not m >> i & 1]
        options = ",".join(str(signed(~sum(1 << i for i in some) & (1 << BITS) - 1)) + "L" for some in combinations(free, radius))
        cleared = F.when(F.col("tab") == t, F.expr(f"array({options})")).otherwise(cleared)
    dense = (
        marked.filter("hot")
        .select("fp", F.explode(cleared).alias("clear"))
        .groupBy("clear", F.col("fp").bitwiseAND(F.col("clear")).alias("rest"))
        .agg(F.collect_set("fp").alias("fps"))  # 2 ** radius at most
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))  # buckets of one have no links
    together = marked.filter(F.col("hot").isNull()).select("key", "fp").repartition("key").withColumn("n", size).filter("n > 1").drop("n").sortWithinPartitions("key")
    return together.mapInPandas(run, "a bigint, b bigint").unionByName(dense)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(``id_col``, ``fingerprint`` of 16 hex digits, ``component_id``), a row for each row of ``df``.

    Fingerprints that differ in ``radius`` bits at most (2 or less) are linked.
    ``component_id`` is the smallest identifier that links reach.  A null text counts as
    empty, and texts without words share fingerprint 0, which links like any other.  Null
    identifiers keep their row, and their component's id is that of the others (null if
    there are none).  Repeated rows stay.  An empty table gives an empty result.  Other
    columns are not read.
    """
    if not 0 <= radius <= 2:
        raise ValueError("a radius above 2 would make too many cleared positions of a hot bucket")
    docs = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    nodes = docs.groupBy("fp").agg(F.min("id").alias("least"))
    roots = least_reachable(links(nodes, radius)).withColumnRenamed("node", "n")
    rooted = nodes.join(roots, F.col("fp") == F.col("n"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return docs.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
