"""Substring dedup with prefix-partitioned suffix trees over words.

A window of ``WINDOW`` words is repeated if another suffix (of the same or any other
document) starts with the same words: its suffix lies below an internal node of depth
``WINDOW`` or more of the corpus' suffix tree.  No machine could hold that tree, so it is
built in parts, each from suffixes that share a prefix, and only where it can have such
nodes.

1.  Documents are dealt into batches of about ``BATCH`` bytes; a bucketed table keeps each
    batch in its place for all later steps, so texts are shuffled once.
2.  *Prefixes.*  The tree is sparse: it is split by the suffixes that start at *anchors*, the
    word ``GRAM``-gram with the least hash in each window.  Windows with equal words have
    equal anchors at equal offsets, and neighbours mostly share one, so about one suffix in
    fourteen is anchored; every window belongs to its anchor's prefix.  Prefixes are
    counted, first over ``TOGETHER`` batches and then over all.  One that occurs once has no
    internal node below it and is dropped.
3.  *Groups.*  Prefixes, in order, fill groups of about ``GROUP`` suffixes by their counts.
    A prefix with more than ``LONG_FROM`` is lengthened, to all words of each window, and its
    windows fill as many groups as that count asks for.
4.  *Subtrees.*  Batches send the words that a group's tree is made of, one segment for each
    run of windows that share an anchor; equal segments of a batch are sent once, with all
    their places.  The subtree is a suffix array (ranks by the first 1, 2, 4, ... words) with
    the longest common prefixes of neighbours; its intervals of ``WINDOW`` words and more are
    the deep internal nodes, whose leaves are repeated.  Groups of lengthened prefixes are
    built from ``TOGETHER`` batches first; what isn't repeated among these meets in a second
    round, so a passage that all batches hold never gathers in one task.
5.  Leaves of deep nodes go back to their batches as runs.  Runs that touch join to maximal
    repeats, and the words that they cover are removed.

Words are compared as bytes; hashes only decide what meets where (and a prefix's fate: a
collision lets through what the subtree then tells apart).
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dropped, run_hashes, shared_path, written

WINDOW = 35
GRAM = 8
#: Bytes of text in a batch.
BATCH = 1 << 20
#: Suffixes of a group.
GROUP = 24_000
#: Occurrences from which a prefix is lengthened.
LONG_FROM = 2_000
#: Batches whose prefixes share a bucket, and batches that are counted together first.
SPREAD = 6
TOGETHER = 1024
PLACE_BITS = 31
_HASHES = WordHashes(400_000)

SEGMENTS = "grp bigint, salt int, batch int, segments binary, windows binary, times binary, places binary"


class Batch:
    """The words of a batch of texts, one after the other, and the windows among them."""

    def __init__(self, texts: list[str | None], window: int):
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.words = [w for words in split for w in words]
        self.window = window
        ends = self.sizes.cumsum()
        starts = ends - self.sizes
        counts = np.maximum(self.sizes - window + 1, 0)
        begins = np.repeat(starts - (counts.cumsum() - counts), counts)
        self.windows = begins + np.arange(len(begins))  # where each window starts

    def anchors(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: the place of its anchor, the hash of the anchor's prefix, and that of all its words."""
        if not len(self.windows):
            empty = np.empty(0, np.uint64)
            return self.windows, empty, empty
        h = _HASHES.of(self.words)
        grams = run_hashes(h, gram)
        span = self.window - gram + 1  # grams in a window
        low = (grams >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low[self.windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        return place, grams[place], run_hashes(h, self.window)[self.windows]


class Subtree:
    """The suffix tree of a group's segments, down to depth ``window``.

    Leaves are each segment's first ``counts`` suffixes.  ``order`` is their suffix array and
    ``common`` the words that each shares with the next one (``window`` at most): the
    intervals of ``order`` in which ``common`` reaches a depth are the internal nodes of
    that depth.
    """

    def __init__(self, segments: list[bytes], counts: np.ndarray, window: int):
        split = [s.split(b" ") for s in segments]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        total = int(sizes.sum()) + len(split)
        ids = {w: k for k, w in enumerate(sorted(set().union(*split)))}
        rank = np.empty(total, np.int64)
        starts = np.zeros(len(split), np.int64)
        np.cumsum(sizes[:-1] + 1, out=starts[1:])
        inside = np.ones(total, bool)
        inside[starts + sizes] = False
        rank[inside] = np.fromiter((ids[w] for words in split for w in words), np.int64, int(sizes.sum()))
        rank[~inside] = len(ids) + np.arange(len(split))  # ends of segments are unlike anything
        ranks, width = [(1, rank)], 1
        while width < window:
            step = min(width, window - width)
            after = np.full(total, -1, np.int64)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (total + len(ids) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            width += step
            ranks.append((width, rank))
        begins = counts.cumsum() - counts
        self.window, self.begins = window, begins
        self.at = np.repeat(starts - begins, counts) + np.arange(int(counts.sum()))
        self.order = np.argsort(rank[self.at], kind="stable")
        here, there = self.at[self.order[:-1]], self.at[self.order[1:]]
        self.common = np.zeros(len(here), np.int64)
        for width, rank in reversed(ranks):
            fits = self.common + width <= window
            i, j = np.where(fits, here + self.common, 0), np.where(fits, there + self.common, 0)
            self.common += width * (fits & (rank[i] == rank[j]))

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The internal nodes at ``depth`` or where an edge passes it: first and last of their leaves in ``order``."""
        edges = np.diff(np.r_[False, self.common >= depth, False].astype(np.int8))
        return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def repeated(self, known: np.ndarray) -> list[np.ndarray]:
        """For each segment, which of its leaves lie below a deep node; all do in ``known`` segments, which occur more than once."""
        deep = np.zeros(len(self.at) + 1, np.int64)
        first, last = self.nodes(self.window)
        deep[first] += 1
        deep[last + 1] -= 1
        leaf = np.zeros(len(self.at), bool)
        leaf[self.order] = deep.cumsum()[:-1] > 0
        out = np.split(leaf, self.begins[1:]) if len(self.begins) else []
        # what repeats within such a segment's copies marks equal windows elsewhere, too: they share its node
        return [np.ones_like(x) if k else x for x, k in zip(out, known.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = sizes.cumsum()
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """(``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept`` and ``repeats``), a row for each row of ``df``.

    Words are what stands between ASCII white space, unchanged.  A word goes if a repeated
    window covers it; ``kept`` joins the others by one space, ``kept_sha256`` is its
    SHA-256 in hex, and ``repeats`` lists the maximal repeated stretches (first word, and
    the one after the last).  All windows are judged on the input, so of two equal passages
    both go.  A null text counts as empty; a text shorter than a window stays whole.
    Repeated rows are documents of their own, and repeat each other.  Null identifiers keep
    their rows.  An empty table gives an empty result.  Other columns are not read.

    ``df`` is read once; like any table that is dealt out by row, it should be a scan or
    otherwise repeat its rows' order if a task is run again.  The work is done when this is
    called; the result is a table in the shared folder.
    """
    if not 1 <= gram <= window:
        raise ValueError("a prefix is no longer than a window")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    volume = rows.agg(F.sum(F.octet_length("t") + 64).alias("v")).first()["v"] or 0
    batches = max(1, math.ceil(volume / BATCH))
    buckets = max(4, batches // SPREAD)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"siftstone_{uuid.uuid4().hex}", shared_path(spark, "batches")
    (
        rows.withColumn("nth", F.monotonically_increasing_id())
        .withColumn("batch", F.pmod(F.xxhash64("nth"), F.lit(batches)).cast("int"))
        .repartition(parts, "batch")
        .write.bucketBy(parts, "batch")
        .option("path", path)
        .saveAsTable(name)
    )
    try:
        done = written(_removed(spark.table(name), buckets, window, gram, texts), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(spark, path)
    return done.select(F.col("id").cast(kind).alias(id_col), *[c for c in done.columns if c != "id"])


def _removed(table: DataFrame, buckets: int, window: int, gram: int, texts: bool) -> DataFrame:
    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return group.sort_values("nth", ignore_index=True)

    def count_prefixes(group: pd.DataFrame) -> pd.DataFrame:
        place, prefix, _ = Batch(ordered(group)["t"].tolist(), window).anchors(gram)
        place, first = np.unique(place, return_index=True)
        prefix, n = np.unique(prefix[first], return_counts=True)
        bucket = (prefix % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        some, sizes = np.unique(bucket[order], return_counts=True)
        prefix, n, name = prefix[order], n[order].astype("<u4"), int(group["batch"].iloc[0])
        cuts = _cut(sizes)
        return pd.DataFrame(
            {"bucket": some, "batch": np.int32(name), "sub": np.int32(name // TOGETHER), "prefixes": [prefix[a:b].tobytes() for a, b in cuts], "counts": [n[a:b].tobytes() for a, b in cuts]}
        )

    def totals(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        prefixes, n = np.frombuffer(b"".join(group["prefixes"]), np.uint64), np.frombuffer(b"".join(group["counts"]), "<u4")
        which, back = np.unique(prefixes, return_inverse=True)
        return which, np.bincount(back, n, len(which)).astype(np.int64)

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        which, total = totals(group)
        total = np.minimum(total, (1 << 32) - 1).astype("<u4")
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "sub": group["sub"].iloc[:1], "prefixes": [which.tobytes()], "counts": [total.tobytes()]})

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        """Groups of prefixes that occur twice; minus the number of groups for what is lengthened."""
        which, total = totals(group)
        keep, long_ = total >= 2, total > LONG_FROM
        usual = np.where(keep & ~long_, total, 0)
        number = usual.cumsum() // GROUP
        number[long_] = -min(1 << 30, max(1, math.ceil(int(total[long_].sum()) * (window - gram + 1) / 2 / GROUP)))
        out = []
        for sub, prefixes in zip(group["sub"].tolist(), group["prefixes"], strict=True):
            own = np.frombuffer(prefixes, np.uint64)
            at = np.searchsorted(which, own)
            if (left := keep[at]).any():
                out.append((sub, own[left].tobytes(), number[at[left]].astype("<i4").tobytes()))
        out = pd.DataFrame(out, columns=["sub", "prefixes", "groups"])
        return out.assign(bucket=group["bucket"].iloc[0])[["bucket", "sub", "prefixes", "groups"]]

    def tell(group: pd.DataFrame, decided: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(group) and len(decided):
            which, number = np.frombuffer(b"".join(decided["prefixes"]), np.uint64), np.frombuffer(b"".join(decided["groups"]), "<i4")
            order = np.argsort(which)
            which, number = which[order], number[order]
            for batch, prefixes in zip(group["batch"].tolist(), group["prefixes"], strict=True):
                own = np.frombuffer(prefixes, np.uint64)
                at = np.minimum(np.searchsorted(which, own), len(which) - 1)
                if (left := which[at] == own).any():
                    out.append((batch, own[left].tobytes(), number[at[left]].tobytes()))
        return pd.DataFrame(out, columns=["batch", "prefixes", "groups"])

    def packed(found: dict[tuple[int, bytes], list[int]], batch: int, salt: int) -> list[tuple]:
        by: dict[int, list[tuple[bytes, list[int]]]] = {}
        for (g, text), places in found.items():
            by.setdefault(g, []).append((text, places))
        return [
            (
                g,
                salt if g & 1 else 0,
                batch,
                b"\n".join(t for t, _ in own),
                np.array([t.count(b" ") + 2 - window for t, _ in own], "<i4").tobytes(),
                np.array([len(p) for _, p in own], "<i4").tobytes(),
                np.array([x for _, p in own for x in p], "<i4").tobytes(),
            )
            for g, own in by.items()
        ]

    columns = [c.split()[0] for c in SEGMENTS.split(", ")]

    def segments(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(shared):
            return pd.DataFrame(columns=columns)
        batch = Batch(ordered(group)["t"].tolist(), window)
        place, prefix, whole = batch.anchors(gram)
        left, number = np.frombuffer(b"".join(shared["prefixes"]), np.uint64), np.frombuffer(b"".join(shared["groups"]), "<i4")
        order = np.argsort(left)
        left, number = left[order], number[order].astype(np.int64)
        at = np.minimum(np.searchsorted(left, prefix), len(left) - 1)
        alive = np.flatnonzero(left[at] == prefix)
        if not len(alive):
            return pd.DataFrame(columns=columns)
        place, prefix, whole, number, start = place[alive], prefix[alive], whole[alive], number[at[alive]], batch.windows[alive]
        long_ = number < 0
        # a group's number: its bucket, its number there, and in the lowest bit whether its prefixes were lengthened
        inner = np.where(long_, (whole % np.abs(number).astype(np.uint64)).astype(np.int64), number)
        grp = ((prefix % np.uint64(buckets)).astype(np.int64) << 32) | inner << 1 | long_
        new = np.ones(len(start), bool)  # a segment is a run of windows with one anchor; where it was lengthened, a window
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | long_[1:]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(start)])
        first = start[begin]
        line = b" ".join(batch.words)
        offset = np.r_[0, np.fromiter(map(len, batch.words), np.int64, len(batch.words)) + 1].cumsum()
        found: dict[tuple[int, bytes], list[int]] = {}
        for g, s, a, z in zip(grp[begin].tolist(), first.tolist(), offset[first].tolist(), (offset[first + size - 1 + window] - 1).tolist(), strict=True):
            found.setdefault((g, line[a:z]), []).append(s)
        name = int(group["batch"].iloc[0])
        return pd.DataFrame(packed(found, name, name // TOGETHER), columns=columns)

    def subtrees(first: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            texts = [t for blob in group["segments"] for t in blob.split(b"\n")]
            counts = np.frombuffer(b"".join(group["windows"]), "<i4").astype(np.int64)
            times = np.frombuffer(b"".join(group["times"]), "<i4")
            places = np.frombuffer(b"".join(group["places"]), "<i4")
            deep = Subtree(texts, counts, window).repeated(times > 1)
            grp = int(group["grp"].iloc[0])
            seen: set[bytes] = set()
            common: dict[tuple[int, bytes], list[int]] = {}
            out, k, at = [], 0, 0
            for batch, size in zip(group["batch"].tolist(), group["windows"].map(len).tolist(), strict=True):
                runs: list[tuple[int, int]] = []
                single: dict[tuple[int, bytes], list[int]] = {}
                for _ in range(size // 4):
                    own = _runs(deep[k])
                    here = places[at : at + times[k]].tolist()
                    for p in here if own else ():
                        runs += [(p + a, p + b) for a, b in own]
                    # a window of a lengthened prefix is told once to the other batches' trees
                    if first and grp & 1 and texts[k] not in seen:
                        seen.add(texts[k])
                        if own:
                            common[grp, texts[k]] = [-1, -1]
                        else:
                            single[grp, texts[k]] = here
                    at += int(times[k])
                    k += 1
                if runs and batch >= 0:
                    out.append((grp, 0, batch, None, None, None, None, np.array(runs, "<i4").tobytes()))
                out += [(*row, None) for row in packed(single, batch, 0)]
            out += [(*row, None) for row in packed(common, -1, 0)]
            return pd.DataFrame(out, columns=[*columns, "runs"])

        return run

    def cut(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        batch = Batch(group["t"].tolist(), window)
        runs = np.frombuffer(b"".join(found["runs"]), "<i4").reshape(-1, 2).astype(np.int64)
        edge = np.zeros(len(batch.words) + 1, np.int64)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, runs[:, 1] + window - 1, -1)  # a run ends before its second number
        covered = edge.cumsum()[:-1] > 0
        out, at = [], 0
        for n in batch.sizes.tolist():
            gone = covered[at : at + n]
            words = batch.words[at : at + n]
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            row = (n, int(gone.sum()), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "surrogatepass"), [{"start": a, "stop": b} for a, b in _runs(gone)]) if texts else row)
            at += n
        done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", *["kept", "repeats"] * texts])
        done.insert(0, "id", group["id"])
        return done

    if texts:
        schema = "id string, n_words bigint, n_removed bigint, kept_sha256 string, kept string, repeats array<struct<start: int, stop: int>>"
    else:
        schema = "id string, n_words bigint, n_removed bigint, kept_sha256 string"
    prefixes = written(table.groupBy("batch").applyInPandas(count_prefixes, "bucket bigint, batch int, sub int, prefixes binary, counts binary"), "prefixes")
    summed = prefixes.groupBy("bucket", "sub").applyInPandas(add_up, "bucket bigint, sub int, prefixes binary, counts binary")
    decided = summed.groupBy("bucket").applyInPandas(decide, "bucket bigint, sub int, prefixes binary, groups binary")
    shared = prefixes.groupBy("bucket", "sub").cogroup(decided.groupBy("bucket", "sub")).applyInPandas(tell, "batch int, prefixes binary, groups binary")
    sent = table.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(segments, SEGMENTS)
    found = written(sent.groupBy("grp", "salt").applyInPandas(subtrees(True), SEGMENTS + ", runs binary"), "found")
    again = found.filter("runs IS NULL").groupBy("grp").applyInPandas(subtrees(False), SEGMENTS + ", runs binary")
    runs = found.filter("runs IS NOT NULL").unionByName(again).select("batch", "runs")
    return table.groupBy("batch").cogroup(runs.groupBy("batch")).applyInPandas(cut, schema)
