"""Near copies of texts: covering SimHash tables for candidates, exact Jaccard for links.

Texts have several independent SimHash words over their distinct shingles.  Each word is
searched with the covering masks of ``RADIUS`` bits: two texts that differ in so many bits of
any word are certain to share one of its buckets.  At a given Jaccard similarity that
happens with a known probability, so the number of words follows from the similarity and
``RECALL``, and their length from the number of texts, such that a bucket holds few unlike
texts at any size: 14 words of 35 bits (98 tables) for 200,000 texts, 33 of 45 (231) for
12 million.

Texts with equal shingles are one node.  A bucket row is a key and a node; words of bits are
joined to the rows that share a bucket, four for chance meetings and sixteen where more rows
meet, which tell similar texts from almost similar ones.  Candidates differ in few of these
bits and are linked if the exact Jaccard similarity of their shingles is high enough.

Buckets of more than ``BLOCK`` rows are cut into blocks, so no task holds one.  In the first
tables a spanning set of near candidates and each row's nearest ones, taken block by block,
connect most of each large group.  Then every candidate in all tables between what isn't yet connected is verified: of
a bucket, the rows outside its largest group are compared with all its rows, block by block.
The result is what all verified candidates connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, apart, give_back, run_hashes, written
from .components import least_reachable
from .simhash_cover import SEED, SMALL_BUCKET, masks, signed, spanning

RADIUS = 2
#: Probability that a lone pair at the least similarity shares a bucket.
RECALL = 0.94
#: A bucket holds ``1 / 2 ** SPARE`` unlike texts on average.
SPARE = 2
#: 64-bit words of bits that are compared in any bucket, and in those of more than ``FEW`` rows.
COMPARED, ALL = 4, 16
FEW = 3
#: Bits that may differ in candidates: of the compared and of all (at the least similarity more do in
#: one pair of a thousand, or of a hundred), and of the compared in near ones.
LIMIT, LIMIT_OF_ALL = 56, 181
NEAR = 30
#: A distance that no candidates have.
FAR = 1 << 14
#: Of a block's rows each is verified with so many first.
NEAREST = 3
#: Words whose tables are searched first.
FIRST_WORDS = 2
#: Rows of a bucket that are compared at once, and of these those that are compared with the others in one step.
BLOCK = 2048
CHUNK = 256
SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, 128, np.uint64)
BITS = [f"c{k}" for k in range(COMPARED)]
_WORD_HASHES = WordHashes(100_000)


def differing(similarity: float) -> float:
    """The probability that a SimHash bit differs between sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@cache
def found(differ: float, bits: int, radius: int = RADIUS) -> float:
    """The probability that two words, whose bits differ with probability ``differ``, share a bucket."""
    count = (1 << radius + 1) - 1
    touched = [1 - (1 - differ) ** len(range(v, bits, count)) for v in range(count)]  # by the vector of a position
    total = 0.0
    for some in range(1 << count):
        if any(all(((v + 1) & t).bit_count() % 2 == 0 for v in range(count) if some >> v & 1) for t in range(1, count + 1)):
            total += math.prod(p if some >> v & 1 else 1 - p for v, p in enumerate(touched))
    return total


def layout(rows: int, similarity: float) -> tuple[int, int]:
    """How many SimHash words, and the bits of each, for so many texts."""
    count = (1 << RADIUS + 1) - 1
    bits = min(64, max(2 * count, math.ceil((math.log2(max(rows, 1)) + SPARE) * count / (1 << RADIUS))))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - found(differing(similarity), bits))), bits


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; words as in :func:`simhash_cover.fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = _WORD_HASHES.of(words)
    return np.unique(run_hashes(h, min(width, len(h)))) if len(h) else h


def majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits of a set of shingles: majorities of the bits of their hashes, mixed anew for each word."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ SALTS[:words]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def _fingerprints(rows: DataFrame, width: int, words: int, bits: int) -> DataFrame:
    """(``id`` as a string, ``text_hash``, ``node``, ``size``, compared bits, ``words``) of rows (``id``, ``text_hash``, ``text``)."""
    pool = max(ALL, -(-words * bits // 64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            packed = np.array([majorities(s, pool) for s in sets], np.uint8).reshape(-1, pool * 8)
            each = np.zeros((len(sets), words, 64), np.uint8)
            each[:, :, :bits] = np.unpackbits(packed, axis=1, bitorder="little")[:, : words * bits].reshape(-1, words, bits)
            cut = np.packbits(each, axis=2, bitorder="little").view("<i8").reshape(-1, words)
            compared = packed.view("<i8")
            out = {"id": batch["id"], "text_hash": batch["text_hash"], "node": node, "size": np.fromiter(map(len, sets), np.int64, len(sets))}
            more = [row.tobytes() for row in compared[:, COMPARED:ALL]]
            yield pd.DataFrame(out | {c: compared[:, k] for k, c in enumerate(BITS)} | {"more": more, "words": list(cut)})
        batch = sets = packed = each = cut = compared = out = more = None
        give_back()

    return rows.mapInPandas(run, "id string, text_hash bigint, node bigint, size bigint, " + ", ".join(f"{c} bigint" for c in BITS) + ", more binary, words array<bigint>")


def _together(nodes: DataFrame, words: int, bits: int) -> DataFrame:
    """(``key``, ``n``, ``node``, ``size``, bits) where ``n`` nodes share a bucket; a key's lowest bits are its table."""
    tables = [(k, m) for k in range(words) for m in masks(RADIUS, bits)]
    key = [F.xxhash64(F.lit(t), F.col("words")[k].bitwiseAND(F.lit(signed(m)))).bitwiseAND(F.lit(-4096)).bitwiseOR(F.lit(t)) for t, (k, m) in enumerate(tables)]
    dealt = nodes.select(F.explode(F.array(*key)).alias("key"), "node")
    # counted in part before the shuffle, and joined, so that a crowd's bucket isn't in one task
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = dealt.join(apart(counts), "key")
    more = F.when(F.col("n") > FEW, F.col("more")).alias("more")
    return shared.join(apart(nodes.drop("words")), "node").select("key", "n", "node", "size", *BITS, more)


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _part(blocks: Column, salt: int) -> Column:
    """Which of ``blocks`` parts of its bucket a row is in."""
    return F.pmod(F.xxhash64("key", "node", F.lit(salt)), blocks).cast("int")


def _by_bucket(rows: DataFrame, compare, schema: str) -> DataFrame:
    """What ``compare`` yields of whole buckets; it gets rows ordered by ``key`` and ``node``, and where each bucket begins and the last ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = held["key"].to_numpy()
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1 if len(held) else 0
            if last:
                yield compared(held.iloc[:last])
            held = held.iloc[last:]
        if held is not None and len(held):
            yield compared(held)
        batch = held = None
        give_back()

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        key = part["key"].to_numpy()
        return compare(part, np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]))

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, schema)


def _compared(part: pd.DataFrame) -> list[np.ndarray]:
    return [part[c].to_numpy(np.int64).view(np.uint64) for c in BITS]


class _Distances:
    """Bits in which rows differ; ``FAR`` where they are no candidates.  Rows without more bits differ in none of these."""

    def __init__(self, part: pd.DataFrame):
        self.bits = _compared(part)
        none = bytes(8 * (ALL - COMPARED))
        packed = b"".join(none if m is None else bytes(m) for m in part["more"].tolist())
        self.more = np.frombuffer(packed, "<u8").reshape(-1, ALL - COMPARED).T.copy()

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in self.bits)
        near = d <= LIMIT
        d += sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in self.more)
        return np.where(near & (d <= LIMIT_OF_ALL), d, np.int16(FAR))


def _ordered(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Candidates: of each block those that connect what its near candidates connect, and each row with its ``NEAREST`` nearest."""

    def compare(part: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        far, node = _Distances(part), part["node"].to_numpy()
        begins, sizes = edges[:-1], np.diff(edges)
        xs, ys = (list(z) for z in zip(spanning(far.bits, np.repeat(np.arange(len(sizes)), sizes), NEAR), strict=True))
        # small blocks: all of them at once, each row with the next, the one after, ...
        small = sizes <= SMALL_BUCKET
        ahead = np.where(np.repeat(small, sizes), np.repeat(begins + sizes, sizes) - np.arange(len(part)), 0)
        at, lag, met = np.arange(len(part)), 1, [np.zeros((3, 0), np.int64)]
        while len(at := at[ahead[at] > lag]):
            d = far(at, at + lag)
            few = at[d < FAR]
            met.append(np.stack([few, few + lag, d[d < FAR]]))
            lag += 1
        x, y, d = np.concatenate(met, axis=1)
        x, y, d = np.r_[x, y], np.r_[y, x], np.r_[d, d]
        order = np.lexsort((d, x))
        x, y = x[order], y[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        xs.append(x[place < NEAREST])
        ys.append(y[place < NEAREST])
        for begin, end in zip(begins[~small].tolist(), edges[1:][~small].tolist(), strict=True):
            here = np.arange(begin, end)
            for k in range(0, len(here), CHUNK):
                i = here[k : k + CHUNK]
                d = far(i[:, None], here[None, :])
                d[np.arange(len(i)), i - begin] = FAR
                best = np.argpartition(d, NEAREST, axis=1)[:, :NEAREST]
                row, at = np.nonzero(np.take_along_axis(d, best, 1) < FAR)
                xs.append(i[row])
                ys.append(here[best[row, at]])
        return _ordered(node[np.concatenate(xs)], node[np.concatenate(ys)])

    return _by_bucket(_in_blocks(rows), compare, "a bigint, b bigint").distinct()


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("key", _part(_blocks(F.col("n")), 0))).drop("n")


def _candidates(rows: DataFrame) -> DataFrame:
    """Nodes that are in a candidate pair, and all of buckets that are too large to compare at once."""

    def compare(part: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        x, y = spanning(_compared(part), np.repeat(np.arange(len(edges) - 1), np.diff(edges)), LIMIT)
        return pd.DataFrame({"node": np.unique(part["node"].to_numpy()[np.r_[x, y]])})

    small = _by_bucket(rows.filter(F.col("n") <= BLOCK).drop("n", "size", "more"), compare, "node bigint")
    return small.unionByName(rows.filter(F.col("n") > BLOCK).select("node")).distinct()


def _pairs_between(rows: DataFrame, similarity: float) -> DataFrame:
    """All candidates of different ``label`` in all buckets."""
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "label"))
    mixed_ = counts.groupBy(F.col("key").alias("of")).agg(F.sum("m").alias("all"), largest["label"].alias("major"), (F.sum("m") - largest["m"]).alias("few")).filter("few > 0")
    whole, minor = _blocks(F.col("all")), _blocks(F.col("few"))
    one = F.array(F.struct(F.lit(0).alias("b"), F.lit(0).alias("u"), F.lit(0).alias("side")))
    own_b, own_u = _part(whole, 0), _part(minor, 1)
    as_any = F.transform(F.sequence(F.lit(0), minor - 1), lambda u: F.struct(own_b.alias("b"), u.alias("u"), F.lit(1).alias("side")))
    as_few = F.transform(F.sequence(F.lit(0), whole - 1), lambda b: F.struct(b.alias("b"), own_u.alias("u"), F.lit(2).alias("side")))
    cells = F.when(whole == 1, one).when(F.col("label") == F.col("major"), as_any).otherwise(F.concat(as_any, as_few))
    dealt = rows.join(apart(mixed_), F.col("key") == F.col("of")).select("key", "node", "size", "label", *BITS, "more", F.explode(cells).alias("cell"))
    dealt = dealt.select(F.xxhash64("key", "cell.b", "cell.u").alias("key"), "cell.side", "node", "size", "label", *BITS, "more")

    def compare(part: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        far = _Distances(part)
        node, label, size, side = (part[c].to_numpy() for c in ("node", "label", "size", "side"))

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
            return fits & (far(i, j) < FAR)

        begins, sizes = edges[:-1], np.diff(edges)
        small = (sizes <= SMALL_BUCKET) & (side[begins] == 0) if len(begins) else sizes > 0
        xs, ys = [node[:0]], [node[:0]]
        # small buckets: all of them at once, each row with the next, the one after, ...
        ahead = np.where(np.repeat(small, sizes), np.repeat(begins + sizes, sizes) - np.arange(len(part)), 0)
        at, lag = np.arange(len(part)), 1
        while len(at := at[ahead[at] > lag]):
            hit = at[linked(at, at + lag)]
            xs.append(node[hit])
            ys.append(node[hit + lag])
            lag += 1
        for begin, end in zip(begins[~small].tolist(), edges[1:][~small].tolist(), strict=True):
            here = np.arange(begin, end)
            if side[begin]:
                few, rest = here[side[begin:end] == 2], here[side[begin:end] == 1]
            else:  # one side of such a pair is always outside the largest label
                _, which, counts = np.unique(label[begin:end], return_inverse=True, return_counts=True)
                few, rest = here[which != counts.argmax()], here
            for k in range(0, len(few), CHUNK):
                i = few[k : k + CHUNK]
                x, y = np.nonzero(linked(i[:, None], rest[None, :]))
                xs.append(node[i[x]])
                ys.append(node[rest[y]])
        return _ordered(np.concatenate(xs), np.concatenate(ys))

    return _by_bucket(dealt, compare, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingles' Jaccard similarity reaches ``similarity``."""
    one, two = (sets.select(F.col("node").alias(e), F.col("shingles").alias(f"s{e}")) for e in "ab")
    sized = pairs.join(apart(one), "a").join(apart(two), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return sized.filter(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(``id_col``, ``text_hash``, ``node``, ``component``), a row for each row of ``df``.

    Rows of one ``component`` are connected by pairs of texts whose sets of shingles
    (``width`` words) have a Jaccard similarity of ``similarity`` at least.  Texts with equal
    sets are one ``node``; so are texts without words, whose sets are empty.  A null text
    counts as empty.  ``text_hash`` is ``xxhash64`` of the text.  Null and repeated
    identifiers keep their rows; an empty table gives an empty result; other columns are
    not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    texts = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    words, bits = layout(texts.count(), similarity)
    docs = written(_fingerprints(texts, width, words, bits).withColumn("id", F.col("id").cast(kind)), "fingerprints")
    nodes = docs.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", *BITS, "more", "words")])
    together = written(_together(written(nodes, "nodes"), words, bits), "buckets")
    wanted = docs.join(apart(_candidates(together)), "node").groupBy("node").agg(F.min("text_hash").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingles(t, width).view(np.int64) for t in batch["text"]]})
        batch = None
        give_back()

    held = texts.join(apart(wanted), F.col("text_hash") == F.col("h")).select("node", "text").mapInPandas(run, "node bigint, shingles array<bigint>")
    sets = written(held.dropDuplicates(["node"]), "shingles")
    in_first = F.col("key").bitwiseAND(F.lit(4095)) < FIRST_WORDS * len(masks(RADIUS, bits))
    first = written(_verified(_first_pairs(together.filter(in_first)), sets, similarity), "first")
    roots = least_reachable(first)
    known = roots.select(F.col("node").alias("m"), F.col("root").alias("label"))
    labelled = written(together.join(apart(known), F.col("node") == F.col("m"), "left").withColumn("label", F.coalesce("label", "node")).drop("m", "n"), "labelled")
    more = _verified(_pairs_between(labelled, similarity), sets, similarity)
    roots = least_reachable(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)).withColumnRenamed("node", "m")
    of = docs.select("id", "text_hash", "node").join(apart(roots), F.col("node") == F.col("m"), "left")
    return of.select(F.col("id").alias(id_col), "text_hash", "node", F.coalesce("root", "node").alias("component"))
