"""Token ids as length-delimited binary records, with a separate offset index.

A record is one document's ids.  Its frame::

    uint64  bytes of the payload
    uint32  masked checksum of these eight bytes
    payload uint8 flags (1: the identifier is null, 2: ids take four bytes instead of two),
            int64 identifier, ids
    uint32  masked checksum of the payload

All integers are little-endian.  The checksum is CRC-32 (that of zlib, which is native in
Python), rotated right by 15 bits plus 0xa282ead8, so that checksums of data that hold
checksums stay useful.  Frames are written in blocks: a uint64 with the block's bytes, the
frames, a newline byte.

Files are written by Spark's text sink, whose rows are here blocks of bytes: it works on any
file system, and its committer makes retried and speculative tasks safe.  A task writes one
range of identifiers, sorted, and begins a new file after ``FILE_BLOCKS`` blocks, so files
have a bounded size however much a range holds; ordered by the two numbers in their names
(range, and file of the range) they are in ascending order.
The index is a Parquet table with a row for each record; it is made by reading the files, so
whatever it lists has passed both checksums.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Blocks in a file: 64 MB, if no document is longer.
FILE_BLOCKS = 64
#: Words whose ids a worker keeps, and the bytes of the longest of them.
KEPT_WORDS = 800_000
KEPT_LENGTH = 64
#: Words that the library encodes at once.
LINE = 4_000
NULL_ID, WIDE = 1, 2

INDEX = "file string, ordinal bigint, offset bigint, length bigint, id bigint, n_tokens bigint, file_start bigint, ids_crc32 bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class CorruptRecord(ValueError):
    """A length or a payload doesn't match its checksum."""


def frame(ids: np.ndarray, identifier: int | None) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = struct.pack("<Bq", (identifier is None) * NULL_ID | wide * WIDE, identifier or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def payload_at(data: bytes, at: int) -> bytes:
    """The payload of the frame at an offset, checked."""
    size = data[at : at + 8]
    if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise CorruptRecord(f"length at byte {at}")
    n = struct.unpack("<Q", size)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise CorruptRecord(f"payload at byte {at}")
    return payload


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, identifier = struct.unpack_from("<Bq", payload)
    return None if flags & NULL_ID else identifier, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=9)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each record of a file."""
    at = 0
    while at < len(data):
        stop = at + 8 + struct.unpack_from("<Q", data, at)[0]
        at += 8
        while at < stop:
            payload = payload_at(data, at)
            yield at, payload
            at += 16 + len(payload)
        at += 1


#: A word that needs no more than the tokenizer's model: letters, and a mark at its end that is a piece of its own.
PLAIN = re.compile(rb"([a-z]+)([.,;:!?]?)")
SAMPLE = ["thenat", "a", "zebra", "internationalisation", "qqxzj"]


class WordEncoder:
    """Encodes with a tokenizer of the tokenizers library that drops white space and case.

    Such a tokenizer encodes a text word by word (words between ASCII white space), so the
    library is asked once for a word and the ids are kept.  Words of the letters a-z reach
    its model at once, since normalising and splitting would leave them as they are; the
    constructor tries that.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self._library(["a b", " a\n", "b"]) != [x + y for x, y in [self._library(["a", "b"]), (self._library(["a"])[0], b""), (self._library(["b"])[0], b"")]]:
            raise ValueError(f"{path} doesn't drop white space")
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        marked = [w + m for w in SAMPLE for m in ".,;:!?"]
        ids = self._library(SAMPLE)
        if (
            ids != [np.array(e.ids, np.uint32).tobytes() for e in self.model.encode_batch(SAMPLE)]
            or self._library([w.upper() for w in SAMPLE]) != ids
            or self._library(marked) != [i + m for i in ids for m in self._library(list(".,;:!?"))]
        ):
            raise ValueError(f"{path} doesn't take lower-case letters as they are")
        self.marks = dict(zip([b"", *(m.encode() for m in ".,;:!?")], [b"", *self._library(list(".,;:!?"))], strict=True))
        self.known: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _of_words(tokenizer, words: list[str]) -> list[bytes]:
        """The ids of each word; the library gets them as lines of many words, and its offsets tell whose an id is."""
        out: list[bytes] = []
        for k in range(0, len(words), LINE):
            part = words[k : k + LINE]
            line = tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.fromiter((a for a, _ in line.offsets), np.int64, len(line.ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            stops = (np.searchsorted(begins, ends) * 4).tolist()  # the first id that begins after the word
            ids = np.array(line.ids, np.uint32).tobytes()
            out += [ids[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        return out

    def _of_new(self, new: list[bytes]) -> dict[bytes, bytes]:
        plain = {w: m.groups() for w in new if (m := PLAIN.fullmatch(w))}
        letters = list({a for a, _ in plain.values()})
        ids = dict(zip(letters, self._of_words(self.model, [w.decode() for w in letters]), strict=True))
        others = [w for w in new if w not in plain]
        out = dict(zip(others, self._of_words(self.library, [w.decode("utf-8") for w in others]), strict=True))
        out.update((w, ids[a] + self.marks[mark]) for w, (a, mark) in plain.items())
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # "<" may begin a special token, in which case counts
        split = [(d if b"<" in d else d.lower()).split() for d in (t.encode("utf-8") for t in texts)]
        known = self.known
        get = known.get
        found = [list(map(get, words)) for words in split]
        missing = [(k, [i for i, x in enumerate(ids) if x is None]) for k, ids in enumerate(found) if None in ids]
        new = list({split[k][i] for k, places in missing for i in places})
        fresh = self._of_new(new)
        for k, places in missing:
            words, ids = split[k], found[k]
            for i in places:
                ids[i] = fresh[words[i]]
        if len(known) < KEPT_WORDS:
            known.update((w, x) for w, x in fresh.items() if len(w) <= KEPT_LENGTH)
        return [np.frombuffer(b"".join(ids), np.uint32) for ids in found]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _portions(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most or k + 1 == len(texts):
            yield slice(begin, k + 1)
            begin, size = k + 1, 0


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``df``'s texts and writes them to the folder ``path`` in ascending order of ``id_col``.

    ``end_id``, unless null, is appended to every document.  A null text counts as empty.
    Null identifiers come first; rows that share an identifier are ordered by their text.
    An empty table writes a folder without records.  Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        block: list[bytes] = []
        size = 0
        for batch in batches:
            keys, null, texts = batch["i"].tolist(), batch["no_id"].tolist(), batch["t"].tolist()
            for part in _portions(texts):
                for key, none, ids in zip(keys[part], null[part], words.encode(texts[part]), strict=True):
                    block.append(frame(np.concatenate([ids, end]), None if none else key))
                    size += len(block[-1])
                    if size >= BLOCK:
                        yield pd.DataFrame({"block": [struct.pack("<Q", size) + b"".join(block)]})
                        block, size = [], 0
        if block:
            yield pd.DataFrame({"block": [struct.pack("<Q", size) + b"".join(block)]})

    key = F.col(f"`{id_col}`").cast("long")
    rows = df.select(F.coalesce(key, F.lit(-(1 << 63))).alias("i"), key.isNull().alias("no_id"), text.alias("t")).withColumn("h", F.xxhash64("t"))
    (
        rows.repartitionByRange(F.desc("no_id"), F.asc("i"), F.asc("h"))
        .sortWithinPartitions(F.desc("no_id"), "i", "h", "t")
        .drop("h")
        .mapInPandas(run, "block binary")
        .select(F.col("block").cast("string").alias("value"))
        .write.option("compression", "none")
        .option("maxRecordsPerFile", FILE_BLOCKS)
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads and checks all records; the index's columns, offsets of frames and running counts by file.

    A record without an identifier has a null ``id``; repeated identifiers have a row each.
    A folder without records gives no rows.  A frame that doesn't fit its checksums raises
    :class:`CorruptRecord`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["content"], strict=True):
                rows, start = [], 0
                for k, (at, payload) in enumerate(frames(data)):
                    identifier, ids = parsed(payload)
                    rows.append((file, k, at, len(payload) + 16, identifier, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                out["id"] = out["id"].astype("Int64")
                yield out

    return _files(spark, path).select(_name("path").alias("file"), "content").mapInPandas(run, INDEX)


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Writes the index of ``path`` to the folder ``index``.

    Returns it with ``start``: the ids in all records before.  Its window runs over one
    row for each file, a range of files at a time and then over the ranges.  Null and
    repeated identifiers keep their rows; without records the index is empty.
    """
    scan_index(spark, path).write.parquet(index)
    table = spark.read.parquet(index)
    at, nth = (F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)", k).cast("long") for k in (1, 2))
    totals = table.groupBy(F.col("file").alias("f"), at.alias("at"), nth.alias("nth")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("at").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    inside = totals.select("f", "at", F.coalesce(before, F.lit(0)).alias("inside"))
    earlier = F.sum("m").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ranges = totals.groupBy("at").agg(F.sum("n").alias("m")).select(F.col("at").alias("r"), F.coalesce(earlier, F.lit(0)).alias("base"))
    starts = inside.join(ranges, F.col("at") == F.col("r")).select("f", (F.col("base") + F.col("inside")).alias("base"))
    return table.join(starts, F.col("file") == F.col("f")).withColumn("start", F.col("base") + F.col("file_start")).drop("f", "base")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """All records as (``position``, ``id``, ``ids``), in an order that ``seed`` decides.

    Files change places by a hash, and the index's offsets are visited in a permuted order
    within each file; sort by ``position`` for the one global order.  Null and repeated
    identifiers keep their rows, and an empty index gives none.
    """

    def run(key, files: pd.DataFrame) -> pd.DataFrame:
        data = bytes(files["content"].iloc[0])
        order = np.random.default_rng([seed, zlib.crc32(key[0].encode())]).permutation(len(files))
        rows = [(float(zlib.crc32(f"{seed}/{key[0]}".encode())) + k / len(order), *parsed(payload_at(data, int(at)))) for k, at in enumerate(files["offset"].iloc[order])]
        return pd.DataFrame(
            {"position": [r[0] for r in rows], "id": pd.array([r[1] for r in rows], "Int64"), "ids": [r[2].astype(np.int64) for r in rows]}
        )

    files = _files(spark, path).select(_name("path").alias("file"), "content")
    offsets = index.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    rows = files.join(offsets, "file")

    def per_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, at in zip(batch["file"], batch["content"], batch["offsets"], strict=True):
                yield run((file,), pd.DataFrame({"content": [content] * len(at), "offset": at}))

    return rows.mapInPandas(per_file, "position double, id bigint, ids array<bigint>")
