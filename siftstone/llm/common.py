"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, and a word, as Java patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests,
    local runs) a folder of this machine stands in.  Any other cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_siftstone_dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir: executors of {master} don't share this machine's folders")
        folder = "file://" + tempfile.mkdtemp(prefix="siftstone-")
        spark._siftstone_dir = folder
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/siftstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder that no frame reads any more."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        dropped(spark, path)
    except Exception:  # the session has ended already
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged: a table that grows with the input never passes through the driver as a broadcast."""
    return df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(hash_: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(hash_, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def give_back() -> None:
    """Returns to the system what a task no longer needs: its Python worker lives on, beside an executor that is full."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


#: Ranges of a hash at least, as a power of two, and rows in one beyond that.
RANGE_BITS, RANGE_ROWS = 10, 200_000


def range_bits(rows: int) -> int:
    """Leading bits of a hash that cut so many rows into ranges of a bounded number of rows."""
    return max(RANGE_BITS, math.ceil(math.log2(max(rows, 1) / RANGE_ROWS)))


class WordHashes(dict):
    """64-bit hashes of words.  Short words that were met are kept, up to a bound."""

    LONGEST = 32

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pairs (a, b); their order matters."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` elements from each place on."""
    width, x = 1, h
    while width * 2 <= length:
        x = mixed(x[:-width], x[width:] + np.uint64(width))
        width *= 2
    rest = length - width
    return mixed(x[: len(x) - rest], x[rest:] + np.uint64(length)) if rest else x
