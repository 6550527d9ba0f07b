"""Several tables that become one version or none, behind a Python data source with a commit protocol.

A version is a folder of Parquet files and a manifest.  Tasks write files under names of their
own and report them; the manifest lists what the successful tasks reported and is written
after the last of them.  What a lost or repeated task left is in no manifest, and a failed
write deletes the version's folder.  The log has a file for each version, numbered without
gaps; creating the next number, which only one writer can, makes a version the current one.
So a writer that started from an older version is refused, and readers see whole versions.

Workers reach the folder by pyarrow (a shared path, hdfs, s3), the driver by Hadoop.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.checks import CheckFailed
from .sinks import _fs

FORMAT = "siftstone_version"
#: Columns of the written frame that say where a row belongs; each table is a struct beside them.
TABLE, BUCKET = "__table", "__bucket"
#: Rows of tables without a key stand in this bucket.
NO_BUCKET = -1


class Conflict(CheckFailed):
    """Another writer has published since the version was read."""


@dataclass
class Files(WriterCommitMessage):
    """What one task wrote: (table, bucket, file, rows)."""

    files: list[tuple[str, int, str, int]]


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.schema = folder, schema

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, root = self._open()
        task = uuid.uuid4().hex
        writers: dict[tuple[str, int], parquet.ParquetWriter] = {}
        rows: dict[tuple[str, int], int] = {}
        names: dict[tuple[str, int], str] = {}
        try:
            for batch in iterator:
                whole = pa.Table.from_batches([batch])
                for place in whole.group_by([TABLE, BUCKET]).aggregate([]).to_pylist():
                    at = place[TABLE], place[BUCKET]
                    part = whole.filter((pa.compute.field(TABLE) == at[0]) & (pa.compute.field(BUCKET) == at[1]))
                    part = pa.Table.from_struct_array(part[at[0]])
                    if at not in writers:
                        names[at] = f"{at[0]}/{at[1]}-{task}.parquet"
                        fs.create_dir(posixpath.join(root, at[0]), recursive=True)
                        writers[at] = parquet.ParquetWriter(posixpath.join(root, names[at]), part.schema, filesystem=fs, compression="zstd")
                    writers[at].write_table(part)
                    rows[at] = rows.get(at, 0) + part.num_rows
        finally:
            for w in writers.values():
                w.close()
        return Files([(*at, names[at], rows[at]) for at in writers])

    def commit(self, messages: list[Files | None]) -> None:
        fs, root = self._open()
        tables = {f.name: {"schema": f.dataType.json(), "files": []} for f in self.schema if f.name not in (TABLE, BUCKET)}
        for message in filter(None, messages):
            for table, *file in message.files:
                tables[table]["files"].append(file)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, "manifest.json")) as out:
            out.write(json.dumps(tables).encode())

    def abort(self, messages: list[Files | None]) -> None:
        fs, root = self._open()
        if fs.get_file_info(root).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(root)


class VersionSource(DataSource):
    """``df.write.format("siftstone_version")``: a frame with ``__table``, ``__bucket`` and a struct for each table."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options["path"], schema)


@dataclass(frozen=True)
class Version:
    """One version: its number in the log and what its manifest lists."""

    spark: SparkSession
    folder: str
    number: int
    tables: Mapping[str, dict]
    keys: Mapping[str, str]
    buckets: int

    def rows(self, table: str) -> int:
        return sum(n for _, _, n in self.tables[table]["files"])

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or those of its buckets, whatever is published meanwhile; Spark's own scan reads the files."""
        one = self.tables[table]
        schema = StructType.fromJson(json.loads(one["schema"]))
        paths = [f"{self.folder}/{name}" for bucket, name, _ in one["files"] if buckets is None or bucket in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, table: str, wanted: DataFrame) -> DataFrame:
        """The rows of ``table`` whose key is in ``wanted``'s column of that name: only their buckets' files are read.

        At most as many numbers as there are buckets reach the driver.  Null keys find nothing.
        """
        key = self.keys[table]
        kind = self.tables[table]["schema"]
        asked = wanted.select(F.col(key).cast(StructType.fromJson(json.loads(kind))[key].dataType).alias(key)).filter(F.col(key).isNotNull()).distinct()
        hit = {r["b"] for r in asked.select(_bucket(key, self.buckets).alias("b")).distinct().collect()}
        return self.read(table, hit).join(asked, key, "left_semi")


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, log = _fs(spark, f"{folder}/log")
    return [int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()] if fs.exists(log) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> Version | None:
    """The version that the log ends with, or None before the first one."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return None
    entry = json.loads(_text(spark, f"{folder}/log/{max(numbers):012d}"))
    at = f"{folder}/{entry['version']}"
    return Version(spark, at, max(numbers), json.loads(_text(spark, f"{at}/manifest.json")), entry["keys"], entry["buckets"])


def _claim(spark: SparkSession, folder: str, number: int, entry: dict) -> None:
    """Makes ``entry`` the log's file of that number, whole or not at all; raises :class:`Conflict` if there is one.

    The text is written beside the log, and renaming, which doesn't overwrite, claims the number.
    """
    fs, target = _fs(spark, f"{folder}/log/{number:012d}")
    _, draft = _fs(spark, f"{folder}/log/_{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(json.dumps(entry).encode())
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"{folder}: version {number} is there already") from None
        raise


def publish(frames: Mapping[str, DataFrame], folder: str, after: Version | None = None, keys: Mapping[str, str] | None = None, buckets: int = 64) -> Version:
    """All of ``frames`` as the version that follows ``after`` (None: the first one); raises :class:`Conflict` if another one does.

    A table with a key in ``keys`` is laid out in so many ``buckets`` of that key, for
    :meth:`Version.lookup`; keys are hashed with their rows, so a key that holds a large part
    of a table makes a large bucket.  The others' rows stay in the tasks that they are in.
    Tables without rows keep their columns.  A failure leaves what was there.
    """
    keys = dict(keys or {})
    spark = next(iter(frames.values())).sparkSession
    number = after.number + 1 if after else 1
    if number in _numbers(spark, folder):
        raise Conflict(f"{folder}: version {number} is there already")
    whole = None
    for name, df in frames.items():
        place = _bucket(keys[name], buckets) if name in keys else F.lit(NO_BUCKET)
        rows = df.select(F.lit(name).alias(TABLE), place.alias(BUCKET), F.struct("*").alias(name))
        rows = rows.repartition(buckets, BUCKET) if name in keys else rows
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    version = uuid.uuid4().hex
    spark.dataSource.register(VersionSource)
    whole.write.format(FORMAT).mode("append").option("path", f"{folder}/{version}").save()
    try:
        _claim(spark, folder, number, {"version": version, "keys": keys, "buckets": buckets})
    except Conflict:
        fs, lost = _fs(spark, f"{folder}/{version}")
        fs.delete(lost, True)
        raise
    return current(spark, folder) if number == max(_numbers(spark, folder)) else Version(spark, f"{folder}/{version}", number, json.loads(_text(spark, f"{folder}/{version}/manifest.json")), keys, buckets)


def update(spark: SparkSession, folder: str, change: Callable[[Version], Mapping[str, DataFrame]], attempts: int = 3) -> Version:
    """Publishes ``change`` of the current version, with tables that it doesn't return as they are.

    If another writer comes first, ``change`` is asked again with that writer's version, so
    many times in all; after that :class:`Conflict` is raised and nothing was overwritten.
    """
    for left in range(attempts - 1, -1, -1):
        now = current(spark, folder)
        if now is None:
            raise CheckFailed(f"{folder} has no version")
        frames = {n: now.read(n) for n in now.tables} | dict(change(now))
        try:
            return publish(frames, folder, now, now.keys, now.buckets)
        except Conflict:
            if not left:
                raise
    raise CheckFailed("no attempts")
