"""Sinks: published whole or not at all, checked, bounded, partitioned, content-addressed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import slug
from ..operators.checks import CheckFailed, differing, require_none, table_fingerprint


#: Null is an empty value, an empty text is quoted, quotes are doubled.
CSV = {"header": True, "escape": '"', "nullValue": "", "emptyValue": '""'}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a written folder in place of another; the old one goes only when the new one is there."""
    fs, target = _fs(spark, path)
    _, new = _fs(spark, staged)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't publish {path}")
    if had:
        fs.delete(old, True)


def publish(df: DataFrame, path: str, kind: str = "parquet", check: bool = False, single: bool = False, **options) -> None:
    """Writes beside ``path`` and then takes its place; on failure what was there stays.

    CSV follows one dialect: null is an empty value, an empty text is quoted, quotes are
    doubled, a header even without rows.  With ``check`` the written rows are read back and
    compared.  ``single`` writes one file, for results known to be small.
    """
    spark = df.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}.new"
    rows = df.coalesce(1) if single else df
    try:
        if kind == "csv":
            rows.write.options(**CSV, **options).csv(staged)
        elif kind == "parquet":
            rows.write.options(compression="zstd", **{"parquet.enable.dictionary": "false"}, **options).parquet(staged)
        else:
            raise CheckFailed(f"unknown kind {kind}")
        if check and kind == "parquet":
            require_none(differing(df, spark.read.schema(df.schema).parquet(staged)), "written rows differ")
    except Exception:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)
        raise
    _replace(spark, staged, path)


def require_contract(df: DataFrame, schema: StructType, most_bytes: int = 16 << 20, unsigned: Sequence[str] = ()) -> None:
    """Raises unless the columns and types are those of ``schema``, no row's text exceeds ``most_bytes``, and ``unsigned`` columns fit 32 bits without a sign."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise CheckFailed(f"columns are {df.schema.simpleString()}, not {schema.simpleString()}")
    require_none(df.filter(F.octet_length(F.to_json(F.struct("*"))) > most_bytes).select(F.lit(1).alias("row")), "rows are too large")
    for c in unsigned:
        require_none(df.filter(~F.col(c).between(0, (1 << 32) - 1)).select(c), f"{c} is out of range")


def publish_bounded(df: DataFrame, path: str, rows: int = 1000, bytes_: int = 4 << 20) -> None:
    """Parquet in files of at most so many rows, with row groups of about so many bytes."""
    publish(df, path, maxRecordsPerFile=rows, **{"parquet.block.size": bytes_})


def publish_parts(df: DataFrame, path: str, column: str, kind: str = "parquet") -> DataFrame:
    """A folder for each value of ``column``, and the manifest: the values with their rows.

    Rows of one value are dealt over files, so that a large value makes no large task.
    """
    spark = df.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}.new"
    writer = df.write.partitionBy(column)
    try:
        writer.parquet(staged) if kind == "parquet" else writer.options(**CSV).csv(staged)
    except Exception:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)
        raise
    _replace(spark, staged, path)
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def publish_categories(df: DataFrame, path: str, category: str, image: str) -> DataFrame:
    """A folder for each category, named by its slug and digest; returns the manifest, which is also written as ``<path>-manifest``.

    The manifest says how many rows and images each category has, and all have together
    (``category`` is null there).
    """
    publish_parts(df.withColumn("part", slug(F.col(category))), path, "part")
    counts = [F.count(F.lit(1)).alias("rows"), F.countDistinct(image).alias("images")]
    each = df.groupBy(F.col(category).alias("category"), slug(F.col(category)).alias("part")).agg(*counts)
    whole = df.agg(*counts).select(F.lit(None).cast("string").alias("category"), F.lit("all").alias("part"), "rows", "images")
    publish(each.unionByName(whole), f"{path}-manifest", single=True)
    return df.sparkSession.read.parquet(f"{path}-manifest")


def publish_tables(frames: Mapping[str, DataFrame], folder: str, kinds: Sequence[str] = ("parquet",)) -> DataFrame:
    """Writes several tables as one version, each kind of file of each, and then makes it the current one.

    Returns the manifest: each table's rows and digest.  Tables without rows keep their
    columns and types.  A failure leaves the version before in place; earlier versions stay
    for those who read them.
    """
    spark = next(iter(frames.values())).sparkSession
    version = uuid.uuid4().hex
    manifest = None
    for name, df in frames.items():
        for kind in kinds:
            publish(df, f"{folder}/{version}/{name}.{kind}", kind)
        first = spark.read.parquet(f"{folder}/{version}/{name}.parquet") if "parquet" in kinds else df
        one = table_fingerprint(first, first.columns).select(F.lit(name).alias("table"), "rows", "digest")
        manifest = one if manifest is None else manifest.unionByName(one)
    publish(manifest, f"{folder}/{version}/manifest.parquet", single=True)
    publish(spark.createDataFrame([(version,)], "version string"), f"{folder}/current", single=True)
    return spark.read.parquet(f"{folder}/{version}/manifest.parquet")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the current version: one snapshot, whatever is published meanwhile."""
    version = spark.read.parquet(f"{folder}/current").first()["version"]
    names = [r["table"] for r in spark.read.parquet(f"{folder}/{version}/manifest.parquet").select("table").collect()]
    return {n: spark.read.parquet(f"{folder}/{version}/{n}.parquet") for n in names}


def selected_rows(df: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """The rows of ``wanted`` keys in the order in which they were asked for, safe for spreadsheets; raises if one is missing."""
    asked = df.sparkSession.createDataFrame([(k, w) for k, w in enumerate(wanted)], f"__place long, __key {df.schema[key].dataType.simpleString()}")
    require_none(asked.join(df, asked["__key"] == df[key], "left_anti").select("__key"), "rows that don't exist")
    return safe_cells(asked.join(df, asked["__key"] == df[key]).orderBy("__place").drop("__place", "__key"))


def publish_archive(df: DataFrame, path: str, record: str, metadata: str, rows: int = 1000) -> DataFrame:
    """Archive shards (record, JSON, its MD5), checked after writing; returns what was written."""
    out = df.select(F.col(record).cast("string").alias("record_id"), F.col(metadata).alias("metadata_json"), F.md5(metadata).alias("metadata_md5"))
    publish(out, path, check=True, maxRecordsPerFile=rows)
    return df.sparkSession.read.parquet(path)


def publish_snapshot(df: DataFrame, folder: str) -> str:
    """Writes rows once under a name that is their digest, and points ``current`` to it; returns the revision."""
    total = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("h")).alias("x")
    ).first()
    revision = hashlib.sha256(json.dumps([df.schema.simpleString(), total["n"], str(total["s"]), total["x"]]).encode()).hexdigest()
    spark = df.sparkSession
    fs, p = _fs(spark, f"{folder}/{revision}")
    if not fs.exists(p):
        publish(df, f"{folder}/{revision}")
    pointer = spark.createDataFrame([(2, revision, total["n"])], "schema_version int, revision string, rows bigint")
    publish(pointer, f"{folder}/current", single=True)
    return revision


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``current`` points to; their number must be as it says."""
    pointer = spark.read.parquet(f"{folder}/current").first()
    df = spark.read.parquet(f"{folder}/{pointer['revision']}")
    if df.count() != pointer["rows"]:
        raise CheckFailed("the snapshot isn't whole")
    return df


def safe_cells(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would run as formulas get an apostrophe in front."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(F.col(c).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in texts})
