"""Archives of bulky metadata, frozen inputs and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_overlay_members, json_overlay_others
from .candidates import byte_chunks
from .checks import CheckFailed, duplicates, require_none, table_fingerprint
from .staging import staged


#: The key that stands for archived metadata.
REFERENCE = "archive_record"
#: Rows and bytes of a shard at most, and bytes of a record.
SHARD_ROWS, SHARD_BYTES, RECORD_BYTES = 1000, 8 << 20, 16 << 20


def compacted(metadata: Column, record: Column, provenance: str) -> Column:
    """What is left in place of archived metadata: a reference, and the provenance, as it is written, if there is any."""
    return json_overlay_members(F.to_json(F.struct(record.cast("string").alias(REFERENCE))), metadata, F.array(F.lit(provenance)))


def shards(df: DataFrame, record: str, metadata: str, rows: int = SHARD_ROWS, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """(record, ``shard``, metadata, ``metadata_md5``): records in order; a shard ends before so many rows or bytes are exceeded.

    A record that is longer than a shard has one of its own; one beyond ``RECORD_BYTES``, and
    a repeated identifier, abort.
    """
    kept = df.select(record, F.col(metadata).alias("metadata_json"), F.lit(0).alias("__all"), F.octet_length(metadata).cast("long").alias("__bytes"))
    require_none(kept.filter(F.col("__bytes") > RECORD_BYTES).select(record), "metadata are longer than a record may be")
    require_none(duplicates(kept, [record]), f"{record} is repeated")
    cut = byte_chunks(kept, "__all", [record], "__bytes", most_bytes, rows, "__chunk")
    # kept, as what reads an archive (checks, swaps, manifests) would cut it again each time
    return staged(cut.select(record, (F.col("__chunk") - 1).cast("long").alias("shard"), "metadata_json", F.md5("metadata_json").alias("metadata_md5")))


def manifest(archived: DataFrame, record: str) -> DataFrame:
    """A row for each shard: ``records``, ``bytes``, first and last record, and a digest that no order changes."""
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col(record).cast("string"), "metadata_md5"))), ","), 256)  # a bounded number of rows
    return archived.groupBy("shard").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("metadata_json")).alias("bytes"), F.min(record).alias("first"), F.max(record).alias("last"), digest.alias("digest")
    )


def require_archive(archived: DataFrame, record: str, kept: DataFrame) -> None:
    """Raises unless an archive that was read again gives the manifest that was kept."""
    require_none(archived.filter(F.md5("metadata_json") != F.col("metadata_md5")), "archived records are damaged")
    now = manifest(archived, record)
    require_none(now.exceptAll(kept).unionByName(kept.exceptAll(now)), "shards differ from their manifest")


def swapped(table: DataFrame, archived: DataFrame, record: str, metadata: str, provenance: str) -> DataFrame:
    """``table`` with compact metadata where the row is still what was archived; raises if a row has changed."""
    found = table.join(archived.select(F.col(record).alias("__r"), "metadata_md5"), F.col(record) == F.col("__r"), "left")
    require_none(found.filter(F.col("metadata_md5").isNotNull() & ~F.md5(metadata).eqNullSafe(F.col("metadata_md5"))).select(record), "rows changed since they were archived")
    compact = compacted(F.col(metadata), F.col(record), provenance)
    return found.withColumn(metadata, F.when(F.col("metadata_md5").isNotNull(), compact).otherwise(F.col(metadata))).drop("__r", "metadata_md5")


def restored(table: DataFrame, archived: DataFrame, record: str, metadata: str) -> DataFrame:
    """``table`` with archived metadata back where its reference stands, under the row's other keys.

    Keys that the row has beside its reference win over the archived ones; numbers and all
    else stay as they are written, and archived text without such keys comes back byte for
    byte.  Raises for references without a record, and for those that can't be read.
    """
    text = F.col(metadata)
    marked = staged(table.withColumn("__ref", F.get_json_object(metadata, f"$.{REFERENCE}")))  # the checks read it, too
    require_none(marked.filter(F.col("__ref").isNull() & text.contains(f'"{REFERENCE}"') & F.try_parse_json(text).isNull()).select(record), "references can't be read")
    known = archived.select(F.col(record).cast("string").alias("__a"), "metadata_json")
    out = marked.join(known, F.col("__ref") == F.col("__a"), "left")
    require_none(out.filter(F.col("__ref").isNotNull() & F.col("metadata_json").isNull()).select(record), "references without an archived record")
    back = json_overlay_others(F.col("metadata_json"), text, F.array(F.lit(REFERENCE)))
    return out.withColumn(metadata, F.when(F.col("metadata_json").isNotNull(), back).otherwise(text)).drop("__ref", "__a", "metadata_json")


def fetched(archived: DataFrame, kept: DataFrame, record: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` from those shards alone that hold them, each shard checked against its manifest.

    ``kept``: what :func:`manifest` gave.  A shard's first and last record tell which it can
    be; damaged shards abort, and so do wanted records that no shard holds.
    """
    asked = wanted.select(F.col(record).alias("__w")).distinct()
    of = asked.join(kept.select("shard", "first", "last"), F.col("__w").between(F.col("first"), F.col("last")))
    some = archived.join(of.select("shard").distinct(), "shard", "left_semi")
    require_none(some.filter(~F.md5("metadata_json").eqNullSafe(F.col("metadata_md5"))).select(record), "archived records are damaged")
    told = kept.join(of.select("shard").distinct(), "shard", "left_semi")
    require_none(told.exceptAll(manifest(some, record)), "shards differ from their manifest")
    out = some.join(asked, F.col(record) == F.col("__w"), "left_semi")
    require_none(asked.join(out, F.col(record) == F.col("__w"), "left_anti"), "records that no shard holds")
    return out


def frozen(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a copy under ``path``, with its fingerprint beside it; an existing copy is read and checked, not replaced."""
    spark = df.sparkSession
    data, mark = f"{path}/data", f"{path}/fingerprint"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{mark}/_SUCCESS")):
        df.write.mode("overwrite").parquet(data)
        table_fingerprint(spark.read.parquet(data), df.columns).write.mode("overwrite").parquet(mark)
    copy = spark.read.parquet(data)
    if table_fingerprint(copy, copy.columns).first() != spark.read.parquet(mark).first():
        raise CheckFailed(f"the frozen input {path} has changed")
    return copy


def column_dictionary(df: DataFrame) -> DataFrame:
    """(``column``, ``type``, ``filled``, ``place``): the columns of a table, and how many rows have a value."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns)])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(str(k)).alias("filled"), F.lit(k + 1).cast("long").alias("place")) for k, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def source_profile(df: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """One row: ``rows``, distinct keys, and the characters of each text column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), *[F.coalesce(F.sum(F.char_length(c)), F.lit(0)).alias(f"{c}_characters") for c in texts])


def rolling_calls(calls: DataFrame, at: str, key: str, seconds: int = 3600, budget: int = 3500) -> DataFrame:
    """``calls`` with ``in_window`` (calls of the last ``seconds`` up to and with each) and whether these exceed ``budget``.

    The window looks back over each key's own ledger.  Time is cut into slices as long as it:
    a call is counted in its own slice and, for the calls there, in the next, so a task holds
    two slices of a key at a time and never its whole ledger.  Calls without a time have none.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    length = seconds * 1_000_000
    own = calls.withColumns({"__at": micros, "__slice": F.floor(micros / length)})
    twice = own.withColumn("__s", F.explode(F.array("__slice", F.col("__slice") + 1)))
    back = Window.partitionBy(key, "__s").orderBy("__at").rangeBetween(-length + 1, 0)
    counted = twice.filter("__at IS NOT NULL").withColumn("in_window", F.count(F.lit(1)).over(back)).filter("__s = __slice")
    out = counted.unionByName(own.filter("__at IS NULL").withColumns({"__s": F.col("__slice"), "in_window": F.lit(None).cast("long")}))
    return out.withColumn("over_budget", F.col("in_window") > budget).drop("__at", "__slice", "__s")


def next_jobs(queue: DataFrame, slot: str, priority: str, tries: str, at: str, key: str, most: int = 3) -> DataFrame:
    """The job that each slot of a work queue takes next: not failed for good, of the highest priority, the oldest, the least key."""
    waiting = queue.filter(F.col(tries) < most)
    rest = [c for c in queue.columns if c != slot]
    best = waiting.groupBy(slot).agg(F.min_by(F.struct(*rest), F.struct(-F.col(priority), F.col(at), F.col(key))).alias("job"))
    return best.select(slot, "job.*")
