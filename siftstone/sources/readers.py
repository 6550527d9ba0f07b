"""Sources: typed and inferred files, late fields, pinned and changing files, archives, gazetteers, polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..operators.checks import CheckFailed, duplicates, require_columns, require_none
from ..operators.gazetteer import read_zipped_lines
from ..operators.rounds import ranked

INFERRED_ROWS = 100
#: Stands for an unquoted empty value, so that a quoted one stays an empty text.
NO_VALUE = "\x00none"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, strings: bool = False, lines: bool = False) -> DataFrame:
    """A CSV with a header.  Only an unquoted empty value is null.

    Without a schema the types are those of the first rows, and then strict.  Values may span
    lines, which makes a file one task; where none does, ``lines`` lets Spark split files.
    A header without a name for a column is an error.
    """
    options = {"header": True, "multiLine": not lines, "escape": '"', "mode": "FAILFAST", "nullValue": NO_VALUE, "emptyValue": "", "enforceSchema": False}
    names = spark.read.options(**options).csv(path).columns
    if unnamed := [c for k, c in enumerate(names) if not c.strip() or c == f"_c{k}"]:
        raise CheckFailed(f"{path}: columns without a name {unnamed}")
    if strings:
        schema = ", ".join(f"`{c}` string" for c in names)
    elif schema is None:
        head = spark.read.options(**options).csv(path).limit(INFERRED_ROWS)
        lines = head.select(F.to_json(F.struct("*")).alias("j"))
        kinds = {c: _kind(lines, c) for c in head.columns}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in head.columns)
    return spark.read.schema(schema).options(**options).csv(path)


def _kind(lines: DataFrame, column: str) -> str:
    """The narrowest type that all of a sample's values of a column have."""
    value = F.get_json_object("j", f"$['{column}']")
    tests = {"bigint": value.rlike(r"^[+-]?\d{1,18}$"), "double": value.try_cast("double").isNotNull(), "boolean": F.lower(value).isin("true", "false"), "timestamp_ntz": value.try_cast("timestamp_ntz").isNotNull() & value.contains("-")}
    found = lines.agg(F.count(value).alias("n"), *[F.coalesce(F.bool_and(value.isNull() | t), F.lit(False)).alias(k) for k, t in tests.items()]).first()
    return next((k for k in tests if found["n"] and found[k]), "string")


def read_ndjson(spark: SparkSession, path: str, known: StructType | str) -> DataFrame:
    """JSON lines with the fields of ``known`` and ``rest``: the whole record as a variant, with fields that turn up late.

    Blank lines are skipped; a line that isn't JSON is an error.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", known, {"mode": "FAILFAST"}).alias("k"), F.parse_json("value").alias("rest")).select("k.*", "rest")


def _leaf(value: Column) -> Column:
    """A plain value as JSON."""
    return F.when(value.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', ""))


def _restored(kind: DataType, typed: Column, raw: Column) -> Column:
    """JSON of ``typed`` with what ``raw``, a variant of the same value, has besides."""
    whole = F.coalesce(F.to_json(raw), F.lit("null"))
    if isinstance(kind, StructType):
        names = [f.name for f in kind]
        known = [F.concat(_leaf(F.lit(f.name)), F.lit(":"), _restored(f.dataType, typed[f.name], F.try_variant_get(raw, f"$['{f.name}']", "variant"))) for f in kind]
        rest = F.filter(F.map_entries(F.try_variant_get(raw, "$", "map<string,variant>")), lambda e: ~e["key"].isin(*names))
        late = F.transform(rest, lambda e: F.concat(_leaf(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
        body = F.array_join(F.concat(F.array(*known), F.coalesce(late, F.expr("CAST(array() AS ARRAY<STRING>)"))), ",")
        return F.when(typed.isNull(), whole).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    if isinstance(kind, ArrayType):
        items = F.try_variant_get(raw, "$", "array<variant>")
        each = F.transform(typed, lambda x, k: _restored(kind.elementType, x, F.get(items, k)))
        return F.when(typed.isNull(), whole).otherwise(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
    return _leaf(typed)


def restored_records(df: DataFrame, rest: str = "rest") -> DataFrame:
    """``df`` of :func:`read_ndjson` with ``record``: each line's JSON with known fields as they were read, and all others.

    Fields that the known type lacks come back at any depth, in lists as well, behind the
    known ones, in the order of names.  The known type decides the expression; no value goes
    through Python.
    """
    known = StructType([f for f in df.schema if f.name != rest])
    return df.withColumn("record", _restored(known, F.struct(*[F.col(f"`{f.name}`") for f in known]), F.col(rest)))


def late_columns(df: DataFrame, rest: str = "rest") -> DataFrame:
    """``df`` of :func:`read_ndjson` with each top-level field that its columns lack as a column of JSON text, in the order of names.

    Fields that turn up in any line count; ``rest`` goes.  Only the fields' names are gathered.
    """
    keys = df.select(F.explode(F.json_object_keys(F.to_json(rest))).alias("k")).distinct()
    late = sorted(r["k"] for r in keys.filter(~F.col("k").isin(*df.columns)).collect())
    return df.withColumns({c: F.to_json(F.try_variant_get(rest, f"$['{c}']", "variant")) for c in late}).drop(rest)


def load(spark: SparkSession, path: str, known: StructType | str | None = None) -> DataFrame:
    """A reader by suffix: parquet, csv, ndjson or jsonl (also gzipped)."""
    name = path.removesuffix(".gz").rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return read_csv(spark, path, known)
    if name.endswith((".ndjson", ".jsonl")):
        return read_ndjson(spark, path, known) if known else spark.read.json(path)
    raise CheckFailed(f"{path}: not a parquet, csv, ndjson or jsonl file")


def load_with_id(spark: SparkSession, path: str, id_col: str, required: Sequence[str] = ()) -> DataFrame:
    """A frame whose identifier is text, whatever the file's type says, with its columns checked."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    require_columns(df, [id_col, *required])
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of each file of an input."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Raises if files were added, removed or written in between (compare lists taken before and after a read)."""
    require_none(before.exceptAll(after).unionByName(after.exceptAll(before)), "the input changed while it was read")


def read_pinned_csv(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A (gzipped, then named ``.gz``) CSV of strings whose unpacked bytes must have a known digest; a byte order mark is dropped.

    The bytes stream through the digest; no more than a buffer of them is held.
    """
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    if path.endswith(".gz"):
        stream = jvm.java.util.zip.GZIPInputStream(stream)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.security.DigestInputStream(stream, digest), jvm.java.io.OutputStream.nullOutputStream(), 1 << 16, True)
    if bytes(b & 255 for b in digest.digest()).hex() != sha256:
        raise CheckFailed(f"{path} isn't the pinned file")
    df = read_csv(spark, path, strings=True)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def read_plan(spark: SparkSession, path: str, key: str) -> DataFrame:
    """JSON lines, plain or gzipped, with one line for each key."""
    df = spark.read.json(path)
    require_none(duplicates(df, [key]), f"{key} is repeated")
    return df


def read_archive(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Archived records (``record_id``, ``metadata_json``, ``metadata_md5``), each checked against its digest."""
    rows = spark.read.parquet(path)
    require_none(rows.filter(~F.md5("metadata_json").eqNullSafe(F.col("metadata_md5"))).select("record_id"), "damaged records")
    return rows.join(wanted.select("record_id").distinct(), "record_id") if wanted is not None else rows


def read_gazetteer(spark: SparkSession, countries: str, regions: str, settlements: str) -> DataFrame:
    """Places of three tab-separated dumps, with level, country, region, names and, for settlements, coordinates and population.

    A path such as ``towns.zip!towns.txt`` names a member of zip archives.
    """

    def tsv(path: str) -> DataFrame:
        archive, _, member = path.partition("!")
        lines = (read_zipped_lines(spark, archive, member) if member else spark.read.text(path)).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        return lines.select(F.split("value", "\t").alias("f"))

    f = lambda k: F.get("f", k)
    land = tsv(countries).filter(F.size("f") >= 17).select(f(16).alias("place_id"), f(4).alias("name"), F.lit("country").alias("level"), f(0).alias("country"))
    part = tsv(regions).filter(F.size("f") >= 4).select(f(3).alias("place_id"), f(1).alias("name"), f(2).alias("ascii_name"), F.lit("region").alias("level"), F.split(f(0), r"\.")[0].alias("country"), F.get(F.split(f(0), r"\."), 1).alias("admin1"))
    town = tsv(settlements).filter(F.size("f") >= 15).select(
        f(0).alias("place_id"), f(1).alias("name"), f(2).alias("ascii_name"), f(3).alias("alternates"), F.lit("settlement").alias("level"), f(8).alias("country"), f(10).alias("admin1"),
        f(4).try_cast("double").alias("latitude"), f(5).try_cast("double").alias("longitude"), f(14).try_cast("bigint").alias("population"),
    )
    return town.unionByName(part, allowMissingColumns=True).unionByName(land, allowMissingColumns=True)


def read_polygons(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Polygons of a GeoJSON file: ``region``, ``rings`` of [lon, lat] with four decimals, and their box."""
    ring = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    shape = "type STRING, features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    f = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    one = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, ring))).otherwise(F.from_json(text, f"ARRAY<{ring}>"))
    rings = F.transform(F.flatten(one), lambda r: F.transform(r, lambda p: F.transform(p, lambda c: F.bround(c, 4))))
    out = f.select(F.element_at("f.properties", name).alias("region"), rings.alias("rings"))
    points = F.flatten("rings")

    def edge(best, k):
        return best(F.transform(points, lambda p: p[k]))

    return out.withColumn("box", F.array(edge(F.array_min, 0), edge(F.array_min, 1), edge(F.array_max, 0), edge(F.array_max, 1)))


def read_vocabularies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Label vocabularies of any versions, a JSON file each: labels, and what is derived from them.

    Labels: (``version``, ``code``, ``name``, ``group``, ``priority``, ``shortcut``); mappings:
    (``version``, ``mapping``, ``code``).  Codes, priorities and shortcuts that repeat in a
    version, and mappings of codes that it lacks, abort.
    """
    label = "struct<code: string, displayLabel: string, group: string, priority: int, shortcut: string>"
    files = spark.read.schema(f"schemaVersion string, labels array<{label}>, mappings map<string, array<string>>").json(path, multiLine=True, mode="FAILFAST")
    version = F.col("schemaVersion").alias("version")
    labels = files.select(version, F.explode("labels").alias("l")).select("version", "l.code", F.col("l.displayLabel").alias("name"), "l.group", "l.priority", "l.shortcut")
    mappings = files.select(version, F.explode("mappings").alias("mapping", "codes")).select("version", "mapping", F.explode("codes").alias("code"))
    require_none(labels.filter("code IS NULL OR priority IS NULL"), "labels without a code or priority")
    for column in ("code", "priority"):
        require_none(duplicates(labels, ["version", column]), f"a version repeats a {column}")
    require_none(duplicates(labels.filter("shortcut IS NOT NULL"), ["version", "shortcut"]), "a version repeats a shortcut")
    require_none(mappings.join(labels, ["version", "code"], "left_anti"), "mappings of codes that their version lacks")
    return labels, mappings


def label_priorities(labels: DataFrame, current: str) -> DataFrame:
    """(``code``, ``priority`` from 0): the current version's labels in their order, then those that only older ones have, by the last version and priority there."""
    now = F.col("version") == current
    of = labels.groupBy("code").agg(F.min(F.when(now, F.col("priority"))).alias("p"), F.max(F.struct("version", (-F.col("priority")).alias("q"))).alias("last"))
    require_none(of.agg(F.count("p").alias("n")).filter("n = 0"), f"no version {current}")
    ordered = of.select("code", F.col("p").isNull().alias("old"), F.coalesce(F.col("p"), F.lit(0)).alias("p"), F.when(F.col("p").isNull(), F.col("last.version")).alias("v"), (-F.col("last.q")).alias("q"))
    return ranked(ordered, [], ["old", "p", "v", "q", "code"], "n").select("code", (F.col("n") - 1).cast("int").alias("priority"))


def ordinals(spark: SparkSession, n: int) -> DataFrame:
    """0 .. n-1, made where it is needed."""
    return spark.range(n).withColumnRenamed("id", "ordinal")
