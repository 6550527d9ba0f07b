"""Line dedup with levelled sorted runs of line hashes.

A run is a table of the lines that its batches met first, bucketed and sorted by 128 bits of
hash.  A new batch is anti-joined, merging sorted buckets, with the runs there are; what is
left is new, and becomes a run of its own.  ``FAN`` runs of a level are compacted into one of
the next, so that there are few of them however many batches come.  Beside the runs stand
tallies: in how many documents of a batch each line is; they are summed when runs are compacted.

Documents come in batches of falling identifiers.  So a line is first met in the largest
document that holds it, which keeps it; the tallies say whether it is frequent enough for the
others to lose it.

A line's rows are deduplicated by document before they are counted, and counted in part
before they are shuffled by line, so a line that very many documents hold is no heavy key.
Only DataFrame functions run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, shared_path, union_all, written

#: Batches that one call cuts its documents into.
BATCHES = 4
#: Runs of a level that are compacted into one.
FAN = 3
#: The white space that doesn't count at the ends of a line.
WHITE = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    line = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(ascii_lower(line))


class LineRuns:
    """The lines that were met so far.  Its tables stand in the shared folder until :meth:`drop`."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        self.paths: dict[str, str] = {}

    def _sorted(self, rows: DataFrame) -> str:
        name = f"siftstone_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, "lines")
        writer = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", self.paths[name]).saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        dropped(self.spark, self.paths.pop(name))

    def _all(self, which: int) -> list[DataFrame]:
        return [self.spark.table(pair[which]) for level in self.levels for pair in level]

    def add(self, lines: DataFrame) -> None:
        """Takes a batch: rows of ``h1``, ``h2`` and ``id``, repeats included.

        Batches come by falling identifiers; an identifier never comes in two batches.
        """
        once = lines.select(*KEY, "id").distinct()
        tally = self._sorted(once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")))
        new = self.spark.table(tally).select(*KEY, "last")
        for run in self._all(0):
            new = new.join(run, KEY, "left_anti")
        self._push(0, self._sorted(new), tally)

    def _push(self, level: int, run: str, tally: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((run, tally))
        if len(self.levels[level]) < self.fan:
            return
        full, self.levels[level] = self.levels[level], []
        runs, tallies = ([self.spark.table(pair[k]) for pair in full] for k in (0, 1))
        merged = self._sorted(union_all(runs)), self._sorted(_summed(tallies).select(*KEY, "docs", F.lit(None).cast("long").alias("last")))
        for name in [n for pair in full for n in pair]:
            self._remove(name)
        self._push(level + 1, *merged)

    def frequent(self, least: int) -> DataFrame:
        """``h1``, ``h2`` and ``keeper`` of lines that at least so many documents hold."""
        if not self.levels:
            return self.spark.createDataFrame([], "h1 long, h2 long, keeper long")
        often = _summed(self._all(1)).filter(F.col("docs") >= least)
        return often.join(union_all(self._all(0)), KEY).select(*KEY, F.col("last").alias("keeper"))

    def drop(self) -> None:
        for name in list(self.paths):
            self._remove(name)
        self.levels = []


def _summed(tallies: list[DataFrame]) -> DataFrame:
    return union_all([t.select(*KEY, "docs") for t in tallies]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))


def _batch(ids: DataFrame, batches: int) -> Column:
    """The number of a row's batch; the largest identifiers are in batch 0, null ones in the last."""
    cuts = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number = number + (F.col("id") <= cut).cast("int")
    return F.coalesce(number, F.lit(len(set(cuts or []))))


def drop_frequent_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5, least_chars: int = 40, batches: int = BATCHES, fan: int = FAN
) -> DataFrame:
    """For each row of ``df``: ``id_col``, ``n_lines``, ``n_dropped`` and ``kept``, the text that is left.

    Lines whose key (:func:`line_key`) has ``least_chars`` code points and is found in
    ``least_docs`` documents stay only in the largest identifier that holds them, there as
    often as they stand.  A null or empty text is one empty line; a text that loses all of its
    lines is empty.  Identifiers are whole numbers.  Rows with one identifier are one document;
    null ones are one, smaller than any other.  An empty table gives an empty result.  Other
    columns are not read, whatever their names.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.select("id", "text", F.xxhash64("text").alias("hash"))
    # The key is no longer than its line.
    lines = docs.select("id", "hash", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.char_length("line") >= least_chars)
    lines = lines.select("id", "hash", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    lines = lines.select("id", "hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(least_chars), "key", F.lit(1)).alias("h2"), _batch(docs, batches).alias("batch"))
    path = shared_path(spark, "by-batch")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fan)
    try:
        for k in range(batches):
            runs.add(lines.filter(F.col("batch") == k))
        frequent = written(runs.frequent(least_docs), "frequent")
    finally:
        runs.drop()
    goes = lines.join(frequent, KEY).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    goes = goes.groupBy(F.col("id").alias("of"), F.col("hash").alias("in")).agg(F.collect_list("at").alias("goes"))
    found = docs.join(goes, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("in")), "left")
    split = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("goes"))
    found = found.select("id", "text", split.alias("l"), F.when(F.col("goes").isNotNull(), stays).alias("stays"))
    return found.select(
        F.col("id").alias(id_col),
        F.size("l").cast("long").alias("n_lines"),
        F.when(F.col("stays").isNull(), F.lit(0)).otherwise(F.size("l") - F.size("stays")).cast("long").alias("n_dropped"),
        F.when(F.col("stays").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stays", lambda i: F.get("l", i)), "\n")).alias("kept"),
    )
