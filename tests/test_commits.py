"""Several tables as one version: commits, failures, readers, writers that meet, lookups by key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftstone.sources import commits


@pytest.fixture
def tables(spark):
    batches = spark.createDataFrame([(1, "a"), (2, None)], "batch int, name string")
    items = spark.range(500, numPartitions=3).select("id", (F.col("id") % 7).cast("decimal(9,2)").alias("n"), F.array("id").alias("list"))
    return {"batches": batches, "items": items, "none": batches.limit(0)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tables_come_back_whole(spark, tables, tmp_path):
    version = commits.publish(tables, str(tmp_path), keys={"items": "id"}, buckets=8)
    assert version.number == 1 and version.rows("items") == 500 and version.rows("none") == 0
    for name, df in tables.items():
        back = version.read(name)
        assert rows(back) == rows(df) and back.dtypes == df.dtypes


def test_a_failed_task_leaves_the_last_version(spark, tables, tmp_path):
    first = commits.publish(tables, str(tmp_path))
    bad = tables["items"].withColumn("n", F.when(F.col("id") == 499, F.raise_error("lost").cast("decimal(9,2)")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        commits.publish(tables | {"items": bad}, str(tmp_path), first)
    now = commits.current(spark, str(tmp_path))
    assert now.number == 1 and now.folder == first.folder and now.read("items").count() == 500
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["log", first.folder.rsplit("/", 1)[1]])


def test_files_that_no_task_reported_are_not_read(spark, tables, tmp_path):
    version = commits.publish(tables, str(tmp_path))
    of_a_lost_task = f"{version.folder}/batches/-1-lost.parquet"
    tables["batches"].toPandas().to_parquet(of_a_lost_task)
    assert commits.current(spark, str(tmp_path)).read("batches").count() == 2


def test_readers_keep_their_version(spark, tables, tmp_path):
    commits.publish(tables, str(tmp_path))
    one, two = (commits.current(spark, str(tmp_path)) for _ in range(2))
    before = rows(one.read("batches"))
    commits.publish({n: df.limit(1) for n, df in tables.items()}, str(tmp_path), one)
    assert rows(one.read("batches")) == rows(two.read("batches")) == before and one.read("items").count() == 500
    assert commits.current(spark, str(tmp_path)).read("items").count() == 1


def test_the_second_of_two_writers_is_refused(spark, tables, tmp_path):
    first = commits.publish(tables, str(tmp_path))
    commits.publish(tables, str(tmp_path), first)
    with pytest.raises(commits.Conflict):
        commits.publish(tables, str(tmp_path), first)
    with pytest.raises(commits.Conflict):  # found out only when the log's number is taken
        commits._claim(spark, str(tmp_path), 2, {})
    assert commits.current(spark, str(tmp_path)).number == 2


def test_an_update_is_tried_again_on_what_others_wrote(spark, tables, tmp_path):
    commits.publish(tables, str(tmp_path))
    seen = []

    def change(now):
        seen.append(now.number)
        if len(seen) == 1:  # another writer comes first
            commits.publish({"batches": now.read("batches").withColumn("name", F.lit("other"))}, str(tmp_path), now)
        return {"batches": now.read("batches").withColumn("batch", F.col("batch") + 10)}

    after = commits.update(spark, str(tmp_path), change)
    assert seen == [1, 2] and rows(after.read("batches")) == [(11, "other"), (12, "other")]


def test_updates_give_up(spark, tables, tmp_path):
    commits.publish({"batches": tables["batches"]}, str(tmp_path))

    def change(now):
        commits.publish({"batches": now.read("batches")}, str(tmp_path), now)
        return {}

    with pytest.raises(commits.Conflict):
        commits.update(spark, str(tmp_path), change, attempts=2)


def test_lookups_read_only_their_buckets(spark, tables, tmp_path):
    version = commits.publish(tables, str(tmp_path), keys={"items": "id"}, buckets=8)
    wanted = spark.createDataFrame([(3,), (3,), (None,), (9999,)], "id int")
    found = version.lookup("items", wanted)
    assert [r["id"] for r in found.collect()] == [3]
    assert 0 < len(found.inputFiles()) <= 2 < len(version.read("items").inputFiles())
    assert version.lookup("items", wanted.limit(0)).count() == 0
