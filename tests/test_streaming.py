"""Incremental forms give what batches give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siftstone.operators import versioned
from siftstone.streaming import review_log


def test_stream_of_saves(spark, tmp_path):
    rows = [("i", "r", 1, "s1", "a", 0), ("i", "r", 2, "s1", "a", 0), ("j", "r", 1, "s9", "b", 3), ("i", "r", 3, "s2", "b", 1)]
    schema = "item string, reviewer string, seq long, submission string, label string, expected int"
    folder = str(tmp_path / "in")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(folder)
    stream = review_log.saves(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder))
    q = stream.writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["item"], r["seq"], r["result"]) for r in spark.table("saves").collect())
    batch = sorted((r["item"], r["seq"], r["result"]) for r in versioned.apply_log(spark.createDataFrame(rows, schema)).collect())
    assert got == batch


def test_retry_queue(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    r = spark.createDataFrame([("a", "ok"), ("b", "error"), ("b", "error"), ("b", "error")], "k string, status string")
    assert {x["k"]: (x["state"], x["passes"]) for x in review_log.retry_queue(q, r, ["k"]).collect()} == {"a": ("done", 0), "b": ("failed", 3), "c": ("pending", 0)}


def test_hourly_calls_in_batch_form(spark):
    e = spark.createDataFrame([("2024-01-01 10:05:00", "x"), ("2024-01-01 10:50:00", "x"), ("2024-01-01 11:00:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["calls"] for r in review_log.hourly_calls(e, "t", "k").collect()) == [1, 2]


def stream_of(spark, schema, folder, build, out, checkpoint):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    q = build(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_queue_goes_on_after_a_restart(spark, tmp_path):
    from siftstone.streaming import work_queue

    work_queue.use_rocksdb(spark)
    schema = "photo string, endpoint string, at timestamp, outcome string"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    build = lambda rows: work_queue.retried(rows, idle=dt.timedelta(days=2))
    put(spark, [("a", "info", at(0), "error"), ("a", "info", at(1), "error"), ("a", "sizes", at(1), "ok"), ("b", "info", at(1), None), ("c", "info", at(0), "photo_unavailable")], schema, folder)
    stream_of(spark, schema, folder, build, out, checkpoint)
    put(spark, [("a", "info", at(2), "error"), ("a", "info", at(3), "ok"), ("a", "sizes", at(3), "error"), ("c", "info", at(3), "error")], schema, folder)
    stream_of(spark, schema, folder, build, out, checkpoint)  # starts again from its checkpoint
    put(spark, [("z", "info", at(200), "ok")], schema, folder)  # moves the watermark on
    stream_of(spark, schema, folder, build, out, checkpoint)
    put(spark, [("z", "sizes", at(201), "ok"), ("b", "info", at(201), "error"), ("b", "info", at(1), "ok")], schema, folder)  # the last one is too late
    stream_of(spark, schema, folder, build, out, checkpoint)
    got = [(r["photo"], r["endpoint"], r["state"], r["passes"]) for r in spark.read.parquet(out).orderBy("at", "photo", "endpoint").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", "info", "pending", 1), ("a", "info", "pending", 2), ("a", "sizes", "complete", 0), ("a", "info", "failed", 3)]
    assert [g for g in got if g[0] == "b"] == [("b", "info", "pending", 1), ("b", "info", "abandoned", 1), ("b", "info", "pending", 1)]
    assert [g for g in got if g[0] == "c"] == [("c", "info", "complete", 0)]


def test_streamed_budget_is_that_of_the_batch(spark, tmp_path):
    from siftstone.operators import archive
    from siftstone.streaming import work_queue

    work_queue.use_rocksdb(spark)
    schema = "id int, k string, t timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = [(n, "xy"[n % 2], start + dt.timedelta(minutes=7 * n)) for n in range(40)] + [(100 + n, "x", start + dt.timedelta(minutes=70)) for n in range(3)]
    late = [(200, "x", start + dt.timedelta(minutes=130)), (201, "y", start)]  # within what is allowed, and beyond
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows[:20] + rows[40:], late + rows[20:40], [(300, "z", start + dt.timedelta(days=2))], [(301, "z", start + dt.timedelta(days=3))]):
        put(spark, part, schema, folder)
        stream_of(spark, schema, folder, lambda r: work_queue.budgeted(r, "t", "k", 3600, 7, "30 minutes"), out, checkpoint)
    got = {(r["ledger"], r["at"]): (r["calls"], r["in_window"], r["over_budget"]) for r in spark.read.parquet(out).collect() if r["ledger"] != "z"}
    batch = archive.rolling_calls(spark.createDataFrame(rows + late[:1], schema), "t", "k", 3600, 7)
    want = {(r["k"], r["t"]): (r["calls"], r["n"], r["o"]) for r in batch.groupBy("k", "t").agg(F.count("id").alias("calls"), F.max("in_window").alias("n"), F.max("over_budget").alias("o")).collect()}
    assert got == want and any(v[2] for v in want.values())
