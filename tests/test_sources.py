"""Readers and sinks."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators.checks import CheckFailed
from siftstone.sources import readers, sinks


def test_csv_keeps_null_apart_from_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb', True), (2, "", None), (3, None, False)], "n int, t string, f boolean")
    path = str(tmp_path / "out.csv")
    sinks.publish(df, path, "csv", single=True)
    back = readers.read_csv(spark, path, "n int, t string, f boolean")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_types_are_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,1.5,true,x\n2,,false,\n")
    df = readers.load(spark, str(tmp_path / "a.csv"))
    assert [k for _, k in df.dtypes] == ["bigint", "double", "boolean", "string"] and df.count() == 2


def test_ndjson_keeps_late_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "late": {"x": [1]}}\n')
    df = readers.read_ndjson(spark, str(tmp_path / "a.jsonl"), "a int")
    got = df.orderBy("a").select("a", F.variant_get("rest", "$.late.x[0]", "int").alias("x")).collect()
    assert [tuple(r) for r in got] == [(1, None), (2, 1)]


def test_unknown_fields_come_back_at_any_depth(spark, tmp_path):

    lines = [{"a": 1, "deep": {"b": {"c": 2, "new": [1, {"x": "y"}]}, "late": None}, "items": [{"n": 1, "m": {"z": 0}}, {"n": 2}, {}]}, {"a": None, "other": 'quote " and \\'}, {"deep": None, "items": [], "q'": 1.5}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = readers.read_ndjson(spark, str(tmp_path / "a.jsonl"), "a int, deep struct<b: struct<c: int>>, items array<struct<n: int>>")
    got = [json.loads(r["record"]) for r in readers.restored_records(df).collect()]

    def without_nulls(x):
        return {k: without_nulls(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [without_nulls(v) for v in x] if isinstance(x, list) else x

    assert list(map(without_nulls, got)) == list(map(without_nulls, lines)) and got[0]["deep"]["late"] is None and list(got[0]) == ["a", "deep", "items"]


def test_late_fields_become_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "late": {"x": [1]}, "b c": "t"}\n')
    df = readers.late_columns(readers.read_ndjson(spark, str(tmp_path / "a.jsonl"), "a int"))
    assert df.columns == ["a", "b c", "late"] and sorted(map(tuple, df.collect())) == [(1, None, None), (2, '"t"', '{"x":[1]}')]


def test_csv_needs_names_and_may_be_split(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,\n1,2\n")
    with pytest.raises(CheckFailed, match="without a name"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f"{k},x\n" for k in range(50)))
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string", lines=True).count() == 50


def test_sets_of_tables_are_one_version(spark, tmp_path):
    folder = str(tmp_path / "set")
    a, b = spark.range(3), spark.createDataFrame([], "x string, n int")
    manifest = sinks.publish_tables({"a": a, "b": b}, folder, ("parquet", "csv"))
    assert sorted((r["table"], r["rows"]) for r in manifest.collect()) == [("a", 3), ("b", 0)]
    one = sinks.read_tables(spark, folder)
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish_tables({"a": spark.range(9), "b": b.withColumn("x", F.lit("y")).union(spark.range(1).select(F.raise_error(F.lit("no")).cast("string"), F.lit(1)))}, folder)
    assert sinks.read_tables(spark, folder)["a"].count() == 3
    sinks.publish_tables({"a": spark.range(5), "b": b}, folder)
    assert sinks.read_tables(spark, folder)["a"].count() == 5 and one["a"].count() == 3 and one["b"].schema.simpleString() == "struct<x:string,n:int>"


def test_categories_and_selections(spark, tmp_path):
    df = spark.createDataFrame([("A b", 1), ("A b", 1), ("a B", 2)], "c string, i int")
    got = {(r["category"], r["rows"], r["images"]) for r in sinks.publish_categories(df, str(tmp_path / "c"), "c", "i").collect()}
    assert got == {("A b", 2, 1), ("a B", 1, 1), (None, 3, 2)} and spark.read.parquet(str(tmp_path / "c")).select("part").distinct().count() == 2
    rows = spark.createDataFrame([(1, "=x"), (2, "b"), (3, "c")], "k int, t string")
    assert [tuple(r) for r in sinks.selected_rows(rows, "k", [3, 1]).collect()] == [(3, "c"), (1, "'=x")]
    with pytest.raises(CheckFailed):
        sinks.selected_rows(rows, "k", [9])
    with pytest.raises(CheckFailed):
        sinks.require_contract(rows.select(F.lit(-1).cast("long").alias("n")), spark.range(0).withColumnRenamed("id", "n").select(F.lit(1).cast("long").alias("n")).schema, unsigned=["n"])


def test_inputs_that_change(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    before = spark.createDataFrame(readers.file_states(spark, path).collect(), "path string, length long, modificationTime timestamp")
    readers.require_unchanged(before, readers.file_states(spark, path))
    spark.range(1).write.mode("append").parquet(path)
    with pytest.raises(CheckFailed):
        readers.require_unchanged(before, readers.file_states(spark, path))
    (tmp_path / "p.jsonl").write_text('{"k": 1}\n{"k": 1}\n')
    with pytest.raises(CheckFailed):
        readers.read_plan(spark, str(tmp_path / "p.jsonl"), "k")
    (tmp_path / "i.csv").write_text("id,v\n007,x\n")
    assert readers.load_with_id(spark, str(tmp_path / "i.csv"), "id").dtypes[0] == ("id", "string")


def test_pinned_file(spark, tmp_path):
    data = b"\xef\xbb\xbfid,v\n1,x\n"
    path = tmp_path / "p.csv.gz"
    path.write_bytes(gzip.compress(data))
    df = readers.read_pinned_csv(spark, str(path), hashlib.sha256(data).hexdigest())
    assert df.columns == ["id", "v"] and df.first()["v"] == "x"
    with pytest.raises(CheckFailed):
        readers.read_pinned_csv(spark, str(path), "0" * 64)


def test_failed_publish_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path, check=True)
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish(spark.range(5).withColumn("x", F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 3
    sinks.publish(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4


def test_archive_notices_damage(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([("1", '{"a":1}'), ("2", '{"b":2}')], "id string, m string")
    sinks.publish_archive(rows, path, "id", "m")
    wanted = spark.createDataFrame([("2",)], "record_id string")
    assert [r["metadata_json"] for r in readers.read_archive(spark, path, wanted).collect()] == ['{"b":2}']
    bad = spark.read.parquet(path).withColumn("metadata_json", F.lit("{}"))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(CheckFailed):
        readers.read_archive(spark, str(tmp_path / "bad"))


def test_snapshots_and_parts(spark, tmp_path):
    folder = str(tmp_path / "s")
    df = spark.range(10).withColumn("c", F.col("id") % 3)
    one = sinks.publish_snapshot(df, folder)
    assert sinks.publish_snapshot(df.repartition(3), folder) == one
    assert readers_equal(sinks.read_snapshot(spark, folder), df)
    counts = sinks.publish_parts(df, str(tmp_path / "parts"), "c")
    assert sorted(map(tuple, counts.collect())) == [(0, 4), (1, 3), (2, 3)]


def readers_equal(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_gazetteer_and_polygons(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# note\n" + "\t".join(["FR", "FRA", "250", "FR", "France", "Paris"] + ["x"] * 10 + ["3017382", "y"]) + "\n")
    (tmp_path / "a.txt").write_text("FR.11\tIle-de-France\tIle-de-France\t3012874\n")
    (tmp_path / "s.txt").write_text("\t".join(["2988507", "Paris", "Paris", "", "48.85", "2.35", "P", "PPLC", "FR", "", "11", "", "", "", "2138551", "", "", "", ""]) + "\n")
    got = readers.read_gazetteer(spark, *(str(tmp_path / f"{n}.txt") for n in "cas")).orderBy("level").collect()
    assert [(r["place_id"], r["level"], r["latitude"]) for r in got] == [("3017382", "country", None), ("3012874", "region", None), ("2988507", "settlement", 48.85)]
    shape = {"type": "FeatureCollection", "features": [{"properties": {"name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1.00004, 0], [1, 2]]]}}]}
    (tmp_path / "p.json").write_text(json.dumps(shape))
    row = readers.read_polygons(spark, str(tmp_path / "p.json"), "name").first()
    assert row["region"] == "sq" and row["box"] == [0.0, 0.0, 1.0, 2.0]


def test_formulas_are_made_safe(spark):
    df = spark.createDataFrame([("=1+1",), ("ok",), (None,)], "t string")
    assert [r[0] for r in sinks.safe_cells(df).collect()] == ["'=1+1", "ok", None]


def test_vocabularies_of_several_versions(spark, tmp_path):

    def put(version, codes, mappings):
        labels = [{"code": c, "displayLabel": c.title(), "group": "g", "priority": k, "shortcut": c[0].upper()} for k, c in enumerate(codes, 1)]
        (tmp_path / f"{version}.json").write_text(json.dumps({"schemaVersion": version, "singleSelect": True, "labels": labels, "mappings": mappings}, indent=1))

    put("v1", ["moth", "keyword", "bird"], {"insects": ["moth"]})
    put("v2", ["target", "moth", "bird"], {"insects": ["moth"], "targets": ["target"], "none": []})
    labels, mappings = readers.read_vocabularies(spark, f"{tmp_path}/*.json")
    assert labels.count() == 6 and sorted(map(tuple, mappings.collect())) == [("v1", "insects", "moth"), ("v2", "insects", "moth"), ("v2", "targets", "target")]
    assert [r["code"] for r in readers.label_priorities(labels, "v2").orderBy("priority").collect()] == ["target", "moth", "bird", "keyword"]
    with pytest.raises(CheckFailed):
        readers.label_priorities(labels, "v9")
    put("v3", ["a"], {"x": ["b"]})
    with pytest.raises(CheckFailed):
        readers.read_vocabularies(spark, f"{tmp_path}/*.json")
    put("v3", ["a", "ab"], {})  # one shortcut for two
    with pytest.raises(CheckFailed):
        readers.read_vocabularies(spark, f"{tmp_path}/v3.json")
