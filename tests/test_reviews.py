"""Plans, exports, workbooks and archives on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftstone.operators import archive, candidates, checks, clue_tables, cursor, exports, hygiene, publications, round_plans, rounds, workbook
from siftstone.plans import reviews
from siftstone.plans.registry import ORACLES, QUERIES

from .conftest import DATA


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def model(spark):
    return reviews.model(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"))


def test_exports_are_in_order_and_complete(spark, model, tmp_path):
    raw = exports.raw_export(**model, schema_version="v")
    assert raw.columns == exports.RAW_COLUMNS and len(raw.columns) == 20
    batch = {r["batch_code"]: (r["position"], r["id"]) for r in model["batches"].collect()}
    raw.coalesce(1).write.parquet(f"{tmp_path}/raw")
    places = [batch[r["batch_code"]][0] for r in spark.read.parquet(f"{tmp_path}/raw").collect()]
    assert places == sorted(places) and len(places) == model["reviews"].count()
    found = exports.consensus_export(**model, schema_version="v")
    assert found.columns == exports.CONSENSUS_COLUMNS and len(found.columns) == 17
    keys = [(r["campaign_code"].encode(), r["batch_code"].encode(), r["image_id"].encode()) for r in found.collect()]
    assert keys == sorted(keys)
    lean = exports.consensus_export(**model, schema_version="v", lean=True, derived=True)
    assert not set(exports.BULKY) & set(lean.columns) and len(lean.columns) == 15 + 9


def test_ranks_within_parts(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") * F.col("id")).alias("x"), "id")
    got = rounds.ranked(df, ["g"], ["x", "id"], "n").collect()
    for g in range(7):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"] is not None, r["x"] or 0, r["id"]))
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))
    words = spark.createDataFrame([(w,) for w in ("b", "ab", "aab", "", "aaa", "aaab")] + [(None,)], "w string")
    assert [r["w"] for r in rounds.ranked(words, [], ["w"], "n").orderBy("n").collect()] == [None, "", "aaa", "aaab", "aab", "ab", "b"]
    assert rounds.ranked(words.limit(0), [], ["w"], "n").count() == 0


def test_refresh_settles(spark, model):
    kept, batches = round_plans.refreshed(model["items"], model["batches"], model["reviews"].filter("reviewer_id = 'rev1'"))
    again = kept.drop("position").join(model["items"].drop("batch_id", "position"), "id").join(kept.select("id", "position"), "id")
    twice, after = round_plans.refreshed(again, batches, model["reviews"].filter("reviewer_id = 'rev1'"))
    assert values(twice, "id", "batch_id", "position") == values(kept, "id", "batch_id", "position")
    assert values(after, "id", "status") == values(batches, "id", "status")


def test_latest_groups_stop_at_old_labels(spark):
    at = lambda d: f"1995-05-{d:02} 00:00:00"
    items = spark.createDataFrame([(1, "p", "a", "T", "1995-01-01 00:00:00"), (2, "p", "b", "T", "1995-01-01 00:00:00"), (3, "p", "c", "T", "1995-06-01 00:00:00")], "id int, source_provider string, image_id string, target_scientific_name string, created_at string")
    items = items.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    rows = [(1, 1, "moth", None, at(1)), (2, 1, "bird", None, at(2)), (3, 1, "plant", None, at(2)), (4, 2, "moth", None, "1990-01-01 00:00:00"), (5, 3, "moth", None, at(3))]
    votes = spark.createDataFrame(rows, "id int, item_id int, label string, scientificName string, t string").select("id", "item_id", "label", "scientificName", F.col("t").cast("timestamp_ntz").alias("created_at"), F.col("t").cast("timestamp_ntz").alias("updated_at"))
    got = round_plans.latest_groups(items, votes, "1995-01-01", "1996-01-01", F.col("label"))
    assert values(got, "image_id", "review_id", "answer") == [("a", 3, "plant")]  # equal times: the greater identifier; b is too old, c older than its item
    old = votes.withColumn("label", F.lit(round_plans.KEYWORD))
    with pytest.raises(checks.CheckFailed, match="old versions"):
        round_plans.latest_groups(items, old, "1995-01-01", "1996-01-01", F.col("label"))


def test_predictions_need_sound_answers(spark):
    def json(name, cosine, model="m", best="top5"):
        return f'{{"bioclip": {{"{best}": [{{"scientific_name": {name}, "cosine": {cosine}}}], "attestation": {{"model": "{model}"}}}}}}'

    rows = [(1, json('"A b"', "0.5")), (2, json('" A"', "0.5")), (3, json('"A"', "1.5")), (4, json('"A"', '"x"')), (5, json('"A"', "0.1", "n")), (6, json('"A"', '"-1"', best="top10")), (7, "junk"), (8, None), (9, json('""', "0"))]
    got = cursor.predictions(spark.createDataFrame(rows, "i int, j string"), "i", "j", "m")
    assert values(got, "i", "name", "cosine") == [(1, "A b", 0.5), (6, "A", -1.0)]
    limits = spark.createDataFrame([(None,), (-3,), (1,), (2,), (9,)], "n int")
    assert [r[0] for r in limits.select(cursor.queue_limit(F.col("n"))).collect()] == [2, 1, 1, 2, 2]


def test_sheet_names():
    long = "Long name of a sheet that goes on for ever"
    got = workbook.sheet_names(["a/b", "A?B", "a:b", long, long + "!", "''", ""])
    assert len({n.casefold() for n in got.values()}) == 7 and all(0 < len(n) <= 31 for n in got.values())
    assert got["a/b"] == "a b" and got["A?B"] == "A B (2)" and got[long + "!"].endswith(" (2)")


def test_workbook_rows(spark):
    rows = spark.createDataFrame([(1, "😀" * 4 + "xyz", "done"), (2, None, None), (3, "", "")], "k int, t string, label string")
    got = workbook.continued(rows, ["t"], 4)
    assert got.columns == ["k", "t", "label", "t__part_2", "t__part_3"]
    assert values(got, "t", "t__part_2", "t__part_3") == sorted([("😀😀", "😀😀", "xyz"), (None, None, None), ("", None, None)], key=repr)
    assert values(workbook.review_sheets(rows, "label"), "k", "sheet") == sorted([(1, "All"), (1, "Classified"), (2, "All"), (2, "Non-classified"), (3, "All"), (3, "Non-classified")], key=repr)
    images = spark.createDataFrame([(1, "none", None, []), (2, "profile_only", None, []), (3, "none", 1.0, []), (4, "day_neighbour", None, []), (5, "none", None, ["x"])], "k int, status string, lat double, named array<string>")
    assert values(workbook.location_sheets(images, "status", ["lat", "named"], "k"), "k", "sheet") == [(1, "none"), (2, "profile_only"), (3, "priority"), (4, "other"), (5, "priority")]
    with pytest.raises(Exception, match="unknown status"):
        workbook.location_sheets(images.withColumn("status", F.lit("odd")), "status", ["lat"], "k").collect()


def test_archive_and_frozen_inputs(spark, tmp_path):
    rows = spark.createDataFrame([(k, f'{{"n": {k}, "origin": "web"}}' if k % 4 else None) for k in range(1, 50)], "id long, meta string")
    kept = archive.shards(rows.filter("meta IS NOT NULL"), "id", "meta", 10)
    assert {r["records"] for r in archive.manifest(kept, "id").collect()} == {10, 7}
    small = archive.swapped(rows, kept, "id", "meta", "origin")
    assert small.filter("id = 1").first()["meta"] == '{"archive_record":"1","origin":"web"}'
    assert values(archive.restored(small, kept, "id", "meta"), "id", "meta") == values(rows, "id", "meta")
    with pytest.raises(checks.CheckFailed):
        archive.swapped(rows.withColumn("meta", F.lit("{}")), kept, "id", "meta", "origin")
    with pytest.raises(checks.CheckFailed):
        archive.restored(small, kept.filter("id > 3"), "id", "meta")
    archive.require_archive(kept, "id", archive.manifest(kept, "id"))
    with pytest.raises(checks.CheckFailed):
        archive.require_archive(kept.filter("id <> 5"), "id", archive.manifest(kept, "id"))
    path = f"file://{tmp_path}/frozen"
    first = archive.frozen(rows, path)
    assert values(archive.frozen(rows.limit(1), path), "id", "meta") == values(first, "id", "meta") == values(rows, "id", "meta")
    rows.limit(3).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(checks.CheckFailed, match="changed"):
        archive.frozen(rows, path)


def test_row_hygiene(spark):
    a = spark.createDataFrame([(1, "x", None)], "k int, lat string, old string")
    assert hygiene.without_placeholders(a, ["old"], "found_", ["lat"]).columns == ["k", "found_lat"]
    b = spark.createDataFrame([(1, "n", "y", "z")], "k int, clue string, lat string, latitude string")
    assert hygiene.with_new_columns(a, b, ["k"], {"latitude": "lat"}).columns == ["k", "lat", "old", "clue"]


def test_subsets_and_unknown_clues(spark):
    near = spark.createDataFrame([("a", clue_tables.HOUR, "earlier"), ("a", clue_tables.HOUR, "later"), ("b", clue_tables.DAY, "earlier")], "id string, time_window string, relation string")
    photos = spark.createDataFrame([("a", 0), ("c", 1)], "id string, p int")
    assert values(clue_tables.neighbour_subsets(photos, near, "id", F.col("p") > 0), "id", "subset") == [("a", "hour_after"), ("a", "hour_before"), ("c", "priority")]
    with pytest.raises(Exception, match="unknown clue"):
        clue_tables.clue_payload(spark.createDataFrame([("a", "odd", "v", 1)], "id string, k string, v string, at int"), "id", "k", "v", "at").collect()


def test_ranks_with_outliers_and_constants(spark):
    rows = [(k % 2 == 0, 0, float(k) if k else 1e300, f"same beginning {k:05d}", k) for k in range(2000)] + [(None, 0, None, None, 5000)]
    df = spark.createDataFrame(rows, "b boolean, c int, x double, s string, id int")
    for order in (["b", "id"], ["c", "x", "id"], ["s"], ["c", "s"], ["c"]):
        got = {r["id"]: r["n"] for r in rounds.ranked(df, [], order, "n").collect()}
        assert sorted(got.values()) == list(range(1, len(rows) + 1))
        if order != ["c"]:
            key = lambda r, o=order: [(r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in o]
            assert [got[r["id"]] for r in sorted(df.collect(), key=key)] == list(range(1, len(rows) + 1))
    parts = df.repartitionByRange(8, "c", "x").groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) < 600  # a constant first column and an outlier still give even ranges
    inside = {(r["b"], r["id"]): r["n"] for r in rounds.ranked(df, ["b"], ["id"], "n").collect()}
    assert inside[None, 5000] == 1 and inside[True, 0] == 1 and inside[False, 1999] == 1000


def test_rolling_budget_against_brute_force(spark):
    import random

    rng = random.Random(3)
    at = sorted(rng.randrange(0, 4000 * 60) / 10 for _ in range(600)) + [100.0] * 5
    rows = [(k, "one", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for k, s in enumerate(at)] + [(-1, "other", dt.datetime(2024, 1, 1)), (-2, "one", None)]
    got = {r["id"]: (r["in_window"], r["over_budget"]) for r in archive.rolling_calls(spark.createDataFrame(rows, "id int, k string, at timestamp"), "at", "k", 3600, 50).collect()}
    for i, k, t in rows:
        n = None if t is None else sum(k == o and u is not None and dt.timedelta(0) <= t - u < dt.timedelta(seconds=3600) for _, o, u in rows)
        assert got[i] == (n, None if n is None else n > 50)


def test_chunks_over_many_blocks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    monkeypatch.setattr(candidates, "BLOCK_ROWS", 16)
    monkeypatch.setattr(candidates, "BLOCK_CHUNKS", 2)
    rows = [(g, k, rng.choice([0, 1, 3, 9, 40])) for g, n in (("a", 500), ("b", 1), ("c", 33), (None, 40)) for k in range(n)]
    for most_bytes, most_rows in ((10, 7), (1, 3), (10_000, 8), (30, 1)):
        got = {(r["g"], r["i"]): r["chunk"] for r in candidates.byte_chunks(spark.createDataFrame(rows, "g string, i int, s int"), "g", ["i"], "s", most_bytes, most_rows).collect()}
        for g in ("a", "b", "c", None):
            chunk, held, count = 0, 0, 0
            for o, i, s in rows:
                if o != g:
                    continue
                if not count or held + s > most_bytes or count == most_rows:
                    chunk, held, count = chunk + 1, 0, 0
                held, count = held + s, count + 1
                assert got[g, i] == chunk


def test_archives_by_bytes_with_overrides(spark):
    from siftstone.functions import text

    rows = spark.createDataFrame([(k, '{"a": %d.50, "geotag": {"x": 1.0}, "b": "%s"}' % (k, "x" * 40 * k)) for k in range(12)], "id int, meta string")
    kept = archive.shards(rows, "id", "meta", 5, 1000)
    sizes = {}
    for r in kept.collect():
        sizes.setdefault(r["shard"], []).append(len(r["metadata_json"]))
    assert all(len(s) <= 5 and (sum(s) <= 1000 or len(s) == 1) for s in sizes.values()) and len(sizes) > 3
    small = archive.swapped(rows, kept, "id", "meta", "geotag")
    assert small.filter("id = 3").first()["meta"] == '{"archive_record":"3","geotag":{"x": 1.0}}'
    assert values(archive.restored(small, kept, "id", "meta"), "id", "meta") == values(rows, "id", "meta")
    later = small.withColumn("meta", text.json_overlay("meta", F.lit('{"geotag": {"x": 2.00}, "new": [1.0]}')))
    assert archive.restored(later, kept, "id", "meta").filter("id = 3").first()["meta"] == '{"a":3.50,"geotag":{"x": 2.00},"b":"%s","new":[1.0]}' % ("x" * 120)
    with pytest.raises(checks.CheckFailed):
        archive.restored(small.withColumn("meta", F.lit('{"archive_record": "1"')), kept, "id", "meta")
    told = archive.manifest(kept, "id")
    assert values(archive.fetched(kept, told, "id", rows.filter("id IN (2, 9)")), "id") == [(2,), (9,)]
    with pytest.raises(checks.CheckFailed):
        archive.fetched(kept.withColumn("metadata_md5", F.lit("x")), told, "id", rows.filter("id = 2"))
    with pytest.raises(checks.CheckFailed):
        archive.fetched(kept, told, "id", spark.createDataFrame([(77,)], "id int"))


def test_archives_are_cut_and_swapped_once(spark):
    """What reads an archive or a swapped table doesn't make it again, and restoring takes one step in Python."""
    table = spark.createDataFrame([(1, '{"a": 1, "provenance": {"p": 2}}'), (2, "{}"), (3, '{"a": 1.50}'), (4, None)], "id bigint, m string")
    kept = archive.shards(table.filter("id <> 3 AND m IS NOT NULL"), "id", "m", 2)
    small = archive.swapped(table, kept, "id", "m", "provenance")
    back = archive.restored(small.withColumn("m", F.when(F.col("id") == 1, F.regexp_replace("m", r"\}$", ',"late":1.0}')).otherwise(F.col("m"))), kept, "id", "m")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (kept, small, back)]
    assert "InPandas" not in "".join(plans) and [p.count("ArrowEvalPython") for p in plans] == [0, 1, 1]
    assert {r["id"]: r["m"] for r in back.collect()} == {1: '{"a":1,"provenance":{"p": 2},"late":1.0}', 2: "{}", 3: '{"a": 1.50}', 4: None}


def counted(spark):
    """A column as it is, and how many rows it has been worked out for."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return F.udf(same, "string").asNondeterministic(), seen


def test_second_round_is_made_once(spark):
    """Votes are read once, members are stamped once, and the proof reads what is published."""
    m = reviews._published_model(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"))
    votes = m["reviews"].localCheckpoint()
    label, seen = counted(spark)
    after = publications.rereview(**m | {"reviews": votes.withColumn("label", label("label"))}, code="R1", at="2024-01-01T00:00:00Z")
    assert "ArrowEvalPython" not in after.items._jdf.queryExecution().optimizedPlan().toString()
    assert seen.value == votes.count()
    last = m["items"].agg(F.max("id")).first()[0]
    new = after.items.filter(F.col("id") > last)
    order = [(r["id"], (r["batch_id"], r["position"])) for r in new.select("id", "batch_id", "position").orderBy("id").collect()]
    assert [k for k, _ in order] == list(range(last + 1, last + 1 + len(order))) and order == sorted(order, key=lambda r: r[1])


def test_kept_rows_are_told_from_lost_and_changed_ones(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, x string")
    before = rows((1, "a"), (2, None), (3, "c"), (3, "c"), (4, "d"), (5, "e"))
    after = rows((5, "e"), (5, "e"), (4, "D"), (3, "c"), (2, None), (1, "a"), (9, "new"), (9, "newer"))
    assert values(checks.lost_or_changed(before, after, ["id"], ["x"]), "id") == [(3,), (4,), (5,)]
    assert values(checks.lost_or_changed(before, rows((1, "a")), ["id"], ["x"]), "id") == [(2,), (3,), (4,), (5,)]
    assert not values(checks.lost_or_changed(before, before.unionByName(rows((9, "x"))), ["id"], ["x"]), "id")


def test_one_member_laid_over(spark):
    from siftstone.functions import text

    rows = spark.createDataFrame([("{}",), ('{"a": 1.50, "k": null}',), ('{"k":{"b": 2.0}}',), ("[1]",), ("x",), (None,)], "m string")
    value = '{"b": 2.0}'
    got = rows.select(text.json_with("m", F.lit("k"), F.lit(value)), text.json_overlay("m", F.lit('{"k":%s}' % value))).collect()
    assert all(a == b for a, b in got) and [a for a, _ in got][:3] == ['{"k":{"b": 2.0}}', '{"a":1.50,"k":{"b": 2.0}}', '{"k":{"b": 2.0}}']


def test_latest_grouping_takes_members_once(spark):
    """A grouping and what is appended to it: each reads its members for the check of their answers, and to keep the new ones."""
    m = reviews._published_model(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet"))
    del m["reviews"]
    kinds = F.element_at(F.array(*[F.lit(g) for g in publications.GROUPS]), (F.col("id") % 3 + 1).cast("int"))
    members = m["items"].dropDuplicates(["source_provider", "image_id"]).select("source_provider", "image_id", F.col("id").alias("item_id"), F.col("id").alias("review_id"), kinds.alias("answer")).localCheckpoint()
    how = {"code": "L9", "target": "Species 1", "rule": {"by": "updated"}, "at": "2024-01-01T00:00:00Z"}
    answer, seen = counted(spark)
    first = publications.latest_grouping(**m, members=members.filter("item_id % 2 = 0").withColumn("answer", answer("answer")), **how)
    half = members.filter("item_id % 2 = 0").count()
    assert seen.value <= 2 * half
    answer, seen = counted(spark)
    after = publications.latest_grouping(*first, members=members.withColumn("answer", answer("answer")), append=True, **how)
    assert seen.value <= 2 * members.count()
    assert "ArrowEvalPython" not in after.items._jdf.queryExecution().optimizedPlan().toString()
    assert after.items.count() == m["items"].count() + members.count() and values(first.items, "id", "position") == values(after.items.join(first.items.select("id"), "id", "left_semi"), "id", "position")


def test_latest_members_in_the_order_of_their_file(spark, tmp_path):
    """Of reviews alike in time and position the first in the file counts, as in one thread of DuckDB, and one without a time is later than any."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("region", "nation", "customer"):
        pq.write_table(pq.read_table(f"{DATA}/{name}.parquet"), tmp_path / f"{name}.parquet")
    orders = pq.read_table(f"{DATA}/orders.parquet").slice(0, 0)
    day, late = dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)
    made = [(300, 1, late, "4-x"), (100, 1, late, "1-x"), (200, 1, late, "2-x"), (7, 1, day, "3-x"), (104, 2, late, "5-x"), (504, 2, None, "1-x"), (700, 3, day, "1-x"), (900, 3, day, "2-x")]
    rows = [{"o_orderkey": k, "o_custkey": c, "o_orderstatus": "O", "o_totalprice": 1.0, "o_orderdate": at, "o_orderpriority": p} for k, c, at, p in made]
    pq.write_table(pa.Table.from_pylist(rows, orders.schema), tmp_path / "orders.parquet")
    con = duckdb.connect(config={"threads": 1})
    for f in tmp_path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = sorted(con.sql(ORACLES["latest_members"]).fetchall())
    assert len(want) == 3 and sorted(tuple(r) for r in QUERIES["latest_members"](spark, str(tmp_path)).collect()) == want
