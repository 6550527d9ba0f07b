"""Queries over what is published: versions of several tables, the map, guarded updates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import candidates, map_rows, reconcile
from ..operators.rounds import ranked
from ..operators.staging import shared_folder
from ..sources import commits
from .registry import query

# --- versions ------------------------------------------------------------------------


@query("""
    SELECT CAST(2 AS BIGINT) AS version, c_custkey, o_orderkey, o_orderpriority, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE c_mktsegment END AS c_mktsegment
    FROM customer JOIN orders ON o_custkey = c_custkey
""")
def published_version(t):
    """Customers and orders published as one version, customers updated in a second one, both read back."""
    customers = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    spark = customers.sparkSession
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    commits.publish({"customers": customers, "orders": t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")}, folder)
    segment = F.when(F.col("c_acctbal") < 0, "overdrawn").otherwise(F.col("c_mktsegment"))
    now = commits.update(spark, folder, lambda v: {"customers": v.read("customers").withColumn("c_mktsegment", segment)})
    found = now.read("customers").join(now.read("orders"), F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.lit(now.number).cast("long").alias("version"), "c_custkey", "o_orderkey", "o_orderpriority", "c_mktsegment")


@query("""
    SELECT p_partkey, coalesce(count(l_orderkey) FILTER (l_returnflag = 'R'), 0) AS returned, coalesce(count(l_orderkey), 0) AS sold
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1
""")
def response_cache(t):
    """Line items as a cache of responses laid out by part; the small parts' are looked up, which reads only their buckets."""
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_returnflag")
    cache = commits.publish({"responses": lines}, f"{shared_folder(lines.sparkSession)}/cache-{uuid.uuid4().hex}", keys={"responses": "p_partkey"})
    wanted = t("part").filter("p_size <= 10").select("p_partkey")
    found = cache.lookup("responses", wanted).groupBy("p_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("l_orderkey").alias("s"))
    return wanted.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("r", F.lit(0)).cast("long").alias("returned"), F.coalesce("s", F.lit(0)).cast("long").alias("sold"))


# --- sources, reviews and responses --------------------------------------------------

ROUNDS = {"first_round": "< TIMESTAMP '1995-01-01'", "second_round": ">= TIMESTAMP '1995-01-01'"}


def _round_sql(name: str, when: str) -> str:
    of = f"FILTER (o_orderdate {when})"
    return f"""
        count(*) {of} AS {name}_review_count, count(DISTINCT o_orderstatus) {of} AS {name}_reviewer_count,
        CASE WHEN count(*) {of} > 0 THEN count(DISTINCT o_orderpriority) {of} = 1 END AS {name}_unanimous, CASE WHEN count(*) {of} > 0 THEN count(DISTINCT o_orderpriority) {of} > 1 END AS {name}_has_conflicting_reviews,
        CASE WHEN count(DISTINCT o_orderpriority) {of} = 1 THEN min(o_orderpriority) {of} END AS {name}_unanimous_result, CAST(min(o_orderdate) {of} AS VARCHAR) AS {name}_first_saved_at_utc,
        CASE WHEN count(*) {of} > 0 THEN '[{{"n": ' || count(*) {of} || '}}]' ELSE '[]' END AS {name}_reviews_json"""


@query(f"""
    WITH r AS (SELECT o_custkey, {", ".join(_round_sql(*r) for r in ROUNDS.items())} FROM orders GROUP BY 1),
    s AS (SELECT c_custkey, c_mktsegment AS source, c_name AS discovery_comments_text, r.* EXCLUDE (o_custkey), o_custkey IS NOT NULL AS has_saved_review, 'img' || o_custkey AS veritaxa_image_id,
                 c_nationkey < 8 AS known, c_acctbal / 60 AS lat, c_nationkey * 8 AS lon, c_custkey % 20 AS accuracy FROM customer LEFT JOIN r ON o_custkey = c_custkey),
    u AS (SELECT *, NOT known AND abs(lat) <= 90 AND lon <= 180 AND accuracy BETWEEN 1 AND 16 AS own FROM s)
    SELECT c_custkey, source, discovery_comments_text, has_saved_review, veritaxa_image_id, CASE WHEN known THEN 5.5 WHEN own THEN lat END AS latitude, CASE WHEN known THEN CAST(c_custkey % 90 AS DOUBLE) WHEN own THEN CAST(lon AS DOUBLE) END AS longitude,
           CAST(CASE WHEN known THEN 16 WHEN own THEN accuracy END AS INTEGER) AS accuracy, CASE WHEN known THEN 'response' WHEN own THEN 'flickr.photos.search' END AS geolocation_source,
           {", ".join(f"coalesce({n}_review_count, 0) AS {n}_review_count, coalesce({n}_reviewer_count, 0) AS {n}_reviewer_count, {n}_unanimous, {n}_has_conflicting_reviews, {n}_unanimous_result, {n}_first_saved_at_utc, coalesce({n}_reviews_json, '[]') AS {n}_reviews_json" for n in ROUNDS)}
    FROM u
""")
def joined_images(t):
    """Customers as a source, their orders as two rounds of saved reviews, some located by responses."""
    columns = [F.concat(F.lit("img"), "o_custkey").alias("image_id")]
    for name, when in ROUNDS.items():
        of = F.expr(f"o_orderdate {when}")
        n, kinds = F.count_if(of), F.count_distinct(F.when(of, F.col("o_orderpriority")))
        flag = lambda c: F.when(c, "True").otherwise("false")  # noqa: E731  saved as texts
        saved = {
            "review_count": n.cast("string"), "reviewer_count": F.count_distinct(F.when(of, F.col("o_orderstatus"))).cast("string"), "unanimous": F.when(n > 0, flag(kinds == 1)).otherwise(""),
            "has_conflicting_reviews": F.when(n > 0, flag(kinds > 1)), "unanimous_result": F.when(kinds == 1, F.min(F.when(of, F.col("o_orderpriority")))).otherwise(""), "strict_majority_result": F.lit(""),
            "first_saved_at_utc": F.min(F.when(of, F.col("o_orderdate").cast("string"))), "last_updated_at_utc": F.lit(None).cast("string"), "result_counts_json": F.lit("{}"),
            "reviews_json": F.when(n > 0, F.concat(F.lit('[{"n": '), n, F.lit(', "reviewer_email": "a@b.c"}]'))),
        }
        columns += [c.alias(f"{name}_{k}") for k, c in saved.items()]
    reviews = t("orders").groupBy("o_custkey").agg(*columns).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source")), "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    point = [(F.col("c_acctbal") / 60).alias("latitude"), (F.col("c_nationkey") * 8).alias("longitude"), (F.col("c_custkey") % 20).alias("accuracy")]
    source = t("customer").select("c_custkey", F.col("c_mktsegment").alias("source"), F.col("c_name").alias("comments_text"), *point)
    located = t("customer").filter("c_nationkey < 8").select("c_custkey", F.lit(5.5).alias("latitude"), (F.col("c_custkey") % 90).cast("double").alias("longitude"), F.lit(16).alias("accuracy"), F.lit("response").alias("geolocation_source"))
    found = reconcile.joined_images(source, reviews, located, ["source", "c_custkey"], "c_custkey")
    return found.drop(*[f"{n}_{c}" for n in ROUNDS for c in ("strict_majority_result", "last_updated_at_utc", "result_counts_json")])


# --- guarded updates -----------------------------------------------------------------


@query("""
    WITH i AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal,
                      CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey < 3 THEN '[1, 2]' WHEN c_nationkey < 9 THEN '{"a": 1.50, "geotag": {"status": "reviewed"}}'
                           WHEN c_nationkey < 15 THEN '{"geotag": {"status": "provisional", "n": 0}, "a": 1.50}' WHEN c_nationkey < 17 THEN '{"geotag": {"n": ' || c_nationkey || ', "status": "provisional"}}'
                           WHEN c_nationkey < 19 THEN '{"geotag": null}' WHEN c_nationkey < 21 THEN '{"geotag": "seen"}' ELSE '{}' END AS labels FROM customer),
    o AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 'identity' WHEN labels IS NOT NULL AND c_nationkey < 3 THEN 'no object' WHEN labels IS NOT NULL AND (c_nationkey < 9 OR c_nationkey IN (19, 20)) THEN 'settled'
                         WHEN labels IS NOT NULL AND c_nationkey IN (15, 16) THEN 'already attached' ELSE 'attached' END AS outcome FROM i)
    SELECT c_custkey, outcome, CASE WHEN outcome <> 'attached' THEN labels WHEN labels IS NOT NULL AND c_nationkey BETWEEN 9 AND 14 THEN '{"geotag":{"status":"provisional","n":' || c_nationkey || '},"a":1.50}'
                                    ELSE '{"geotag":{"status":"provisional","n":' || c_nationkey || '}}' END AS labels FROM o
    UNION ALL SELECT -1, 'gone', NULL
""")
def guarded_attachment(t):
    """Payloads laid into customers' labels unless a person has decided, or another image stands there."""
    n, text = F.col("c_nationkey"), F.lit
    labels = (
        F.when(F.col("c_acctbal") < 0, text(None)).when(n < 3, "[1, 2]").when(n < 9, '{"a": 1.50, "geotag": {"status": "reviewed"}}').when(n < 15, '{"geotag": {"status": "provisional", "n": 0}, "a": 1.50}')
        .when(n < 17, F.concat(text('{"geotag": {"n": '), n, text(', "status": "provisional"}}'))).when(n < 19, '{"geotag": null}').when(n < 21, '{"geotag": "seen"}').otherwise("{}")
    )
    table = t("customer").select("c_custkey", F.col("c_mktsegment").alias("provider"), labels.alias("labels"))
    provider = F.when(F.col("c_mktsegment") == "BUILDING", "another").otherwise(F.col("c_mktsegment"))
    payload = F.concat(text('{"status":"provisional","n":'), n, text("}"))
    plan = t("customer").select("c_custkey", provider.alias("provider"), payload.alias("payload"))
    gone = plan.limit(1).select(F.lit(-1).cast(plan.schema["c_custkey"].dataType).alias("c_custkey"), "provider", "payload")
    after, outcomes = reconcile.attach_guarded(table, plan.unionByName(gone), "c_custkey", ["provider"], "labels", "geotag", ["provisional", "unresolved", "source_reported"])
    return outcomes.join(after, "c_custkey", "left").select("c_custkey", "outcome", "labels")


@query("""
    WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"a": [1, 2]}' WHEN 2 THEN '[1' WHEN 3 THEN '["x"]' ELSE '' END AS labels,
                      CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"n": 1e3}' ELSE '7' END AS metadata, 'tag ' || page_id % 4 AS raw FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN '["' || raw || '"]' WHEN 1 THEN labels WHEN 3 THEN labels END AS labels, CASE WHEN page_id % 3 = 1 THEN metadata WHEN page_id % 3 = 2 THEN metadata END AS metadata,
           CASE WHEN page_id % 5 IN (2, 4) THEN 'labels isn''t JSON' WHEN page_id % 3 = 2 THEN 'metadata isn''t an object' END AS problem
    FROM p
""")
def candidate_json(t):
    """Labels fall back to a second column; JSON must parse, metadata must be an object."""
    of, by = F.col("page_id") % 5, F.col("page_id") % 3
    labels = F.when(of == 1, '{"a": [1, 2]}').when(of == 2, "[1").when(of == 3, '["x"]').when(of == 4, "")
    rows = t("pages").select("page_id", labels.alias("labels"), F.concat(F.lit('["tag '), F.col("page_id") % 4, F.lit('"]')).alias("fallback"), F.when(by == 1, '{"n": 1e3}').when(by == 2, "7").alias("metadata"), F.lit(None).cast("string").alias("problem"))
    return candidates.parsed_json(candidates.parsed_json(rows, "labels", "fallback"), "metadata", object_=True).select("page_id", "labels", "metadata", "problem")


# --- the map -------------------------------------------------------------------------

IMAGES_SQL = """
    last AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS taken FROM orders GROUP BY 1),
    images AS (SELECT c_custkey, CASE WHEN c_custkey % 97 = 5 THEN 'twice' ELSE substr(sha256(c_mktsegment || chr(10) || c_custkey), 1, 32) END AS key,
                      c_custkey * 7919 % 1900 / 10.0 - 95 AS latitude, c_custkey * 104729 % 3400 / 10.0 - 170 AS longitude,
                      CASE WHEN c_custkey % 89 = 3 THEN 'two' || chr(10) || 'lines' WHEN c_custkey % 9 = 0 THEN ' =' || c_name WHEN c_custkey % 9 = 1 THEN NULL ELSE c_name END AS label,
                      CASE WHEN c_custkey % 83 = 1 THEN 'http' ELSE 'https' END || '://img.example/' || c_custkey AS image_url, CASE c_custkey % 4 WHEN 0 THEN 'https://img.example/full/' || c_custkey WHEN 1 THEN '' END AS fallback_url,
                      CASE WHEN c_custkey % 79 = 2 THEN ' ' ELSE '' END || CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Set ' || c_nationkey ELSE 'Other' END AS dataset_label,
                      CASE c_custkey % 3 WHEN 0 THEN taken WHEN 1 THEN CAST(date_trunc('month', taken) AS DATE) ELSE CAST(date_trunc('year', taken) AS DATE) END AS day,
                      left(CAST(taken AS VARCHAR), CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 4 END) AS date
               FROM customer LEFT JOIN last ON o_custkey = c_custkey),
    judged AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN 'a key that repeats' WHEN abs(latitude) > 86 OR (latitude = 0 AND longitude = 0) THEN 'no usable coordinates'
                              WHEN c_custkey % 89 = 3 THEN 'a bad label' WHEN c_custkey % 83 = 1 THEN 'a bad image address' WHEN c_custkey % 79 = 2 THEN 'a bad data set' END AS problem FROM images)
"""


def _images(t) -> DataFrame:
    """Customers as images: their last order is the capture, as exact as their number says."""
    k, at = F.col("c_custkey"), t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("taken"))
    key = F.when(k % 97 == 5, "twice").otherwise(map_rows.image_key(F.col("c_mktsegment"), k.cast("string")))
    label = F.when(k % 89 == 3, "two\nlines").when(k % 9 == 0, F.concat(F.lit(" ="), "c_name")).when(k % 9 != 1, F.col("c_name"))
    full = F.when(k % 4 == 0, F.concat(F.lit("https://img.example/full/"), k)).when(k % 4 == 1, "")
    of = F.when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("Set "), "c_nationkey")).when(F.col("c_nationkey") % 3 == 2, "Other").otherwise("")
    seen = dates.photo_date(F.col("taken"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 4).otherwise(6), F.lit(False), F.lit(None).cast("string"), F.current_date())
    rows = t("customer").join(at, "c_custkey", "left").withColumn("seen", seen)
    return rows.select(
        k, key.alias("key"), (k * 7919 % 1900 / 10.0 - 95).alias("latitude"), (k * 104729 % 3400 / 10.0 - 170).alias("longitude"), label.alias("label"),
        F.concat(F.when(k % 83 == 1, "http").otherwise("https"), F.lit("://img.example/"), k).alias("image_url"), full.alias("fallback_url"),
        F.concat(F.when(k % 79 == 2, " ").otherwise(""), of).alias("dataset_label"), F.col("seen.day").alias("day"), F.col("seen.text").alias("date"),
    )


@query(f"WITH {IMAGES_SQL} SELECT c_custkey, key, day, date, problem FROM judged")
def map_record_rules(t):
    return map_rows.problems(_images(t)).select("c_custkey", "key", "day", "date", "problem")


def _shown(t) -> DataFrame:
    return map_rows.problems(_images(t)).filter("problem IS NULL").drop("problem")


#: The equal-area cylinder of the map and its inverse by series, in SQL.
CELLS_SQL = """
    e AS (SELECT sqrt(f * (2 - f)) AS e, 6378137.0 AS a FROM (SELECT 1 / 298.257223563 AS f)),
    c AS (SELECT e, a, cos(radians(30)) / sqrt(1 - e * e * sin(radians(30)) ^ 2) AS k, (1 - e * e) * (1 / (1 - e * e) - 1 / (2 * e) * ln((1 - e) / (1 + e))) AS qp FROM e),
    cells AS (SELECT shown.*, e, a, k, qp, floor(a * k * radians(longitude) / 10000) AS ix,
                     floor(a / (2 * k) * (1 - e * e) * (sin(radians(latitude)) / (1 - (e * sin(radians(latitude))) ^ 2) - 1 / (2 * e) * ln((1 - e * sin(radians(latitude))) / (1 + e * sin(radians(latitude))))) / 10000) AS iy FROM shown, c),
    b AS (SELECT *, asin((iy + 0.5) * 10000 * 2 * k / (a * qp)) AS b, degrees((ix + 0.5) * 10000 / (a * k)) AS lon FROM cells),
    centres AS (SELECT *, degrees(b + (e ^ 2 / 3 + 31 * e ^ 4 / 180 + 517 * e ^ 6 / 5040) * sin(2 * b) + (23 * e ^ 4 / 360 + 251 * e ^ 6 / 3780) * sin(4 * b) + 761 * e ^ 6 / 45360 * sin(6 * b)) AS lat FROM b)
"""


@query(f"""
    WITH {IMAGES_SQL}, shown AS (SELECT * FROM judged WHERE problem IS NULL AND (day IS NULL OR year(day) BETWEEN 1999 AND 2001)), {CELLS_SQL}
    SELECT row_number() OVER (ORDER BY key) AS place, coalesce(nullif(fallback_url, ''), image_url) AS image_url, coalesce(date, '') AS date, printf('%.6f, %.6f', lat, lon) AS geotag,
           CASE WHEN c_custkey % 9 = 0 THEN '''' ELSE '' END || coalesce(label, '') AS label
    FROM centres
""")
def map_selection(t):
    """All images that the years leave visible, asked for in the order of keys."""
    shown = _shown(t)
    wanted = shown.filter(dates.in_years(F.col("day"), 1999, 2001)).select("key")
    return map_rows.selected(shown, ranked(wanted, [], ["key"], "place"), (1999, 2001))


@query(f"WITH {IMAGES_SQL}, shown AS (SELECT * FROM judged WHERE problem IS NULL), {CELLS_SQL} SELECT key, CAST(ix AS BIGINT) || ':' || CAST(iy AS BIGINT) AS cell, label, nullif(dataset_label, '') AS dataset FROM centres")
def map_catalog(t):
    """An index of the map for selecting, without addresses or exact coordinates."""
    return map_rows.placed(_shown(t)).select("key", "cell", "label", F.when(F.col("dataset_label") != "", F.col("dataset_label")).alias("dataset"))


@query(f"""
    WITH {IMAGES_SQL} SELECT place, name FROM (VALUES (0, 'Papilio demoleus'), (1, 'Papilio demodocus'), (2, 'Other')) f(place, name)
    UNION ALL SELECT DISTINCT 3, dataset_label FROM judged WHERE problem IS NULL AND dataset_label NOT IN ('', 'Other')
""")
def map_groups(t):
    return map_rows.groups(_shown(t))
