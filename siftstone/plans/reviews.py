"""Queries end to end over a review model that the standard tables are turned into.

Regions are campaigns, nations batches, customers items and orders reviews; events are
photos of an owner.  ``MODEL`` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import archive, candidates, checks, clue_tables, clues, cursor, exports, hygiene, publications, round_plans, rounds, workbook
from ..sources import readers
from .registry import long, query

SCHEMA = "review-label-v6"
MODEL_NAME = "model-1"
SQL_LABELS = "[" + ", ".join(f"'{x}'" for x in exports.LABELS) + "]"

MODEL = f"""
    campaigns AS (SELECT r_regionkey AS id, 'C-' || r_name AS campaign_code, CASE WHEN r_regionkey < 3 THEN 'Species ' || r_regionkey END AS target_scientific_name FROM region),
    batches AS (SELECT n_nationkey AS id, n_regionkey AS campaign_id, 'B-' || n_name AS batch_code, n_nationkey // 5 + 1 AS position, CASE WHEN n_nationkey % 6 = 5 THEN 'closed' ELSE 'open' END AS status FROM nation),
    items AS (
        SELECT c_custkey AS id, c_nationkey AS batch_id, 2 * c_custkey AS position, 'img' || (c_custkey // 2) AS image_id, lower(c_mktsegment) AS source_provider,
               CASE WHEN c_custkey % 3 = 0 THEN 'rec' || (c_custkey // 4) WHEN c_custkey % 3 = 1 THEN '' END AS source_record_id, 'https://img.example/' || c_custkey AS image_url,
               CASE WHEN c_custkey % 2 = 0 THEN 'https://img.example/p/' || c_custkey END AS display_url, CASE WHEN c_custkey % 4 = 0 THEN 'term "' || (c_custkey % 9) || '"' END AS flickr_search_term,
               '["' || c_mktsegment || '"]' AS source_labels,
               CASE c_custkey % 6
                   WHEN 0 THEN '{{"latitude":' || (c_custkey % 80) || ',"longitude":' || (c_nationkey + 1) || '}}'
                   WHEN 1 THEN '{{"latitude":"' || (c_custkey % 80) || '.5","longitude":"-' || (c_nationkey + 1) || '","rereview":null}}'
                   WHEN 2 THEN '{{"latitude":0,"longitude":0}}'
                   WHEN 3 THEN '{{"rereview":{{"n":1}},"bioclip":{{"top5":[{{"scientific_name":"Species ' || (c_custkey % 4) || '","cosine":0.25}}],"attestation":{{"model":"model-1"}}}}}}'
                   WHEN 4 THEN '{{"bioclip":{{"top10":[{{"scientific_name":"Species ' || (c_custkey % 4) || '","cosine":"' || (c_custkey % 3) || '.5"}}],"attestation":{{"model":"model-1"}}}}}}'
                   ELSE '{{"latitude":"north","longitude":5}}' END AS pipeline_metadata,
               CASE WHEN n_regionkey < 3 THEN 'Species ' || n_regionkey END AS target_scientific_name, TIMESTAMP '1992-06-01' + to_days(CAST(c_custkey % 100 AS INTEGER)) AS created_at
        FROM customer JOIN nation ON n_nationkey = c_nationkey),
    voted AS (SELECT *, {SQL_LABELS}[(o_orderkey * 7 + CAST(left(o_orderpriority, 1) AS INTEGER)) % 20 + 1] AS label FROM orders),
    reviews AS (
        SELECT o_orderkey AS id, o_custkey AS item_id, 'rev' || (o_orderkey % 7) AS reviewer_id, label, CASE WHEN label IN ('target_scientific_name', 'model_scientific_name') THEN 'Species ' || (o_orderkey % 3) END AS "scientificName",
               CASE WHEN label = 'flickr_keyword_match' THEN 'word ' || (o_orderkey % 4) END AS "flickrKeyword", CASE WHEN o_orderkey % 5 = 0 THEN 'note, ' || o_orderkey END AS comment, 'name ' || (o_orderkey % 7) AS "identifiedBy",
               '1.' || (o_orderkey % 4) AS client_version, o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) AS updated_at
        FROM voted)
"""


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Where a row stands in its input.
READ = {"file": "_metadata.file_path", "row": "_metadata.row_index"}


def model(t, further: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The review model's tables; ``further`` names columns of the orders that reviews keep."""
    further = further or {}
    region = F.col("n_regionkey")
    campaigns = t("region").select(F.col("r_regionkey").alias("id"), _text("C-", F.col("r_name")).alias("campaign_code"), F.when(F.col("r_regionkey") < 3, _text("Species ", F.col("r_regionkey"))).alias("target_scientific_name"))
    key = F.col("n_nationkey")
    batches = t("nation").select(key.alias("id"), region.alias("campaign_id"), _text("B-", F.col("n_name")).alias("batch_code"), (F.floor(key / 5) + 1).alias("position"), F.when(key % 6 == 5, "closed").otherwise("open").alias("status"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    of = k % 6
    metadata = (
        F.when(of == 0, _text('{"latitude":', k % 80, ',"longitude":', n + 1, "}"))
        .when(of == 1, _text('{"latitude":"', k % 80, '.5","longitude":"-', n + 1, '","rereview":null}'))
        .when(of == 2, F.lit('{"latitude":0,"longitude":0}'))
        .when(of == 3, _text('{"rereview":{"n":1},"bioclip":{"top5":[{"scientific_name":"Species ', k % 4, '","cosine":0.25}],"attestation":{"model":"model-1"}}}'))
        .when(of == 4, _text('{"bioclip":{"top10":[{"scientific_name":"Species ', k % 4, '","cosine":"', k % 3, '.5"}],"attestation":{"model":"model-1"}}}'))
        .otherwise(F.lit('{"latitude":"north","longitude":5}'))
    )
    items = t("customer").join(t("nation").select(key, region), n == key).select(
        k.alias("id"), n.alias("batch_id"), (2 * k).alias("position"), _text("img", F.floor(k / 2)).alias("image_id"), F.lower("c_mktsegment").alias("source_provider"),
        F.when(k % 3 == 0, _text("rec", F.floor(k / 4))).when(k % 3 == 1, "").alias("source_record_id"), _text("https://img.example/", k).alias("image_url"),
        F.when(k % 2 == 0, _text("https://img.example/p/", k)).alias("display_url"), F.when(k % 4 == 0, _text('term "', k % 9, '"')).alias("flickr_search_term"),
        _text('["', F.col("c_mktsegment"), '"]').alias("source_labels"), metadata.alias("pipeline_metadata"), F.when(region < 3, _text("Species ", region)).alias("target_scientific_name"),
        (F.lit("1992-06-01").cast("timestamp_ntz") + _days(k % 100)).alias("created_at"),
    )
    o = F.col("o_orderkey")
    label = F.element_at(F.array(*[F.lit(x) for x in exports.LABELS]), ((o * 7 + F.substring("o_orderpriority", 1, 1).cast("int")) % 20 + 1).cast("int"))
    reviews = t("orders").select("*", label.alias("label"), *[F.col(c).alias(name) for name, c in further.items()]).select(
        o.alias("id"), F.col("o_custkey").alias("item_id"), _text("rev", o % 7).alias("reviewer_id"), "label", F.when(F.col("label").isin(round_plans.TARGET, "model_scientific_name"), _text("Species ", o % 3)).alias("scientificName"),
        F.when(F.col("label") == round_plans.KEYWORD, _text("word ", o % 4)).alias("flickrKeyword"), F.when(o % 5 == 0, _text("note, ", o)).alias("comment"), _text("name ", o % 7).alias("identifiedBy"),
        _text("1.", o % 4).alias("client_version"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + _days(o % 4)).alias("updated_at"), *further,
    )
    return {"campaigns": campaigns, "batches": batches, "items": items, "reviews": reviews}


# --- exports -------------------------------------------------------------------------

ITEM_JOINS = "JOIN batches b ON b.id = i.batch_id JOIN campaigns c ON c.id = b.campaign_id"


@query(f"""
    WITH {MODEL}
    SELECT c.campaign_code, c.target_scientific_name, b.batch_code, i.image_id, i.source_provider, i.source_record_id, i.image_url, i.display_url, i.flickr_search_term, r."flickrKeyword", r."scientificName",
           i.source_labels, i.pipeline_metadata, r.label AS human_label, r.comment, r.reviewer_id AS reviewer_uuid, r."identifiedBy", r.updated_at AS reviewed_at, '{SCHEMA}' AS schema_version, r.client_version
    FROM reviews r JOIN items i ON i.id = r.item_id {ITEM_JOINS} ORDER BY b.position, i.position, r.created_at, r.id
""")
def raw_export_full(t):
    """All 20 columns, in order."""
    return exports.raw_export(**model(t), schema_version=SCHEMA)


@query(f"""
    WITH {MODEL}
    SELECT c.campaign_code, c.target_scientific_name, b.batch_code, i.image_id, i.source_provider, i.source_record_id, i.image_url, i.display_url, i.flickr_search_term, r."flickrKeyword", r."scientificName",
           r.label AS human_label, r.comment, r.reviewer_id AS reviewer_uuid, r."identifiedBy", r.updated_at AS reviewed_at, '{SCHEMA}' AS schema_version, r.client_version,
           {", ".join(f"r.label IN ({', '.join(repr(x) for x in labels)}) AS {name}" for name, labels in exports.DERIVED.items())}
    FROM reviews r JOIN items i ON i.id = r.item_id {ITEM_JOINS} WHERE c.campaign_code = 'C-ASIA' ORDER BY b.position, i.position, r.created_at, r.id
""")
def raw_export_of_campaign(t):
    """One campaign, without the bulky columns, with derived flags."""
    return exports.raw_export(**model(t), schema_version=SCHEMA, campaign="C-ASIA", lean=True, derived=True)


CONSENSUS = f"""
    votes AS (SELECT item_id, label, count(*) AS n, max(updated_at) AS seen FROM reviews GROUP BY ALL),
    most AS (SELECT *, max(n) OVER (PARTITION BY item_id) AS mx FROM votes),
    consensus AS (SELECT item_id, arg_min(label, list_position({SQL_LABELS}, label)) FILTER (n = mx) AS label, CAST(sum(n) AS BIGINT) AS review_count, count(*) = 1 AS all_agree, count(*) FILTER (n = mx) > 1 AS tied, max(seen) AS seen
        FROM most GROUP BY item_id)
"""


@query(f"""
    WITH {MODEL}, {CONSENSUS}
    SELECT c.campaign_code, c.target_scientific_name, b.batch_code, i.image_id, i.source_provider, i.source_record_id, i.image_url, i.display_url, i.flickr_search_term, i.source_labels, i.pipeline_metadata,
           s.label AS human_label, s.review_count, s.all_agree AS reviews_unanimous, s.tied AS consensus_tied, s.seen AS reviewed_at, '{SCHEMA}' AS schema_version,
           {", ".join(f"{'s.tied OR ' if name == exports.EXCLUDED else ''}s.label IN ({', '.join(repr(x) for x in labels)}) AS {name}" for name, labels in exports.DERIVED.items())}
    FROM items i JOIN consensus s ON s.item_id = i.id {ITEM_JOINS} ORDER BY c.campaign_code, b.batch_code, i.image_id
""")
def consensus_export_full(t):
    """All 17 columns and the derived flags, in bytewise order."""
    return exports.consensus_export(**model(t), schema_version=SCHEMA, derived=True)


# --- imports -------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS ordinal FROM pages),
    d AS (SELECT *, row_number() OVER (ORDER BY sha256('import:3:' || ordinal), ordinal) - 1 AS i FROM p)
    SELECT page_id, trim(url) AS image_url, i // 6 + 1 AS batch_number, i % 6 + 1 AS position, 'PAGES-' || lpad(CAST(i // 6 + 1 AS VARCHAR), CAST(greatest(3, length(CAST(i // 6 + 1 AS VARCHAR))) AS INTEGER), '0') AS batch_code,
           'batch ' || (i // 6 + 1) || ' of ' || (SELECT CAST((count(*) + 5) // 6 AS VARCHAR) FROM pages) AS title
    FROM d
""")
def import_plan(t):
    """Candidates shuffled by a seed and dealt into logical batches; no image twice in a batch."""
    rows = rounds.ranked(t("pages").select("page_id", F.trim("url").alias("image_url")), [], ["page_id"], "ordinal")
    keyed = rows.withColumn("digest", rounds.hash_order("import", 3, F.col("ordinal")))
    planned = rounds.logical_batches(keyed, "digest", ["ordinal"], 6, "PAGES")
    checks.require_none(candidates.repeated_in_batch(planned, ["batch_code"], ["page_id"]), "images repeat in a batch")
    checks.require_none(checks.not_contiguous(planned, ["batch_code"], "position"), "positions have gaps")
    of = planned.agg(F.max("batch_number").alias("batches"))
    title = _text("batch ", F.col("batch_number"), " of ", F.col("batches"))
    return planned.crossJoin(F.broadcast(of)).select("page_id", "image_url", "batch_number", "position", "batch_code", title.alias("title"))


@query("""
    WITH d AS (SELECT page_id, url, row_number() OVER (ORDER BY sha256('import:3:' || ordinal), ordinal) - 1 AS i FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS ordinal FROM pages))
    SELECT 'PAGES-' || printf('%03d', CAST(i // 6 + 1 AS INTEGER)) AS batch_code, i // 6 + 1 AS batch_position, 'draft' AS campaign_status, i % 6 + 1 AS position, CAST(page_id AS VARCHAR) AS image_id, trim(url) AS image_url, 'Species 9' AS target_scientific_name FROM d
""")
def import_publication(t):
    """Candidates as a campaign with batches and items, proved and published as one."""
    m = _published_model(t)
    del m["reviews"]
    rows = rounds.ranked(t("pages").select(F.col("page_id").cast("string").alias("image_id"), F.trim("url").alias("image_url"), F.lit("web").alias("source_provider"), "page_id"), [], ["page_id"], "ordinal")
    planned = rounds.logical_batches(rows.withColumn("digest", rounds.hash_order("import", 3, F.col("ordinal"))), "digest", ["ordinal"], 6, "PAGES")
    after = publications.imported(**m, planned=planned.drop("page_id", "ordinal", "digest", "batch_code"), code="PAGES", title="Pages", target="Species 9", prefix="PAGES", size=6)
    return _new_items(after, "PAGES").select("batch_code", long("batch_position").alias("batch_position"), "campaign_status", long("position").alias("position"), "image_id", "image_url", "target_scientific_name")


# --- rounds --------------------------------------------------------------------------

CATEGORY = "CASE label WHEN 'target_scientific_name' THEN 'scientific_name:' || \"scientificName\" WHEN 'flickr_keyword_match' THEN 'flickr_keyword:' || \"flickrKeyword\" ELSE label END"
SECOND = "list_contains(json_keys(pipeline_metadata), 'rereview')"


@query(f"""
    WITH {MODEL},
    v AS (SELECT r.id, item_id, label, updated_at, source_provider, image_id, target_scientific_name, {CATEGORY} AS category FROM reviews r JOIN items i ON i.id = item_id WHERE NOT {SECOND}),
    m AS (SELECT category, source_provider, image_id, arg_min(item_id, (-epoch_us(updated_at), id)) AS item_id, min(target_scientific_name) AS target,
          string_agg(id || '=' || label, ',' ORDER BY updated_at, id) AS votes FROM v WHERE category IS NOT NULL GROUP BY ALL),
    g AS (SELECT *, dense_rank() OVER (ORDER BY category, target NULLS FIRST, source_provider) AS group_number, count(*) OVER (PARTITION BY category, target, source_provider) AS members FROM m)
    SELECT category, source_provider, image_id, item_id, votes, group_number, members,
           row_number() OVER (PARTITION BY group_number ORDER BY md5('["' || source_provider || '", "' || image_id || '"]'), image_id) AS position
    FROM g
""")
def rereview_round(t):
    m = model(t)
    found = round_plans.rereview_round(m["items"], m["reviews"])
    votes = F.array_join(F.transform("votes", lambda v: F.concat(v["id"].cast("string"), F.lit("="), v["label"])), ",")
    return found.select("category", "source_provider", "image_id", "item_id", votes.alias("votes"), "group_number", "members", "position")


def _published_model(t) -> dict[str, DataFrame]:
    """The model's tables with the columns that publications fill."""
    m = model(t)
    m["campaigns"] = m["campaigns"].withColumns({"title": F.lit(None).cast("string"), "status": F.lit("open")})
    m["batches"] = m["batches"].withColumn("title", F.lit(None).cast("string"))
    return m


def _new_items(after: publications.Published, code: str) -> DataFrame:
    """The items of a round with their campaign and batch."""
    c = after.campaigns.filter(F.col("campaign_code").startswith(code)).select(F.col("id").alias("campaign_id"), "campaign_code", F.col("title").alias("title"), F.col("status").alias("campaign_status"))
    b = after.batches.join(c, "campaign_id").select(F.col("id").alias("batch_id"), "campaign_code", c["title"], "batch_code", "campaign_status", F.col("position").alias("batch_position"))
    return after.items.join(b, "batch_id")


NAMED = """CASE WHEN category LIKE 'scientific_name:%' THEN category[17:] WHEN category LIKE 'flickr_keyword:%' THEN 'Keyword match: ' || category[16:] WHEN category = 'artifact_or_illustration' THEN 'Object, artwork or illustration'
    WHEN category = 'no_biological_subject' THEN 'No clear biological subject' WHEN category = 'arachnid' THEN 'Spider or other arachnid' ELSE upper(category[1]) || replace(category[2:], '_', ' ') END"""


@query(f"""
    WITH {MODEL},
    v AS (SELECT r.id, item_id, label, updated_at, source_provider, image_id, target_scientific_name,
                 CASE label WHEN 'target_scientific_name' THEN 'scientific_name:' || coalesce(nullif("scientificName", ''), target_scientific_name, '(unspecified)') WHEN 'flickr_keyword_match' THEN 'flickr_keyword:' || coalesce("flickrKeyword", flickr_search_term, '') ELSE label END AS category
          FROM reviews r JOIN items i ON i.id = item_id WHERE NOT {SECOND}),
    m AS (SELECT category, source_provider, image_id, arg_min(item_id, (-epoch_us(updated_at), id)) AS item_id, min(target_scientific_name) AS target, count(*) AS votes FROM v GROUP BY ALL),
    g AS (SELECT *, dense_rank() OVER (ORDER BY category, target NULLS FIRST, source_provider) AS n FROM m)
    SELECT 'REREVIEW-R1-' || printf('%03d', n) AS campaign_code, 'Round 2: ' || left({NAMED}, 111) AS title, 'RR-R1-' || printf('%03d', n) || '-001' AS batch_code, source_provider, image_id, CAST(item_id AS VARCHAR) AS original, votes,
           row_number() OVER (PARTITION BY n ORDER BY md5('["' || source_provider || '", "' || image_id || '"]'), image_id) AS position
    FROM g
""")
def round_publication(t):
    """A second round with its campaigns, titles, batches and stamped members, proved and published as one."""
    after = publications.rereview(**_published_model(t), code="R1", at="2024-01-01T00:00:00Z")
    stamp = lambda path: F.get_json_object("pipeline_metadata", f"$.rereview.{path}")
    votes = F.size(F.from_json(stamp("source_reviews"), "array<string>"))
    return _new_items(after, "REREVIEW-R1-").select("campaign_code", "title", "batch_code", "source_provider", "image_id", stamp("original_item_id").alias("original"), long(votes).alias("votes"), long("position").alias("position"))


ANSWER = "CASE WHEN label = 'target_scientific_name' OR label = 'model_scientific_name' AND \"scientificName\" = target_scientific_name THEN 'yes' WHEN label IN ('adult_butterfly', 'target_not_present', 'model_scientific_name') THEN 'no' ELSE 'none' END"


def _answer() -> Column:
    label, same = F.col("label"), F.coalesce(F.col("scientificName") == F.col("target_scientific_name"), F.lit(False))
    yes = (label == round_plans.TARGET) | ((label == "model_scientific_name") & same)
    return F.when(yes, "yes").when(label.isin("adult_butterfly", "target_not_present", "model_scientific_name"), "no").otherwise("none")


LATEST = f"""
    {MODEL},
    v AS (SELECT r.id, item_id, label, "scientificName", r.created_at AS made, updated_at, source_provider, image_id, target_scientific_name, i.created_at AS item_made FROM reviews r JOIN items i ON i.id = item_id),
    e AS (SELECT DISTINCT source_provider, image_id FROM v WHERE (made >= TIMESTAMP '1995-01-01' AND made < TIMESTAMP '1996-01-01' OR updated_at >= TIMESTAMP '1995-01-01' AND updated_at < TIMESTAMP '1996-01-01') AND updated_at >= item_made),
    l AS (SELECT v.* FROM v SEMI JOIN e USING (source_provider, image_id) QUALIFY row_number() OVER (PARTITION BY source_provider, image_id ORDER BY updated_at DESC, id DESC) = 1),
    grouped AS (SELECT source_provider, image_id, item_id, id AS review_id, {ANSWER} AS answer FROM l)
"""


def _latest(t) -> DataFrame:
    m = model(t)
    return round_plans.latest_groups(m["items"], m["reviews"], "1995-01-01", "1996-01-01", _answer(), legacy=())


@query(f"""
    WITH {LATEST},
    a AS (SELECT *, CASE answer WHEN 'yes' THEN 1 WHEN 'no' THEN 2 ELSE 3 END AS n, review_id % 2 AS later FROM grouped),
    p AS (SELECT *, row_number() OVER (PARTITION BY n, later ORDER BY md5('["' || source_provider || '", "' || image_id || '"]'), source_provider, image_id) AS r, count(*) FILTER (later = 0) OVER (PARTITION BY n) AS before FROM a)
    SELECT 'REREVIEW-L1-00' || n AS campaign_code, 'Round 2: ' || ['Yes — Species 1', 'No — other butterfly', 'No butterfly / other or unresolved'][n] AS title, 'RR-L1-00' || n AS batch_code, source_provider, image_id,
           CAST(item_id AS VARCHAR) AS original, CAST(review_id AS VARCHAR) AS review, 'updated' AS rule, r + CASE WHEN later = 1 THEN before ELSE 0 END AS position
    FROM p
""")
def latest_grouping_publication(t):
    """Latest answers as three folders: half of the images in a new round, the others appended later."""
    m = _published_model(t)
    del m["reviews"]
    kinds = F.when(F.col("answer") == "yes", "yes_target").when(F.col("answer") == "no", "no_target").otherwise("no_butterfly")
    members = _latest(t).withColumn("answer", kinds)
    how = {"code": "L1", "target": "Species 1", "rule": {"by": "updated"}, "at": "2024-01-01T00:00:00Z"}
    first = publications.latest_grouping(**m, members=members.filter("review_id % 2 = 0"), **how)
    after = publications.latest_grouping(*first, members=members, append=True, **how)
    stamp = lambda path: F.get_json_object("pipeline_metadata", f"$.rereview.{path}")
    return _new_items(after, "REREVIEW-L1-").select(
        "campaign_code", "title", "batch_code", "source_provider", "image_id", stamp("original_item_id").alias("original"), stamp("effective_review_id").alias("review"), stamp("eligibility.by").alias("rule"), long("position").alias("position")
    )


@query(f"WITH {LATEST} SELECT * FROM grouped")
def latest_answer_round(t):
    return _latest(t)


@query(f"""
    WITH {LATEST},
    old AS (SELECT source_provider, image_id, answer, row_number() OVER (PARTITION BY answer ORDER BY source_provider, image_id) AS position FROM grouped WHERE review_id % 2 = 0),
    new AS (SELECT g.* FROM grouped g ANTI JOIN old USING (source_provider, image_id))
    SELECT source_provider, image_id, new.answer, coalesce((SELECT max(position) FROM old o WHERE o.answer = new.answer), 0) + row_number() OVER (PARTITION BY new.answer ORDER BY source_provider, image_id) AS position FROM new
""")
def latest_answer_append(t):
    """What a published round lacks goes to the end of its batch."""
    found = _latest(t)
    old = rounds.ranked(found.filter("review_id % 2 = 0"), ["answer"], ["source_provider", "image_id"], "position")
    return round_plans.appended(found, old).select("source_provider", "image_id", "answer", "position")


@query(f"""
    WITH {MODEL},
    m AS (SELECT i.id AS item_id, batch_id, i.position, source_provider AS option, b.status FROM items i JOIN batches b ON b.id = batch_id),
    d AS (SELECT option, arg_min(batch_id, (CASE WHEN status = 'open' THEN 0 ELSE 1 END, batch_id)) AS destination FROM m GROUP BY option)
    SELECT item_id, m.option, batch_id AS old_batch_id, destination AS batch_id, row_number() OVER (PARTITION BY destination ORDER BY batch_id, position, item_id) AS position FROM m JOIN d ON d.option = m.option
""")
def regroup_round(t):
    m = model(t)
    members = m["items"].select(F.col("id").alias("item_id"), "batch_id", "position", F.col("source_provider").alias("option"))
    return round_plans.regrouped(members, m["batches"])[0]


@query(f"""
    WITH {MODEL},
    m AS (SELECT batch_id, source_provider AS option, b.status FROM items i JOIN batches b ON b.id = batch_id),
    d AS (SELECT DISTINCT arg_min(batch_id, (CASE WHEN status = 'open' THEN 0 ELSE 1 END, batch_id)) AS id FROM m GROUP BY option)
    SELECT b.id, campaign_id, batch_code, CAST(position AS BIGINT) AS position, CASE WHEN b.id IN (SELECT batch_id FROM items) AND b.id NOT IN (SELECT id FROM d) THEN 'closed' ELSE status END AS status FROM batches b
""")
def regroup_batches(t):
    m = model(t)
    members = m["items"].select(F.col("id").alias("item_id"), "batch_id", "position", F.col("source_provider").alias("option"))
    return round_plans.regrouped(members, m["batches"])[1].withColumn("position", long("position"))


PARTITION = f"""
    {MODEL},
    p AS (SELECT i.*, b.campaign_id, TRY_CAST(json_extract_string(pipeline_metadata, '$.latitude') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(pipeline_metadata, '$.longitude') AS DOUBLE) AS lon FROM items i JOIN batches b ON b.id = batch_id),
    f AS (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0), false) AS has,
          CASE WHEN {SECOND} THEN 'second|' || coalesce(target_scientific_name, '') || '|' || source_provider ELSE 'first|' || campaign_id END AS grp FROM p),
    w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM f WHERE NOT has),
    q AS (SELECT *, (n + 3) // 4 AS b FROM w), z AS (SELECT *, n // b AS size, n % b AS more FROM q),
    dealt AS (SELECT id, batch_id, grp, CASE WHEN r < more * (size + 1) THEN r // (size + 1) ELSE more + (r - more * (size + 1)) // size END + 1 AS bucket, CASE WHEN r < more * (size + 1) THEN r % (size + 1) ELSE (r - more * (size + 1)) % size END + 1 AS place FROM z)
"""


@query(f"""
    WITH {PARTITION}
    SELECT id AS item_id, batch_id AS old_batch_id, grp || '#' || bucket AS new_batch, place AS position, 'no_geotag' AS stamp FROM dealt
    UNION ALL SELECT id, batch_id, NULL, row_number() OVER (PARTITION BY batch_id ORDER BY position, id), 'geotagged' FROM f WHERE has
""")
def geotag_partition(t):
    m = model(t)
    return round_plans.geotag_partition(m["items"], m["batches"], 4)[0]


REFRESH = f"""
    {MODEL},
    seen AS (SELECT DISTINCT source_provider, image_id FROM items SEMI JOIN (SELECT item_id AS id FROM reviews WHERE reviewer_id = 'rev1') r USING (id)),
    o AS (SELECT i.* FROM items i SEMI JOIN (SELECT id AS batch_id FROM batches WHERE status = 'open') b USING (batch_id)),
    kept AS (SELECT id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY position, id) AS position FROM o ANTI JOIN seen USING (source_provider, image_id))
"""


@query(f"WITH {REFRESH} SELECT * FROM kept")
def dataset_refresh(t):
    m = model(t)
    return round_plans.refreshed(m["items"], m["batches"], m["reviews"].filter("reviewer_id = 'rev1'"))[0]


@query(f"WITH {REFRESH} SELECT b.id, batch_code, CASE WHEN b.id IN (SELECT batch_id FROM o) AND b.id NOT IN (SELECT batch_id FROM kept) THEN 'closed' ELSE status END AS status FROM batches b")
def dataset_refresh_batches(t):
    m = model(t)
    return round_plans.refreshed(m["items"], m["batches"], m["reviews"].filter("reviewer_id = 'rev1'"))[1].select("id", "batch_code", "status")


@query(f"WITH {MODEL} SELECT r.id, label, CASE WHEN {SECOND} THEN label END AS second_round_label FROM reviews r JOIN items i ON i.id = item_id")
def second_round_labels(t):
    m = model(t)
    rows = m["reviews"].select("id", "label", "item_id").join(m["items"].select(F.col("id").alias("item_id"), "pipeline_metadata"), "item_id")
    return rows.select("id", "label", round_plans.second_round_label(F.col("label"), F.col("pipeline_metadata")).alias("second_round_label"))


# --- the cursor ----------------------------------------------------------------------


@query(f"""
    WITH {MODEL},
    own AS (SELECT item_id, arg_max(label, (updated_at, id)) AS own_label FROM reviews WHERE reviewer_id = 'rev3' GROUP BY 1),
    k AS (SELECT i.*, source_provider AS kp, coalesce(nullif(source_record_id, ''), image_id) AS kr FROM items i),
    o AS (SELECT k.*, own_label, own.item_id IS NOT NULL AS reviewed, batch_code FROM k JOIN batches b ON b.id = k.batch_id LEFT JOIN own ON own.item_id = k.id WHERE status = 'open'),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY reviewed, position, id) = 1),
    any_ AS (SELECT DISTINCT item_id FROM reviews),
    n AS (SELECT batch_id, count(*) AS total, count(*) FILTER (id IN (SELECT item_id FROM any_)) AS team, count(*) FILTER (reviewed) AS personal, min(position) AS lo, max(position) AS hi FROM o GROUP BY 1),
    said AS (SELECT id, coalesce(json_extract_string(pipeline_metadata, '$.bioclip.top10[0].scientific_name'), json_extract_string(pipeline_metadata, '$.bioclip.top5[0].scientific_name')) AS name,
             TRY_CAST(coalesce(json_extract_string(pipeline_metadata, '$.bioclip.top10[0].cosine'), json_extract_string(pipeline_metadata, '$.bioclip.top5[0].cosine')) AS DOUBLE) AS cosine FROM items)
    SELECT f.batch_id, f.batch_code, f.id AS item_id, f.position, f.image_id, f.source_provider,
           coalesce((SELECT min(position) FROM o WHERE o.batch_id = f.batch_id AND o.position > f.position), lo) AS next_position,
           coalesce((SELECT max(position) FROM o WHERE o.batch_id = f.batch_id AND o.position < f.position), hi) AS previous_position,
           total, team, personal, total > 0 AND team = total AS complete, name AS predicted_name, cosine, CASE WHEN own_label <> 'flickr_keyword_match' THEN own_label END AS own_label,
           EXISTS (SELECT 1 FROM k WHERE k.kp = f.kp AND k.kr = f.kr AND k.batch_id <> f.batch_id AND k.id IN (SELECT item_id FROM any_)) AS previously_reviewed
    FROM f JOIN n ON n.batch_id = f.batch_id LEFT JOIN said ON said.id = f.id AND name IS NOT NULL AND cosine BETWEEN -1 AND 1
""")
def review_cursor(t):
    """Resume, neighbours, progress, prediction, own label and mark of each open batch, as one row."""
    m = model(t)
    return cursor.review_cursor(m["batches"], m["items"], m["reviews"], "rev3", MODEL_NAME)


@query(f"""
    WITH {MODEL}, q AS (SELECT i.id, batch_id, position, least(greatest(coalesce(CASE WHEN batch_id % 4 = 0 THEN NULL ELSE batch_id - 3 END, 2), 1), 2) AS n FROM items i)
    SELECT id, batch_id, position FROM q QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY position, id) <= n
""")
def queue_head(t):
    """The head of each batch's queue, whose length is clamped to one or two."""
    items = model(t)["items"].select("id", "batch_id", "position")
    asked = F.when(F.col("batch_id") % 4 == 0, F.lit(None)).otherwise(F.col("batch_id") - 3)
    numbered = rounds.ranked(items, ["batch_id"], ["position", "id"], "n")
    return numbered.filter(F.col("n") <= cursor.queue_limit(asked)).drop("n")


# --- workbooks -----------------------------------------------------------------------


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS x, CASE WHEN doc_id % 3 = 0 THEN 'done' END AS label FROM documents)
    SELECT doc_id, label, substring(x, 1, 900) AS text, CASE WHEN length(x) > 900 THEN substring(x, 901, 900) END AS text__part_2,
           length(x) > 1800 AS goes_on, sheet FROM d, (SELECT unnest(['All', 'own']) AS s) CROSS JOIN LATERAL (SELECT CASE WHEN s = 'All' THEN 'All' WHEN label IS NOT NULL THEN 'Classified' ELSE 'Non-classified' END AS sheet)
""")
def workbook_sheets(t):
    """Texts cut into cells, and rows in the sheet of all and their own."""
    rows = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "done").alias("label"))
    cells = workbook.continued(rows, ["text"], 900)
    return workbook.review_sheets(cells, "label").select("doc_id", "label", "text", "text__part_2", F.col("text__part_3").isNotNull().alias("goes_on"), "sheet")


@query("SELECT CAST(greatest(1, max((length(text) + 899) // 900)) AS BIGINT) AS text, CAST(greatest(1, max((length(source) + 1) // 2)) AS BIGINT) AS source FROM documents")
def cell_capacities(t):
    big = workbook.capacities(t("documents"), ["text"], 900)
    return big.crossJoin(F.broadcast(workbook.capacities(t("documents"), ["source"], 2)))


@query("""
    WITH t AS (SELECT o_custkey, o_orderpriority AS l, count(*) AS n FROM orders GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total FROM t),
    r AS (SELECT o_custkey, coalesce(max(l) FILTER (2 * n > total), 'Disputed') AS result FROM m GROUP BY o_custkey)
    SELECT o_custkey, result, dense_rank() OVER (ORDER BY result = 'Disputed', result) AS place FROM r
""")
def classification_workbook(t):
    """Results by strict majority; the sheet of disputed ones comes last."""
    return workbook.classification_sheets(t("orders"), ["o_custkey"], "o_orderpriority")


@query("""
    WITH k AS (SELECT user_id, event_type, ['coordinate', 'named', 'hour_neighbour', 'owner_comment', 'photo_text'][event_id % 5 + 1] AS kind, event_id, ts FROM events),
    l AS (SELECT user_id, kind, arg_max(event_type, (ts, event_type)) AS v FROM k GROUP BY ALL),
    j AS (SELECT user_id, '{"latest":{' || string_agg('"' || kind || '":"' || v || '"', ',' ORDER BY kind) || '},"primary":"' ||
          arg_min(kind, list_position(['coordinate', 'named', 'hour_neighbour', 'day_neighbour', 'owner_comment', 'photo_text'], kind)) || '","tags":["' || string_agg(kind, '","' ORDER BY kind) || '"]}' AS payload FROM l GROUP BY 1)
    SELECT user_id, payload, sha256(payload) AS content_sha256 FROM j
""")
def clue_payloads(t):
    """A photo's clues as JSON, with the digest of their content."""
    kinds = F.array(*[F.lit(k) for k in ("coordinate", "named", "hour_neighbour", "owner_comment", "photo_text")])
    rows = t("events").select("user_id", "event_type", "ts", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"))
    return clue_tables.clue_payload(rows, "user_id", "kind", "event_type", "ts")


@query("""
    WITH m AS (SELECT o_custkey AS photo, l_orderkey AS mention, CASE WHEN o_orderkey % 3 = 0 THEN 'tag' WHEN o_orderkey % 3 = 1 THEN 'title' ELSE 'comment' END AS source, 'N' || (l_suppkey % 3) AS country,
               CASE WHEN l_linenumber = 1 THEN 'country' ELSE 'settlement' END AS level, o_orderkey % 9 = 0 AS forced FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    r AS (SELECT * FROM m WHERE source <> 'comment'),
    u AS (SELECT photo, mention, count(DISTINCT country) AS kinds, bool_or(level = 'country') AS named FROM r GROUP BY ALL),
    f AS (SELECT photo, string_agg(DISTINCT country, ',' ORDER BY country) AS c FROM r WHERE forced AND level = 'country' GROUP BY 1),
    d AS (SELECT r.photo, string_agg(DISTINCT country, ',' ORDER BY country) AS c FROM r JOIN u USING (photo, mention) WHERE named AND kinds = 1 GROUP BY 1),
    n AS (SELECT photo, count(*) AS n FROM u GROUP BY 1),
    i AS (SELECT r.photo, country FROM r JOIN n USING (photo) WHERE n >= 2 GROUP BY r.photo, country, n HAVING count(DISTINCT mention) = n),
    a AS (SELECT photo, min(country) AS c FROM i GROUP BY 1 HAVING count(*) = 1)
    SELECT photo, coalesce(f.c, d.c, a.c) AS context FROM n LEFT JOIN f USING (photo) LEFT JOIN d USING (photo) LEFT JOIN a USING (photo) WHERE coalesce(f.c, d.c, a.c) IS NOT NULL
""")
def country_context(t):
    """The countries of tags and titles: stated ones, then single ones, then what all mentions share."""
    o = F.col("o_orderkey")
    source = F.when(o % 3 == 0, "tag").when(o % 3 == 1, "title").otherwise("comment")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == o).select(
        F.col("o_custkey").alias("photo"), F.col("l_orderkey").alias("mention"), source.alias("source"), _text("N", F.col("l_suppkey") % 3).alias("country"),
        F.when(F.col("l_linenumber") == 1, "country").otherwise("settlement").alias("level"), (o % 9 == 0).alias("forced"),
    )
    return clues.country_context(rows, "photo", "mention", "source", "country", "level", "forced").select("photo", F.array_join("context", ",").alias("context"))


# --- hygiene -------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://live.staticflickr.com/1/' || page_id || '_a_b.jpg' WHEN 1 THEN 'https://live.staticflickr.com:443/1/' || page_id || '_a_x.jpg' WHEN 2 THEN 'http://live.staticflickr.com/1_z.jpg'
               WHEN 3 THEN 'https://me@live.staticflickr.com/1_z.jpg' WHEN 4 THEN 'https://evilstaticflickr.com/1_z.jpg' ELSE 'https://staticflickr.com:8443/1_z.jpg' END AS url FROM pages)
    SELECT page_id, page_id % 6 IN (0, 1) AS allowed, CASE page_id % 6 WHEN 0 THEN CAST(1024 AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 4 THEN NULL ELSE CAST(640 AS DOUBLE) END AS edge FROM p
""")
def image_hosts(t):
    """Which addresses an image may come from, and the longest edge that an address promises."""
    k = F.col("page_id")
    forms = [
        _text("https://live.staticflickr.com/1/", k, "_a_b.jpg"), _text("https://live.staticflickr.com:443/1/", k, "_a_x.jpg"), F.lit("http://live.staticflickr.com/1_z.jpg"),
        F.lit("https://me@live.staticflickr.com/1_z.jpg"), F.lit("https://evilstaticflickr.com/1_z.jpg"), F.lit("https://staticflickr.com:8443/1_z.jpg"),
    ]
    url = F.lit(None).cast("string")
    for n, form in enumerate(forms):
        url = F.when(k % 6 == n, form).otherwise(url)
    return t("pages").select("page_id", hygiene.allowed_host(url, ["staticflickr.com"]).alias("allowed"), hygiene.preview_edge(url).alias("edge"))


@query("""
    SELECT c_custkey, '{"name": "' || c_name || '", "deep": [{"kept": ' || c_nationkey || '}, {"list": []}]}' AS clean FROM customer
""")
def without_private_keys(t):
    """Keys that hold addresses or a raw dump go, at any depth."""
    json = _text('{"name": "', F.col("c_name"), '", "Email": "a@b.c", "deep": [{"userEmailHash": 1, "kept": ', F.col("c_nationkey"), '}, {"list": [], "raw_dump": {"x": 1}}]}')
    return t("customer").select("c_custkey", text.without_keys_like(("email",), ("raw_dump",))(json).alias("clean"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 100 > 90 OR c_nationkey * 8 > 180 OR c_custkey % 18 NOT BETWEEN 1 AND 16")
def broken_geotags(t):
    rows = t("customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_nationkey") * 8).alias("lon"), (F.col("c_custkey") % 18).alias("accuracy"))
    return hygiene.broken_geotags(rows, "lat", "lon", "accuracy").select("c_custkey")


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Small thing' WHEN 1 THEN 'Left 111' WHEN 2 THEN 'Unsure' ELSE 'Economy' END AS shown FROM part
""")
def category_names(t):
    """What categories are called."""
    k = F.col("p_partkey") % 4
    category = F.when(k == 0, "flickr_keyword:small_thing").when(k == 1, "left_111").when(k == 2, "uncertain").otherwise("economy")
    return t("part").select("p_partkey", text.display_name(category, ["flickr_keyword:", "scientific_name:"], {"uncertain": "Unsure"}).alias("shown"))


@query("SELECT c_custkey, c_custkey % 3 > 0 AS positive FROM customer")
def target_cohort(t):
    """Photos with a positive count for their target."""
    counts = _text('{"target:N', F.col("c_nationkey"), '": ', F.col("c_custkey") % 3, ', "other": 5}')
    return t("customer").select("c_custkey", hygiene.positive_cohort(counts, _text("N", F.col("c_nationkey"))).alias("positive"))


@query("""
    WITH m AS (SELECT CAST(c_nationkey AS DOUBLE) + 0.000001 * (c_custkey % 3) AS lat, CAST(c_nationkey AS DOUBLE) / 2 AS lon, c_custkey FROM customer)
    SELECT round(lat, 5) AS lat, round(lon, 5) AS lon, count(*) AS points, min(c_custkey) AS first, round(least(13.0, 5 + log2(count(*))), 9) AS size FROM m GROUP BY 1, 2
""")
def map_markers(t):
    n = F.col("c_nationkey").cast("double")
    rows = t("customer").select((n + F.lit(0.000001) * (F.col("c_custkey") % 3)).alias("lat"), (n / 2).alias("lon"), "c_custkey")
    return hygiene.marker_groups(rows, "lat", "lon", "c_custkey").withColumn("size", F.round("size", 9))


@query("""
    SELECT c_custkey FROM customer WHERE contains(lower(c_name || chr(10) || c_mktsegment), 'build') AND c_nationkey BETWEEN 2 AND 15 AND c_acctbal >= 250
""")
def explorer_filter(t):
    """A text, a box and a mode at once."""
    rows = t("customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("double").alias("longitude"), F.lit(1.0).alias("latitude"), F.col("c_acctbal").alias("spread_km"), F.lit(1.0).alias("isolation_km"),
        F.lit("settlement").alias("level"), F.array(F.lit("x")).alias("flags"),
    )
    return hygiene.explorer_filter(rows, ["c_name", "c_mktsegment"], "BUILD", "ambiguous", (2, -5, 15, 5)).select("c_custkey")


@query("""
    SELECT event_id, '{"id":' || event_id || ',"props":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"a b":[1,{"z":null}],"n":' || user_id || '}' END
        || ',"list":[{"x":1,"y":"' || event_type || '"},{"x":null}],"late":{"v":"\\"q\\""}}' AS record
    FROM events
""")
def restored_fields(t):
    """Fields that the known type lacks come back at any depth and in lists."""
    k = F.get_json_object("props", "$.k")
    inner = F.when(F.col("event_id") % 4 == 0, F.lit("null")).otherwise(_text('{"n": ', F.col("user_id"), ', "a b": [1, {"z": null}], "k": ', k, "}"))
    line = _text('{"late": {"v": "\\"q\\""}, "list": [{"y": "', F.col("event_type"), '", "x": 1}, {}], "id": ', F.col("event_id"), ', "props": ', inner, "}")
    kind = "id bigint, props struct<k: int>, list array<struct<x: int>>"
    read = t("events").select("event_id", F.from_json(line, kind).alias("known"), F.parse_json(line).alias("rest")).select("event_id", "known.*", "rest")
    return readers.restored_records(read.drop("event_id")).select(F.col("id").alias("event_id"), "record")


# --- archives, profiles, queues ------------------------------------------------------


@query("""
    WITH a AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS shard, props, md5(props) AS h FROM events)
    SELECT shard, count(*) AS records, CAST(sum(strlen(props)) AS BIGINT) AS bytes, min(event_id) AS first, max(event_id) AS last, sha256(string_agg(event_id || ':' || h, ',' ORDER BY event_id || ':' || h)) AS digest FROM a GROUP BY shard
""")
def archive_manifest(t):
    return archive.manifest(archive.shards(t("events"), "event_id", "props", 100), "event_id")


@query("SELECT event_id, props FROM events")
def archive_round_trip(t):
    """Swapped for references and restored, rows are what they were."""
    rows = t("events").select("event_id", "props")
    kept = archive.shards(rows.filter("event_id % 3 <> 0"), "event_id", "props", 100)
    small = archive.swapped(rows, kept, "event_id", "props", "provenance")
    return archive.restored(small, kept, "event_id", "props")


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k":' || json_extract_string(props, '$.k') || ',"review":{"value": 1.50, "of": "' || event_type || '"}}' ELSE '{"k":' || user_id || '.0}' END AS props FROM events
""")
def archive_overrides(t):
    """Keys that rows have got since they were archived win when these are restored; numbers stay as they are written."""
    rows = t("events").select("event_id", "user_id", "event_type", "props")
    kept = archive.shards(rows.filter("event_id % 3 <> 0").select("event_id", "props"), "event_id", "props", 100, 2000)
    small = archive.swapped(rows, kept, "event_id", "props", "provenance")
    added = F.when(F.col("event_id") % 3 == 1, _text('{"review": {"value": 1.50, "of": "', F.col("event_type"), '"}}')).when(F.col("event_id") % 3 == 2, _text('{"k": ', F.col("user_id"), ".0}"))
    since = small.withColumn("props", F.when(added.isNotNull(), text.json_overlay("props", added)).otherwise(F.col("props")))
    return archive.restored(since, kept, "event_id", "props").select("event_id", "props")


@query("""
    SELECT 'doc_id' AS "column", 'bigint' AS type, count(doc_id) AS filled, CAST(1 AS BIGINT) AS place FROM documents UNION ALL SELECT 'text', 'string', count(text), 2 FROM documents UNION ALL
    SELECT 'lang', 'string', count(lang), 3 FROM documents UNION ALL SELECT 'source', 'string', count(source), 4 FROM documents UNION ALL SELECT 'n_chars', 'bigint', count(n_chars), 5 FROM documents
""")
def column_dictionary(t):
    return archive.column_dictionary(t("documents"))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, CAST(sum(length(text)) AS BIGINT) AS text_characters, CAST(sum(length(lang)) AS BIGINT) AS lang_characters FROM documents")
def source_profile(t):
    return archive.source_profile(t("documents"), "doc_id", ["text", "lang"])


@query("""
    SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.event_type = a.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 HOUR) AS in_window,
           (SELECT count(*) FROM events b WHERE b.event_type = a.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 HOUR) > 3 AS over_budget
    FROM events a
""")
def rolling_budget(t):
    """The calls of the last two hours, up to and with each call."""
    return archive.rolling_calls(t("events"), "ts", "event_type", 7200, 3).select("event_id", "in_window", "over_budget")


@query("""
    SELECT event_type, event_id, user_id FROM events WHERE user_id % 5 < 3 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts, event_id) = 1
""")
def next_jobs(t):
    """What each queue does next."""
    queue = t("events").select("event_type", "event_id", "user_id", "ts", (F.col("user_id") % 5).alias("tries"))
    return archive.next_jobs(queue, "event_type", "user_id", "tries", "ts", "event_id").select("event_type", "event_id", "user_id")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '2020-01-0' || (c_custkey % 9 + 1) ELSE '#' || c_custkey END AS series,
           TIMESTAMP '2020-01-01 10:00:00' - to_hours(CAST(c_custkey % 3 AS INTEGER)) AS instant
    FROM customer
""")
def series_and_instants(t):
    """Full dates join photos to a series; times with offsets are instants."""
    k = F.col("c_custkey")
    export = F.when(k % 2 == 0, _text("2020-01-0", k % 9 + 1)).otherwise("2020-01")
    at = dates.instant(_text("2020-01-01T10:00:00+0", k % 3, ":00"))
    return t("customer").select("c_custkey", dates.series_key(export, k).alias("series"), at.cast("timestamp_ntz").alias("instant"))


@query("SELECT count(*) AS customers, (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS nations FROM customer")
def union_count(t):
    """How many distinct keys two tables have together."""
    both = t("customer").select("c_nationkey").union(t("supplier").select("s_nationkey")).distinct().agg(F.count(F.lit(1)).alias("nations"))
    return t("customer").agg(F.count(F.lit(1)).alias("customers")).crossJoin(F.broadcast(both))


@query("SELECT event_id, '{\"a\": 1, \"k\": ' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || '}' AS sorted FROM events")
def sorted_json(t):
    json = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"a":1}'))
    return t("events").select("event_id", text.sorted_json(json).alias("sorted"))


@query("SELECT c_mktsegment, count(*) AS rows, count(*) FILTER (c_custkey % 4 > 0) AS mapped, count(*) FILTER (c_custkey % 4 = 0) AS unplaced FROM customer GROUP BY 1")
def mapped_and_unplaced(t):
    rows = t("customer").select("c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("latitude"))
    return hygiene.placed_counts(rows, "latitude", "c_mktsegment")


@query(f"WITH {MODEL} SELECT id, unnest(CAST(json_extract_string(source_labels, '$[*]') AS VARCHAR[])) AS label FROM items")
def source_label_rows(t):
    """The elements of a JSON array as rows."""
    items = model(t)["items"]
    return items.select("id", F.explode(F.from_json("source_labels", "array<string>")).alias("label"))


@query(f"""
    WITH {MODEL}, k AS (SELECT i.id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY position, id) AS position FROM items i)
    SELECT b.id, CASE WHEN b.id % 2 = 0 THEN CASE WHEN b.id IN (SELECT batch_id FROM k) THEN 'open' ELSE status END WHEN b.id % 5 = 1 THEN 'closed' ELSE status END AS status FROM batches b
""")
def publish_round(t):
    """Statuses after a round whose batches have passed their checks."""
    m = model(t)
    items = rounds.ranked(m["items"].withColumnRenamed("position", "old"), ["batch_id"], ["old", "id"], "position").withColumn("image_id", F.col("id").cast("string"))
    opened = items.select(F.col("batch_id").alias("id")).distinct().filter("id % 2 = 0")
    closed = m["batches"].filter("id % 2 = 1 AND id % 5 = 1").select("id")
    return round_plans.published(m["batches"], items, opened, closed).select("id", "status")


@query(f"""
    WITH {MODEL}, l AS (SELECT item_id, arg_max(struct_pack(p := id % 50, s := label), (updated_at, id % 50)) AS m FROM reviews GROUP BY 1)
    SELECT i.id, i.image_id, m.p AS member_position, m.s AS member_stamp FROM items i JOIN l ON l.item_id = i.id
""")
def latest_members(t):
    """Items with the latest of the members that a shuffled round made of them."""
    m = model(t, READ)
    members = m["reviews"].select(F.col("item_id").alias("original_id"), (F.col("id") % 50).alias("position"), F.col("label").alias("stamp"), F.col("updated_at").alias("made"), *READ)
    return round_plans.with_latest_members(m["items"].select("id", "image_id"), members, *READ)


@query("""
    WITH c AS (SELECT * FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 40)
    SELECT c_custkey, place FROM c
""")
def explorer_head(t):
    """The head of the explorer's list: the widest spread first."""
    rows = t("customer").select("c_custkey", F.col("c_acctbal").alias("spread_km"), (-F.col("c_acctbal")).alias("__down"))
    first = hygiene.explorer_order(rows, "ambiguous", "c_custkey").limit(40)
    return rounds.ranked(first, [], ["__down", "c_custkey"], "place").select("c_custkey", "place")


PROVISIONAL = """
    ev AS (SELECT l_orderkey % 200 AS photo, l_suppkey AS place, CASE l_suppkey % 3 WHEN 0 THEN 'country' WHEN 1 THEN 'region' ELSE 'settlement' END AS level, CASE WHEN l_suppkey % 4 > 0 THEN 'N' || (l_suppkey % 4) END AS country,
                  CAST(l_suppkey % 10 * 8 - 40 AS DOUBLE) AS latitude, CAST(l_suppkey % 10 * 30 - 150 AS DOUBLE) AS longitude, 's' || (l_linenumber % 4) AS source, 20 + l_linenumber * 9 AS score, CASE WHEN l_orderkey % 5 = 0 THEN 'N1' END AS owner_country FROM lineitem),
    ok AS (SELECT * FROM ev WHERE (owner_country IS NULL OR country IS NULL OR owner_country = country) AND NOT (latitude = 0 AND longitude = 0)),
    cand AS (SELECT photo, place, level, country, latitude, longitude, max(score) + 4 * least(3, count(DISTINCT source) - 1) AS total, count(DISTINCT source) AS sources FROM ok GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY total DESC, sources DESC, place) AS nth FROM cand)
"""


@query(f"""
    WITH {PROVISIONAL}
    SELECT photo, max(CAST(place AS VARCHAR)) FILTER (nth = 1) AS place, coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY nth) FILTER (nth BETWEEN 2 AND 11), '') AS alternatives,
           concat_ws(',', CASE WHEN count(*) > 1 THEN 'several' END, CASE WHEN max(level) FILTER (nth = 1) <> 'settlement' THEN 'coarse' END, CASE WHEN max(country) FILTER (nth = 1) IS NULL THEN 'no_country' END) AS flags
    FROM n GROUP BY photo
""")
def provisional_places(t):
    """The best place of each photo, its alternatives and flags (but that of the spread)."""
    l, s = F.col("l_orderkey"), F.col("l_suppkey")
    level = F.when(s % 3 == 0, "country").when(s % 3 == 1, "region").otherwise("settlement")
    rows = t("lineitem").select(
        (l % 200).alias("photo"), s.alias("place"), level.alias("level"), F.when(s % 4 > 0, _text("N", s % 4)).alias("country"), (s % 10 * 8 - 40).cast("double").alias("latitude"), (s % 10 * 30 - 150).cast("double").alias("longitude"),
        F.lit("title").alias("kind"), _text("s", F.col("l_linenumber") % 4).alias("source"), (20 + F.col("l_linenumber") * 9).alias("score"), F.when(l % 5 == 0, "N1").alias("owner_country"),
    )
    none = rows.limit(0).select("photo", F.lit(0).alias("anchor_id"), F.lit(0.0).alias("delta_seconds"), "latitude", "longitude")
    found = clues.provisional(rows, none, "photo")
    flags = F.array_join(F.filter("flags", lambda f: f != "spread"), ",")
    return found.select("photo", "place", F.array_join("alternatives", ",").alias("alternatives"), flags.alias("flags"))
