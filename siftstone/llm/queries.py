"""The queries ``opN_<name>``: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_dp, common, content_dedup, html_main, line_runs, mixture, quality_rank, rendezvous, simhash_cover, sorted_projection, substring_trees, token_align, token_records, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "records")
    token_records.write_records(table(spark, sf_dir, "documents"), f"{folder}/data", public_tokenizers.path("word_bpe_49k.json"))
    index = token_records.write_index(spark, f"{folder}/data", f"{folder}/index")
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op2_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality_rank.train(docs, table(spark, sf_dir, "labels"))
    return quality_rank.score(docs, ranker).select("doc_id", quality_rank.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dp.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), outputs=False)


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law")
    )
    sharded = rendezvous.assign_shards(docs, "doc_id", (1.0,) * 16, (1.0,) * 17)
    return rendezvous.assign_slots(sharded, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op8_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.near_groups(table(spark, sf_dir, "documents"), width=3, radius=2)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = mixture.mix(table(spark, sf_dir, "documents"))
    whole = ["doc_id", "size", "source_size", "target", "source", "copy", "nth"]
    return blocks.withColumnRenamed("crc", "copy").groupBy(*whole).agg(F.sum("take").alias("taken"), F.count("shard").alias("blocks")).drop("copy", "nth")


def op10_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.drop_frequent_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_token_records": op1_token_records,
    "op2_content_sort_dedup": op2_content_sort_dedup,
    "op3_quality_rank": op3_quality_rank,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_html_main": op5_html_main,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_substring_trees": op7_substring_trees,
    "op8_simhash_cover": op8_simhash_cover,
    "op9_mixture": op9_mixture,
    "op10_sorted_projection": op10_sorted_projection,
    "op11_line_runs": op11_line_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op7_substring_trees": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
        rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM win SEMI JOIN rep USING (k)),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op10_sorted_projection": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS m FROM r GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, m AS component_id, vec_id = m AS kept
        FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
    """,
    "op11_line_runs": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        k AS (
            SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d)
        ),
        h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN h USING (key) GROUP BY doc_id
    """,
    "op2_content_sort_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
}
