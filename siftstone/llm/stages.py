"""The stages of the corpus pipeline.

Each takes what the one before has kept, with the columns of ``documents``, and all but the
last return these columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_dp, content_dedup, mixture, near_copies, quality_rank
from .common import apart, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: a Jaccard similarity of 0.8 at least between the sets of shingles of five words.
SHINGLE = 5
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ranker = quality_rank.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rank.score(docs, ranker, keep_columns=True).filter("predicted = 1").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    return content_dedup.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier stays.

    Rows without an identifier stay.  Rows are told apart by identifier and text, so that
    those which repeat an identifier stay or go by their own text.  Fully repeated rows stay
    or go together (the exact dedup before leaves none).
    """
    groups = near_copies.near_copies(docs, width=SHINGLE, similarity=SIMILARITY)
    row = F.struct("doc_id", "text_hash")
    heads = groups.filter("doc_id IS NOT NULL").groupBy("component").agg(F.min(row).alias("head"))
    dropped = groups.join(apart(heads), "component").filter(F.col("doc_id").isNotNull() & (row != F.col("head")))
    dropped = written(dropped.select("doc_id", "text_hash").distinct(), "dropped")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return hashed.join(apart(dropped), ["doc_id", "text_hash"], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document stays, is repeated or goes."""
    return mixture.mixed_rows(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: token counts and digests."""
    return bpe_dp.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
