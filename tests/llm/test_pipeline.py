"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import stages

from ..conftest import DATA
from .test_mixture import targets
from .test_texts import lowered


def shingles_of(text):
    words = lowered(text or "").split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_return_documents(outputs):
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "bpe"]


def test_quality(spark, outputs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outputs[1].select("doc_id").collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.97


def test_exact_copies(outputs):
    first: dict[str, int] = {}
    for r in sorted(outputs[1].collect(), key=lambda r: r["doc_id"]):
        first.setdefault(lowered(r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in outputs[2].collect()) == sorted(first.values())


def test_near_copies(outputs):
    rows = sorted(((r["doc_id"], r["text"]) for r in outputs[2].collect()))
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= stages.SIMILARITY * (len(sets[a]) + len(sets[b]) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r["doc_id"] for r in outputs[3].collect()) == [rows[k][0] for k in range(len(rows)) if root(k) == k]


def test_mix(outputs):
    had, got = Counter(), Counter()
    for r in outputs[3].collect():
        had[r["source"]] += len((r["text"] or "").split())
    for r in outputs[4].collect():
        got[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for source, target in targets(dict(had)).items():
        assert abs(got[source] - target) <= 1


def test_encoding(outputs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in outputs[4].collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in outputs[5].collect()) == want


def test_odd_documents(spark):
    """Nulls in any column, repeated rows and identifiers, and a column that is named like an inner one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (7, None, "en", "web", 0), (8, "", None, None, None), (None, "a b c d e f g", "en", None, 13), (9, "one", "en", "web", 3)], docs.schema
    )
    docs = some.unionByName(some.limit(20)).unionByName(odd)
    had = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        assert rows and {r["doc_id"] for r in rows} <= had, name
        docs = spark.createDataFrame(rows, docs.schema)


def test_stages_without_decisions_keep_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "a", "en", "web", 1), (7, "a", "en", "web", 1)], docs.schema)
    assert len(stages.exact_dedup(spark, odd, DATA).collect()) == 2
    assert len(stages.near_dedup(spark, odd, DATA).collect()) == 3
    assert len(stages.bpe(spark, odd, DATA).collect()) == 3


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
