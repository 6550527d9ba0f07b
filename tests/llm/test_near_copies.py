"""Near copies against exact Jaccard similarities."""

from __future__ import annotations

import random

from siftstone.llm import near_copies, stages

from .test_texts import table


def jaccard(a: str, b: str) -> float:
    one, two = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def planted(count: int, least: float, most: float, seed: int) -> list[tuple[str, str]]:
    """Lone pairs of texts with a similarity within the bounds."""
    rng, pairs = random.Random(seed), []
    while len(pairs) < count:
        a = [f"w{rng.randrange(20000)}" for _ in range(rng.randrange(300, 600))]
        b = a.copy()
        for at in rng.sample(range(len(b)), rng.randrange(3, 30)):
            b[at] = f"v{rng.randrange(20000)}"
        if least <= jaccard(" ".join(a), " ".join(b)) < most:
            pairs.append((" ".join(a), " ".join(b)))
    return pairs


def kept(spark, pairs) -> set[int]:
    rows = [(2 * k + side, t) for k, pair in enumerate(pairs) for side, t in enumerate(pair)]
    return {r["doc_id"] for r in stages.near_dedup(spark, table(spark, rows), "").collect()}


def test_lone_pairs_are_found(spark):
    left = kept(spark, planted(400, 0.8, 0.85, 1))
    assert {2 * k for k in range(400)} <= left
    assert sum(2 * k + 1 not in left for k in range(400)) >= 0.9 * 400


def test_pairs_below_the_similarity_stay(spark):
    pairs = planted(150, 0.7, 0.78, 2)
    assert kept(spark, pairs) == set(range(300))


def test_groups_are_what_jaccard_connects(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):  # chains: neighbours reach 0.8, others mostly don't
        words = [f"w{rng.randrange(20000)}" for _ in range(400)]
        for _ in range(12):
            texts.append(" ".join(words))
            for at in rng.sample(range(400), 4):
                words[at] = f"w{rng.randrange(20000)}"
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["doc_id"]: r["component"] for r in near_copies.near_copies(table(spark, enumerate(texts))).collect()}
    least = {}
    for k in range(len(texts)):
        least.setdefault(found[k], k)
    assert [least[found[k]] for k in range(len(texts))] == [root(k) for k in range(len(texts))]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE "), (None, "one"), (6, "one two three four five"), (7, "one two three four six")]
    found = {}
    for r in near_copies.near_copies(table(spark, rows)).collect():
        found.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(found.values(), key=repr) == sorted([{1, 2, 3}, {4, 5, None}, {6}, {7}], key=repr)
    assert near_copies.near_copies(table(spark, [])).count() == 0


def test_repeated_identifiers(spark):
    (a, b), (other, _) = planted(2, 0.9, 0.99, 5)
    rows = [(1, a), (2, b), (2, other), (None, b)]
    got = stages.near_dedup(spark, table(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (2, other), (0, b)])
    got = stages.near_dedup(spark, table(spark, [(1, a), (1, b)]), "").collect()
    assert len(got) == 1


def test_no_table_of_texts_is_broadcast(spark):
    """However small the tables look, none that grows with the texts passes through the driver."""
    df = spark.createDataFrame([(k, f"one two three four five six seven {k % 3} nine ten") for k in range(30)], "doc_id long, text string")
    found = near_copies.near_copies(df)
    assert found.count() == 30 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
