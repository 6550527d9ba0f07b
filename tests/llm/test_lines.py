"""Line dedup by levelled runs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from siftstone.llm import line_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs, least_chars):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(-1 if i is None else i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if keeper.get(key(x), i if i is not None else -1) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


def result(df, **how):
    got = line_runs.drop_frequent_lines(df, **how)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept": "string"}
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("batches, fan", [(1, 3), (4, 3), (7, 2)])
def test_random_documents(spark, batches, fan):
    rng = random.Random(batches)
    pool = ["Fréquent line %d, long enough" % k for k in range(12)] + ["short", "", " ", "É" * 21, "é" * 21, "x" * 20, "y" * 19 + " "]
    rows = [(k, "\n".join(f"{rng.choice(['', ' ', chr(11)])}{rng.choice([str.upper, str])(rng.choice(pool))}{rng.choice(['', chr(13)])}" for _ in range(rng.randrange(9)))) for k in range(60)]
    rows += [(None, pool[0]), (None, pool[0] + "\nmore"), (60, None), (61, ""), (62, pool[1]), (62, pool[1]), (62, pool[2] + "\n" + pool[2])]
    df = spark.createDataFrame([(i, t, 1, "b", "k") for i, t in rows], "doc_id long, text string, id int, batch string, keeper string")
    assert result(df, least_docs=5, least_chars=20, batches=batches, fan=fan) == sorted(brute(rows, 5, 20), key=str)


def test_thresholds(spark):
    at, below = "a" * 40, "b" * 39
    rows = [(k, f"{at}\n{below}\nown {k}") for k in range(5)] + [(k, "c" * 50) for k in range(10, 14)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(brute(rows, 5, 40), key=str)
    assert [r[2] for r in sorted(got)] == [1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_long_text_and_nothing(spark):
    long = "\n".join(f"line {k} of a very long text, which is unlike all others" if k % 2 else "the line that everybody holds, again and again" for k in range(60_000))
    rows = [(k, "The line that everybody holds, again and again ") for k in range(8)] + [(4, long)]
    got = {(r[0], r[1]): r for r in result(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[4, 60_000][2] == 30_000 and got[4, 60_000][3].count("\n") == 29_999
    assert got[7, 1] == (7, 1, 0, rows[7][1]) and got[0, 1][2:] == (1, "")
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_levels_hold_disjoint_runs(spark):
    runs = line_runs.LineRuns(spark, fan=2)
    try:
        for k in range(5):
            runs.add(spark.createDataFrame([(h, h, 100 - k) for h in range(k * 10, k * 10 + 25)] * 2, "h1 long, h2 long, id long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        met = [r["h1"] for t in runs._all(0) for r in t.collect()]
        assert len(met) == len(set(met)) == 65
        assert {r["h1"]: r["keeper"] for r in runs.frequent(3).collect()} == {h: 100 - (h - 20) // 10 for h in range(20, 45) if h % 10 < 5}  # the others are in two batches
    finally:
        runs.drop()
    assert not runs.paths
