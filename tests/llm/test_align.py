"""Alignment of two tokenizers against the libraries' own tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftstone.llm import queries, token_align
from siftstone.llm.token_align import EMPTY, Fragment

from ..conftest import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """Ids and bytes, told apart by decoding: A's token by token, B's by piece."""
    a, b = libraries()
    letters = token_align._byte_letters()
    enc = a.encode(" " + text, add_special_tokens=False)
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
    return enc.ids, [bytes(letters[c] for c in t) for t in enc.tokens], ids, raw


def brute(rows):
    per, counts = [], Counter()
    for i, t in rows:
        a, a_raw, b, b_raw = tokens(t) if t else ([], [], [], [])
        if not t or b"".join(a_raw) != (" " + t).encode() or b"".join(b_raw) != (" " + t).encode():
            per.append((i, None))
            continue
        ends = [{end: k for k, end in enumerate(np.cumsum([len(x) for x in raw]).tolist())} for raw in (a_raw, b_raw)]
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0][end], ends[1][end]
            groups.append(f"{','.join(map(str, a[x : p + 1]))}|{','.join(map(str, b[y : q + 1]))}")
            links.append((a[p], b[q]))
            x, y = p + 1, q + 1
        counts.update(links)
        per.append((i, (len(a), len(b), groups, links)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (i, 0, 0, 0, 0, 0, 0, "")
        if r is None
        else (i, r[0], r[1], len(r[2]), len(r[3]), sum(counts[k] == most[k[1]] for k in r[3]), sum(counts[k] for k in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
        for i, r in per
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op13_token_alignment(spark, DATA)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in COLUMNS}
    assert result(got) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("size", [token_align.RANGE, 1000])
def test_odd_texts(spark, size):
    rng = random.Random(size)
    rows = [(1, "漢字仮名交じり文" * 3000), (2, "many words " * 8000), (3, None), (4, ""), (5, "a▁b"), (6, "x " * 9000 + "▁ y " * 900), (None, "no id"), (8, " " * 20000), (9, "\x00"), (10, "é ﬁ　Ａ")]
    rows += [(7, "<|endoftext|> <s> <0x41>")] * 2 + [(11, "".join(rng.choice("qwertyuiopé") for _ in range(30000)))]
    rows += [(100 + k, "".join(rng.choice("abé漢  \n\t.'s 　☃A1_▁" if k % 7 == 0 else "abé漢  \n\t.'s 　☃A1_") for _ in range(rng.randint(1, 300)))) for k in range(200)]
    df = spark.createDataFrame([(i, t, 5, "l") for i, t in rows], "doc_id long, text string, block int, links string")
    assert result(token_align.align(df, A, B, size=size)) == sorted(brute(rows), key=str)


def test_text_identifiers_and_nothing(spark):
    rows = [("a", "one text"), ("b", "one text, another")]
    assert result(token_align.align(spark.createDataFrame(rows, "doc_id string, text string"), A, B)) == sorted(brute(rows), key=str)
    assert result(token_align.align(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def cuts(n, inner):
    """End offsets of tokens that cover n bytes."""
    return np.array(sorted({x % n for x in inner if x % n} | {n}))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(0, 1000), max_size=30), st.lists(st.integers(0, 1000), max_size=30), st.integers(1, 70), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_order(n, inner_a, inner_b, size, rnd):
    a_end, b_end = cuts(n, inner_a), cuts(n, inner_b)
    a, b = np.arange(len(a_end)), np.arange(100, 100 + len(b_end))
    ((_, whole, links, _, _),) = token_align.fragments(a, a_end, b, b_end, n)
    parts = token_align.fragments(a, a_end, b, b_end, size)
    assert sum(len(p[2]) for p in parts) == len(links) == whole.groups + 1
    assert [sum(p[k] for p in parts) for k in (3, 4)] == [len(a), len(b)]
    f: list[Fragment] = [p[1] for p in parts]
    while len(f) > 1:
        k = rnd.randrange(len(f) - 1)
        f[k : k + 2] = [f[k] + f[k + 1]]
    assert f[0] == whole and not whole.tail_a and not whole.tail_b
    assert EMPTY + whole == whole == whole + EMPTY
    ends = sorted(set(a_end) & set(b_end))
    assert whole.written().count(";") == len(ends) - 1
