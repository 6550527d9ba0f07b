"""Operators on texts against brute force: records, exact dedup, ranking, BPE, shards, repeats, fingerprints."""

from __future__ import annotations

import hashlib
import math
import random
import string
import struct
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftstone.llm import bpe_dp, content_dedup, html_main, quality_rank, queries, rendezvous, simhash_cover, substring_trees, token_records

from ..conftest import DATA

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, batch string, fp string, key string, i int, t int"


def table(spark, rows):
    """Documents of (id, text), with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, "b", "f", "k", 1, 1) for i, t in rows], SCHEMA)


ODD = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "SAME TEXT"), (None, "same text"), (6, "É same"), (7, "é same"), (8, "x " * 3000), (8, "x " * 3000), (9, " \n\t ")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


# --- token records -------------------------------------------------------------------


def test_records_round_trip(spark, pairs, tmp_path):
    got = queries.op1_token_records(spark, DATA).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(WORD_BPE), 0
    for r, (i, t) in zip(got, sorted(pairs), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_of_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/data"
    token_records.write_records(table(spark, ODD), path, WORD_BPE)
    index = token_records.write_index(spark, path, f"file://{tmp_path}/index")
    rows = index.orderBy("start").collect()
    assert [r["id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert [r["n_tokens"] for r in rows if r["id"] in (3, 4, 9)] == [1, 1, 1]
    read = token_records.read_shuffled(spark, path, index, seed=4).collect()
    assert Counter((r["id"], len(r["ids"])) for r in read) == Counter((r["id"], r["n_tokens"]) for r in rows)
    assert len({r["position"] for r in read}) == len(read)


def test_records_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_records.write_records(table(spark, []), path, WORD_BPE)
    assert token_records.write_index(spark, path, f"file://{tmp_path}/index").count() == 0


def test_files_of_a_range_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "BLOCK", 400)
    monkeypatch.setattr(token_records, "FILE_BLOCKS", 2)
    rows = [(k, f"text {k} " * 20) for k in range(400)] + [(401, "long text " * 200_000), (None, "x"), (None, "x")]
    path = f"file://{tmp_path}/data"
    token_records.write_records(table(spark, rows), path, WORD_BPE)
    index = token_records.write_index(spark, path, f"file://{tmp_path}/index").collect()
    assert len({r["file"] for r in index}) > 50
    start = 0
    for r in sorted(index, key=lambda r: (r["id"] is not None, r["id"] or 0)):
        assert r["start"] == start or r["id"] is None
        start += r["n_tokens"]
    assert max(r["n_tokens"] for r in index) == 400_001


def test_damaged_records_are_noticed():
    data = bytearray(token_records.frame(np.arange(5, dtype=np.uint32), 7))
    assert token_records.parsed(token_records.payload_at(bytes(data), 0))[0] == 7
    for at in (0, 14):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(token_records.CorruptRecord):
            token_records.payload_at(bytes(bad), 0)


def test_word_encoder_equals_the_library():
    random.seed(2)
    parts = ["a", "B", "é", "İ", "Σ", "ß", "́", "日", "😀", "'s", "'LL", "12", "½", "<|endoftext|>", "\xa0", " ", "  ", "\n", "\x1c", "\x85", ".", "_", "ﬁ"]
    texts = ["", " ", "a" * 3000] + ["".join(random.choices(parts, k=random.randint(1, 25))) for _ in range(800)]
    library = Tokenizer.from_file(WORD_BPE)
    for t, ids in zip(texts, token_records.WordEncoder(WORD_BPE).encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


# --- exact dedup ---------------------------------------------------------------------


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    copies = [(100 + k, "Hot Copy" if k % 2 else "hot copy") for k in range(400)] + [(1000 + k, f"own {k}") for k in range(300)]
    rows = ODD + copies
    got = content_dedup.exact_groups(table(spark, rows), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dropping_copies_keeps_columns(spark):
    df = table(spark, ODD)
    got = content_dedup.drop_exact_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 6, 7, 8, 9]
    assert content_dedup.drop_exact_copies(table(spark, [])).count() == 0


# --- ranking -------------------------------------------------------------------------


def test_ranker_on_held_out_rows(spark):
    got = queries.op3_quality_rank(spark, DATA.replace("0.001", "0.1"))
    labels = spark.read.parquet(DATA.replace("0.001", "0.1") + "/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.95


def test_preference_pairs_recover_an_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    truth = x @ np.array([2.0, -1.0, 0.5, 0, 0])
    a, b = rng.integers(0, 400, 3000), rng.integers(0, 400, 3000)
    first = rng.random(3000) < 1 / (1 + np.exp(truth[b] - truth[a]))
    mean, scale, w = quality_rank.fit_pairs(x, np.where(first, a, b), np.where(first, b, a))
    assert np.corrcoef((x - mean) / scale @ w, truth)[0, 1] > 0.98


def test_all_pairs_are_what_the_pairs_give(monkeypatch):
    rng = np.random.default_rng(2)
    x, good = rng.standard_normal((90, 6)), rng.random(90) < 0.4
    x[good] += 0.5
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    monkeypatch.setattr(quality_rank, "TILE", 7)
    _, _, w = quality_rank.fit_all(x, ups, downs)
    _, _, pairs = quality_rank.fit_pairs(x, np.repeat(ups, len(downs)), np.tile(downs, len(ups)))
    assert w == pytest.approx(pairs, abs=1e-9)


def test_text_identifiers_and_a_very_long_text(spark):
    rows = [(f"d{k}", "Good words, and fine ones. " * 3 if k % 2 else "### $$$ ###") for k in range(40)] + [("long", "Good words, and fine ones. " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    ranker = quality_rank.train(docs, spark.createDataFrame([(f"d{k}", k % 2) for k in range(30)], "doc_id string, quality int"))
    got = {r["doc_id"]: r["predicted"] for r in quality_rank.score(docs, ranker).collect()}
    assert all(got[f"d{k}"] == k % 2 for k in range(40)) and got["long"] == 1


def plain_features(text):
    """The features, told in words and characters one by one."""
    data = (text or "").encode()
    kinds = [0] * (6 + len(quality_rank.SINGLE))
    for b in data:
        c = chr(b)
        at = quality_rank.SINGLE.find(b)
        kinds[6 + at if at >= 0 else 1 if c == " " else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 5 if b > 127 else 0] += 1
    out = [math.sqrt(k / len(data)) if data else 0.0 for k in kinds]
    words = data.split()
    if not words:
        return out + [0.0] * 8
    n, same = len(words), sum(words[k] == words[k + 1] for k in range(len(words) - 1))
    upper, letters = sum(65 <= b <= 90 for b in data), sum(65 <= b <= 90 or 97 <= b <= 122 for b in data)
    marks = sum(b < 127 and chr(b) in string.punctuation for b in data)
    return out + [same / n, math.sqrt(same / n), upper / max(letters, 1), marks / len(data), min(marks / n, 4.0), math.log1p(len(data) / n), len(set(words)) / n, math.log1p(n) / 10]


def test_features_and_scores_against_plain_code(spark, pairs):
    for _, t in pairs[:60] + [(0, None), (0, ""), (0, " \n"), (0, "É x É x"), (0, "word " * 50_000)]:
        assert quality_rank.features(t) == pytest.approx(plain_features(t), abs=1e-12)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    texts = dict(pairs)
    learn = sorted(i for i, y in labels.items() if y is not None and i in texts and zlib.crc32(str(i).encode()) % 5)
    x = np.array([plain_features(texts[i]) for i in learn])
    y = np.array([labels[i] for i in learn])
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = (x - mean) / scale
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(3000):  # plain gradient ascent with growing steps on the penalised likelihood
        p = 1 / (1 + np.exp(d @ w))
        w += 0.5 * (d.T @ p / len(d) - quality_rank.RIDGE * w)
    raw = z @ w
    cut = np.sort(raw)[[(y == 0).sum() - 1, (y == 0).sum()]].mean()
    got = {r["doc_id"]: r for r in queries.op3_quality_rank(spark, DATA).collect()}
    for i, t in pairs:
        r = got[i]
        own = ((np.array(plain_features(t)) - mean) / scale) @ w - cut + math.log(0.3 / 0.7)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        if abs(own - math.log(0.3 / 0.7)) > 1.5:  # the gradient hasn't fully settled
            assert r["predicted"] == int(own > math.log(0.3 / 0.7))


def test_repeated_identifiers_teach_once(spark):
    rows = [(1, "good text, fine.")] * 3 + [(1, "other"), (2, "#### $$$$"), (2, "#### $$$$")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    ranker = quality_rank.train(table(spark, rows), labels)
    assert ranker.threshold == 0.0 and not ranker.weights.any()  # the least labels of both are 0: nothing to learn


def test_ranking_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    ranker = quality_rank.train(table(spark, ODD), labels)
    got = quality_rank.score(table(spark, ODD), ranker).collect()
    assert len(got) == len(ODD) and {round(r["score"], 9) for r in got} == {quality_rank.ACCEPTED} and {r["predicted"] for r in got} == {1}
    assert quality_rank.score(table(spark, []), ranker).count() == 0
    kept = quality_rank.score(table(spark, ODD), ranker, keep_columns=True)
    assert kept.select("row.*").columns == table(spark, []).columns


# --- BPE -----------------------------------------------------------------------------


def test_bpe_equals_the_library(pairs):
    random.seed(7)
    parts = list("abth eisno\n'sT.,1é ß") + ["  ", "\t", "日本", "😀", "<|endoftext|>", "́", "aaaa", "\x85", "\x1c", "don't"]
    texts = [t or "" for _, t in pairs] + ["", " ", "a" * 2000] + ["".join(random.choices(parts, k=random.randint(1, 50))) for _ in range(1500)]
    library, bpe = Tokenizer.from_file(BYTE_BPE), bpe_dp.PrefixBpe(BYTE_BPE)
    for t, packed in zip(texts, bpe.encode_many(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert array("I", packed).tolist() == ids
        assert bpe.decode(packed) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_of_odd_rows(spark):
    got = bpe_dp.encode_decode(table(spark, ODD), BYTE_BPE).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in got) == Counter((i, t or "") for i, t in ODD)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] for r in got)
    assert bpe_dp.encode_decode(table(spark, []), BYTE_BPE).count() == 0


# --- HTML ----------------------------------------------------------------------------

PAGE = """<html><head><title>x</title><script>var a = "<p>no</p>"</script></head><body><header class="site-header"><p>A tagline, of some length, with commas.</p></header>
<div id="nav"><a href=/>Home</a></div><div class="layout with-sidebar"><div class="sidebar"><p>Side text, with commas, many, many, and long enough to be scored.</p></div>
<div class="post-content"><h1>Title &amp; more</h1><p>First paragraph, with commas, and   enough
 text to score, so that it wins.</p><div class="ad">Buy, buy, buy, this thing now.</div><p>Second &lt;b&gt; paragraph&nbsp;here, also long, with commas, and so on.</p><ul><li>item one<li>item two</ul><p>Short.</p></div>
<div class="comments"><p>I think, that this, is a great, long comment, and I have much, much to say.</p></div></div><form><p>Enter</p></form><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE).split("\n") == [
        "Title & more", "First paragraph, with commas, and enough text to score, so that it wins.", "Second <b> paragraph here, also long, with commas, and so on.", "item one", "item two", "Short.",
    ]
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<script>x</script>") == ""
    assert html_main.main_text("plain &eacute;") == "plain é" and html_main.main_text("<p>a<p>b") == "a\nb"
    assert len(html_main.main_text("<article>" + "<p>word, word</p>" * 20_000)) == 20_000 * 11 - 1


def test_links_in_the_article_stay():
    page = "<body><nav><a href=/>home</a></nav><article><h1>Works</h1><p>These works, listed here, are what this page is about.</p><h2>Sources</h2><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></article></body>"
    assert html_main.main_text(page).split("\n") == ["Works", "These works, listed here, are what this page is about.", "Sources", "One", "Two"]


@pytest.mark.parametrize(
    "page",
    [
        "<p>x</p>" + "<span>" * 150_000 + "</i>" * 150_000,
        '<article><p>hello, world, x</p><a href="' + "x<b>" * 300_000,
        "<a '>' " * 200_000,
        "<a " * 500_000,
        "<blockquote>long, enough, text to be scored here, so" * 40_000,
        "<div>" * 50_000 + "<li>a" * 50_000,
        "<i><div>" + "<span>" * 100_000 + "</i>" * 100_000,
        "<p>text, text, text, that is long enough" * 50_000,
        "<!" * 500_000,
    ],
)
def test_long_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_main.main_text(page)
    whole = time.process_time() - began
    assert len(page) >= 500_000 and whole < 30  # a quadratic parser takes many minutes


LONG = "This is a sentence of the article, which is long enough, and it has commas. It goes on with more, and with more."


@pytest.mark.parametrize(
    "part",
    ['<div class="share-price">{}</div>', '<section id="form-factor"><p>{}</p></section>', '<div class="related-work"><p>{}</p></div>', '<div class="entry-header"><h1>{}</h1></div>', '<p class="footer">{}</p>', '<div class="social"><p>{}</p></div>'],
)
@pytest.mark.parametrize("frame", ["article", "main"])
def test_names_alone_drop_nothing_of_an_article(part, frame):
    own = "The price of a share rose, says the report, and it will rise again. Nobody knows why."
    page = f"<body><nav>menu</nav><{frame}><p>{LONG}</p>{part.format(own)}<p>{LONG}</p></{frame}></body>"
    assert html_main.main_text(page).split("\n") == [LONG, own, LONG]


@pytest.mark.parametrize(
    "part",
    ['<div class="ad">Buy now, and pay later. It is cheap!</div>', '<div class="share-links"><a href="x">Tell others</a> <a href="y">Send it</a></div>', '<section id="comments"><p>I like it, really. So do I.</p></section>', '<div class="related"><a href="a">One more</a></div>', '<div class="cookie-notice"><p>We use cookies. Fine.</p></div>', "<footer>Written by us.</footer>"],
)
def test_asides_inside_an_article_go(part):
    assert html_main.main_text(f"<body><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body>").split("\n") == [LONG, LONG]


def test_articles_beside_the_best_stay():
    first, second = LONG + " One.", LONG + " Two."
    page = f"<body><main><article><p>{first}</p><p>{first}</p></article><article><p>{second}</p></article><article><a href='x'>A teaser with a link</a></article></main></body>"
    assert html_main.main_text(page).split("\n") == [first, first, second]


def test_main_text_of_pages(spark):
    import html
    import re

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op5_html_main(spark, DATA).collect():
        inner = re.search(r"<article>(.*)</article>", rows[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "u", None, 1), (1, None, "<p>x</p>", 1), (1, None, "<p>x</p>", 1)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_main.extract(df).collect()), key=repr) == [(1, None, "x", 1), (1, None, "x", 1), (None, "u", "", 0)]
    assert html_main.extract(df.limit(0)).count() == 0


# --- shards --------------------------------------------------------------------------


def test_shards_and_slots(spark, pairs):
    got = queries.op6_rendezvous_shards(spark, DATA).collect()
    texts = dict(pairs)
    assert len(got) == len(pairs)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_shards_against_plain_bids(spark):
    """Every bid of every shard computed again outside Spark."""
    import xxhash

    def bid(key, shard, weight):
        held = xxhash.xxh64_intdigest(struct.pack("<q", key), xxhash.xxh64_intdigest(struct.pack("<i", rendezvous.SEED), 42))
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<q", held - (1 << 64) if held >> 63 else held), 42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    weights, grown = (1.0, 2.0, 0.5, 1.0), (1.0, 2.0, 0.5, 1.0, 3.0)
    for r in rendezvous.assign_shards(spark.range(500).withColumnRenamed("id", "doc_id"), weights=weights, grown_weights=grown).collect():
        for w, found in ((weights, r["shard"]), (grown, r["grown_shard"])):
            assert found == min(range(len(w)), key=lambda k: bid(r["doc_id"], k, w[k]))


def test_weighted_shards(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = rendezvous.assign_shards(rows, weights=(1, 2, 0, 1), grown_weights=(1, 2, 0, 1, 4))
    n = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] - 10_000) < 400 and abs(n[0] - 5_000) < 400
    assert got.filter("grown_shard <> shard and grown_shard <> 4").count() == 0
    with pytest.raises(ValueError):
        rendezvous.winner(F.lit(1), (0, 0))


def test_shards_of_odd_rows(spark):
    df = table(spark, ODD + [(None, None)]).withColumn("shard", F.lit("old"))
    got = rendezvous.assign_slots(rendezvous.assign_shards(df), "shard", ["doc_id", "text"]).collect()
    assert len(got) == len(ODD) + 1 and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert rendezvous.assign_slots(rendezvous.assign_shards(table(spark, [])), "shard", ["doc_id"]).count() == 0


# --- repeated passages ---------------------------------------------------------------


def removed(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_on_documents(spark, pairs):
    got = queries.op7_substring_trees(spark, DATA)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == removed(pairs, 35)


@pytest.mark.parametrize(("window", "gram", "long", "together"), [(5, 2, 2000, 1024), (4, 4, 2000, 1), (6, 3, 3, 2), (5, 3, 2, 1)])
def test_repeats_of_small_alphabets(spark, monkeypatch, window, gram, long, together):
    monkeypatch.setattr(substring_trees, "LONG_FROM", long)
    monkeypatch.setattr(substring_trees, "TOGETHER", together)
    monkeypatch.setattr(substring_trees, "GROUP", 50)
    monkeypatch.setattr(substring_trees, "BATCH", 2000)
    random.seed(window)
    rows = [(k, " ".join(random.choices("a b c dd e".split(), k=random.randint(0, 40)))) for k in range(60)] + ODD + [(900, "q " * 50)]
    got = substring_trees.remove_repeats(table(spark, rows), window=window, gram=gram)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == removed(rows, window)
    for r in got.collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(x["stop"] - x["start"] for x in r["repeats"]) == r["n_removed"]


def test_repeats_of_nothing(spark):
    assert substring_trees.remove_repeats(table(spark, [])).count() == 0
    assert not spark.sql("SHOW TABLES").filter("tableName LIKE 'siftstone_%'").count()


def test_repeats_of_short_texts(spark):
    rows = [(k, " ".join(["word"] * (k % 35))) for k in range(40)] + [(90, None), (None, "")]
    got = substring_trees.remove_repeats(table(spark, rows))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == removed(rows, 35)


def test_a_passage_in_every_batch_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring_trees, "BATCH", 4000)
    monkeypatch.setattr(substring_trees, "TOGETHER", 3)
    monkeypatch.setattr(substring_trees, "LONG_FROM", 20)
    random.seed(8)
    passage = " ".join(f"p{k}" for k in range(50))
    own = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{own(30)} {passage} {own(30)}") for k in range(150)] + [(500, own(200_000) + " " + passage)]
    got = {r["doc_id"]: r for r in substring_trees.remove_repeats(table(spark, rows)).collect()}
    assert all(got[k]["n_removed"] == 50 and "p7" not in got[k]["kept"] for k, _ in rows)
    assert [tuple(x) for x in got[500]["repeats"]] == [(200_000, 200_050)] and [tuple(x) for x in got[3]["repeats"]] == [(30, 80)]


def test_subtree_is_a_suffix_tree():
    """Suffix array, common prefixes and nodes against sorted suffixes."""
    random.seed(2)
    segments = [" ".join(random.choices("a b c".split(), k=random.randint(9, 30))).encode() for _ in range(12)]
    counts = np.array([s.count(b" ") + 2 - 7 for s in segments])
    tree = substring_trees.Subtree(segments, counts, 7)
    suffixes = [tuple(s.split(b" ")[k : k + 7]) for s, n in zip(segments, counts.tolist(), strict=True) for k in range(n)]
    assert [suffixes[k] for k in tree.order.tolist()] == sorted(suffixes)
    for k, n in enumerate(tree.common.tolist()):
        a, b = suffixes[tree.order[k]], suffixes[tree.order[k + 1]]
        assert n == next((i for i in range(7) if a[i] != b[i]), 7)
    for depth in (1, 3, 7):
        under = [suffixes[k][:depth] for k in tree.order.tolist()]
        groups = [[k for k, x in enumerate(under) if x == g] for g in dict.fromkeys(under)]
        assert [(g[0], g[-1]) for g in groups if len(g) > 1] == list(zip(*(x.tolist() for x in tree.nodes(depth)), strict=True))


# --- fingerprints --------------------------------------------------------------------


def components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(fps))]


def test_masks_cover_every_pair():
    from itertools import combinations

    for radius in (1, 2, 3):
        kept = simhash_cover.masks(radius)
        assert len(kept) == 2 ** (radius + 1) - 1
        for some in combinations(range(0, 64, 3), radius):
            assert any(not any(m >> i & 1 for i in some) for m in kept)


@pytest.mark.parametrize("radius", [1, 2, 4, 5, 6, 7])
def test_masks_keep_about_half_of_the_bits(radius):
    kept = simhash_cover.masks(radius)
    assert len(set(kept)) == 2 ** (radius + 1) - 1
    assert all(16 <= m.bit_count() <= 48 for m in kept)


def test_near_groups_on_documents(spark, pairs):
    rows = sorted(pairs)
    fps = [simhash_cover.fingerprint(t, 3) for _, t in rows]
    roots = components(fps, 2)
    want = [(i, f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, roots, strict=True)]
    assert sorted(map(tuple, queries.op8_simhash_cover(spark, DATA).collect())) == want


@pytest.mark.parametrize("hot", [512, 3])
def test_links_of_crowded_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_cover, "HOT_BUCKET", hot)
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 5))) for b in base for _ in range(60)})
    nodes = spark.createDataFrame([(simhash_cover.signed(f),) for f in fps], "fp long")
    from siftstone.llm.components import least_reachable

    found = {r["node"]: r["root"] for r in least_reachable(simhash_cover.links(nodes, 2)).collect()}
    groups = defaultdict(set)
    for f in fps:
        s = simhash_cover.signed(f)
        groups[found.get(s, s)].add(f)
    want = defaultdict(set)
    for f, r in zip(fps, components(fps, 2), strict=True):
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_groups_of_odd_rows(spark):
    got = simhash_cover.near_groups(table(spark, ODD)).collect()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert len(got) == len(ODD) and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 9)} == {"0" * 16}
    assert {v for (i, _), v in by.items() if i in (3, 4, 9)} == {3} and {v for (i, _), v in by.items() if i in (1, 2, 5, None)} == {1}
    assert simhash_cover.near_groups(table(spark, [])).count() == 0
