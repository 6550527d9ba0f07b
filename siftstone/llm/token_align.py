"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space
itself.  Byte offsets where tokens of both end cut the tokens into groups; the last A and B
tokens of a group end together, and each such occurrence is a link.

*Fragments.*  A range of a text's bytes yields a :class:`Fragment`: the tokens up to the first
common end (its group may have begun before the range), the closed groups, and the tokens
after the last common end.  Fragments compose associatively: the open end of the left one and
the open beginning of the right one make one group.  So the ranges of a very long text are
encoded in different tasks and put together in a tree, ``FAN`` by ``FAN``.

*Where a text may be cut.*  A single space between two other characters begins a token of both
tokenizers: A's pattern attaches the space to what follows, and no piece of B's vocabulary
has the space mark after another character (checked when it is loaded), so that no merge
reaches over it.  What stands between two such spaces is a *unit*; the encoding of a text is
that of its units one after the other.  Units repeat, so a task keeps what it knows of short
ones.  A unit that is longer than a range (a text without spaces) is encoded whole, and its
tokens are dealt to the ranges in which they end.

*Counts.*  How often a pair of ids is linked in the corpus is summed after each block of
rows has counted its own.  Each block then gets the counts of its own pairs, once each, and
the rows of a block are rated together with them; neither table is ever whole in one place.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_dp import SPLIT
from .common import give_back, written

#: Bytes of a range; shorter texts are one fragment.
RANGE = 1 << 16
#: Fragments that are put together at once, about.
FAN = 16
#: Units that a worker keeps, and the characters of the longest of them.
KEPT_UNITS, KEPT_LENGTH = 300_000, 48
#: Characters up to which the quick encoder takes a text.
QUICK = 1 << 16
#: Links of a block of rows.
BLOCK = 2_000_000
#: Rows that are held together.
ROWS = 256

#: The places where a text may be cut (before the space).
_CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


class Fragment(NamedTuple):
    """Tokens of a byte range.  Without a common end in it (``cut``), all are in ``head``."""

    cut: bool
    head_a: list[int]
    head_b: list[int]
    #: The closed groups, written out, and their number.
    body: str
    groups: int
    tail_a: list[int]
    tail_b: list[int]

    def __add__(self, right: Fragment) -> Fragment:  # type: ignore[override]
        if not self.cut and not right.cut:
            return Fragment(False, self.head_a + right.head_a, self.head_b + right.head_b, "", 0, [], [])
        if not self.cut:
            return right._replace(head_a=self.head_a + right.head_a, head_b=self.head_b + right.head_b)
        if not right.cut:
            return self._replace(tail_a=self.tail_a + right.head_a, tail_b=self.tail_b + right.head_b)
        parts = [p for p in (self.body, _group(self.tail_a + right.head_a, self.tail_b + right.head_b), right.body) if p]
        return Fragment(True, self.head_a, self.head_b, ";".join(parts), self.groups + 1 + right.groups, right.tail_a, right.tail_b)

    def written(self) -> str:
        """All groups of a whole text."""
        return ";".join(p for p in (_group(self.head_a, self.head_b), self.body) if p)


EMPTY = Fragment(False, [], [], "", 0, [], [])


def _group(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def fragments(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, size: int) -> list[tuple[int, Fragment, np.ndarray, int, int]]:
    """Tokens with their end offsets, cut into ranges of ``size`` bytes.

    For each range that has tokens: its number, fragment, links (rows of two ids), and numbers
    of A and B tokens.
    """
    out = []
    for k in range(int(max(a_end[-1:].max(initial=0), b_end[-1:].max(initial=0)) - 1) // size + 1):
        i, j = (slice(*np.searchsorted(e, [k * size, (k + 1) * size], "right")) for e in (a_end, b_end))
        ra, rb = a[i].tolist(), b[j].tolist()
        if not ra and not rb:
            continue
        ends, at_a, at_b = np.intersect1d(a_end[i], b_end[j], assume_unique=True, return_indices=True)
        if not len(ends):
            out.append((k, Fragment(False, ra, rb, "", 0, [], []), np.empty((0, 2), int), len(ra), len(rb)))
            continue
        cuts = list(zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True))
        body = [_group(ra[x:x2], rb[y:y2]) for (x, y), (x2, y2) in zip(cuts, cuts[1:], strict=False)]
        (x, y), (x2, y2) = cuts[0], cuts[-1]
        links = np.column_stack([a[i][at_a], b[j][at_b]])
        out.append((k, Fragment(True, ra[:x], rb[:y], ";".join(body), len(body), ra[x2:], rb[y2:]), links, len(ra), len(rb)))
    return out


class Unit(NamedTuple):
    sound: bool
    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


UNSOUND = Unit(False, 0, 0, 0, "", b"")


class Aligner:
    """Both tokenizers, and the units that were met."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.quick = _by_ranks(a_path, byte)
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        #: Ids as they are written before a comma, the bar or the end of a group.
        self.names = [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;"]
        #: A pair of ids is one number.
        self.pairs = len(self.b_bytes)
        self.code = "<u4" if len(self.a_bytes) * self.pairs <= 1 << 32 else "<u8"
        self.known: dict[str, Unit] = {}
        self.passing: list[str] = []

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def tokens(self, text: str) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether both encodings give the text's bytes, and the ids."""
        spaced = " " + text
        if self.quick and len(text) <= QUICK:
            a = self.quick.encode_ordinary(spaced)
        else:
            a = self.a.encode(spaced, add_special_tokens=False).ids
        b, raw = self.b.encode(text), spaced.encode()
        sound = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return sound, np.array(a, np.int64), np.array(b, np.int64)

    def cut_tokens(self, a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, Fragment, bytes, int, int]]:
        cut = fragments(a, self.a_size[a].cumsum(), b, self.b_size[b].cumsum(), size)
        return [(k, f, self.packed(links[:, 0], links[:, 1]), n_a, n_b) for k, f, links, n_a, n_b in cut]

    def packed(self, a: np.ndarray, b: np.ndarray) -> bytes:
        return (a * self.pairs + b).astype(self.code).tobytes()

    def _joined(self, units: list[str]) -> list[Unit]:
        """What is to know of units that may stand side by side; they are encoded at once."""
        sound, a, b = self.tokens(" ".join(units))
        if not sound:
            return [UNSOUND] if len(units) == 1 else [self._joined([u])[0] for u in units]
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        ends, last_a, last_b = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        # Tokens in the order in which they are written: for each group A's, then B's.
        to_a, to_b = last_a + 1, last_b + 1
        of_a, of_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        names = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.concatenate([[0], to_b])[of_a]
        at_b = np.arange(len(b)) + to_a[of_b]
        names[at_a], names[at_b] = a * 3, b * 3
        names[at_a[last_a]] += 1
        names[at_b[last_b]] += 2
        parts = list(map(self.names.__getitem__, names.tolist()))
        links, width = self.packed(a[last_a], b[last_b]), np.dtype(self.code).itemsize
        groups = np.searchsorted(ends, np.cumsum([len(u.encode()) + 1 for u in units])) + 1
        out, x, y, g = [], 0, 0, 0
        for x2, y2, g2 in zip(to_a[groups - 1].tolist(), to_b[groups - 1].tolist(), groups.tolist(), strict=True):
            out.append(Unit(True, x2 - x, y2 - y, g2 - g, "".join(parts[x + y : x2 + y2])[:-1], links[g * width : g2 * width]))
            x, y, g = x2, y2, g2
        return out

    def learn(self, units: list[list[str]]) -> dict[str, Unit]:
        """What is known of units, these among them."""
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        for u in self.passing:
            self.known.pop(u, None)
        new = [u for u in set().union(*units) if u not in self.known]
        self.passing = [u for u in new if len(u) > KEPT_LENGTH]
        run, held = [], 0
        for u in new:
            if u.strip() != u or not u:  # white space at an end would touch the next one
                self.known[u] = self._joined([u])[0]
                continue
            run.append(u)
            held += len(u) + 1
            if held > QUICK // 2:
                self.known.update(zip(run, self._joined(run), strict=True))
                run, held = [], 0
        if run:
            self.known.update(zip(run, self._joined(run), strict=True))
        return self.known


def _by_ranks(path: str, byte: dict[str, int]):
    """A quicker encoder with the same ids, where the merges are numbered as the tokens they make."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [vocabulary.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class _Blocks:
    """Numbers blocks of rows; no two tasks share one."""

    def __init__(self) -> None:
        self.block, self.links = TaskContext.get().partitionId() << 32, 0

    def of(self, links: int) -> int:
        if self.links + links > BLOCK:
            self.block, self.links = self.block + 1, 0
        self.links += links
        return self.block


#: One row for each fragment; ``uid`` (null for texts of one fragment) tells long texts apart.
_LEAF = T.StructType(
    [
        T.StructField(n, t())
        for n, t in [
            *[(n, T.LongType) for n in ("uid", "start", "block")],
            ("sound", T.BooleanType),
            *[(n, T.LongType) for n in ("n_a", "n_b", "n_groups", "n_links")],
            ("links", T.BinaryType),
            ("groups_sha256", T.StringType),
            ("cut", T.BooleanType),
        ]
    ]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("head_a", "head_b")]
    + [T.StructField("body", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("tail_a", "tail_b")]
)
_FRAGMENT = ["cut", "head_a", "head_b", "body", "n_groups", "tail_a", "tail_b"]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """For each row of ``df``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    ``n_best`` counts the links whose pair is as frequent in the corpus as any pair with the
    same B id; ``count_sum`` sums the pairs' counts over the links.  A null or empty text, and
    one that either tokenizer doesn't give back byte for byte, has no tokens: zeros and an
    empty digest, and no part in any count.  Each row stands for itself, whatever its
    identifier: null, repeated and fully repeated ones count once for each row.  An empty table
    gives an empty result.  Other columns are not read, whatever their names.  Texts above ``size``
    bytes are cut into ranges of about that size.

    ``df`` is read twice and must give its rows in the same order if a task is repeated, as
    tables do.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([narrow.schema["id"], *_LEAF.fields])
    arrow = _arrow(schema)
    sized = F.coalesce(F.octet_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, blocks = _aligner(a_path, b_path), _Blocks()
        for batch in batches:
            for part in _pieces(batch):
                yield pa.RecordBatch.from_pylist(list(_short_rows(al, blocks, part)), arrow)
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, out = _aligner(a_path, b_path), _arrow(pieces)
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                for part in _grouped(_segments(al, row["text"], size), ROWS):
                    yield pa.RecordBatch.from_pylist([{"id": row["id"], "uid": row["uid"], "start": s, "text": t} for s, t in part], out)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, blocks = _aligner(a_path, b_path), _Blocks()
        for batch in batches:
            for part in _pieces(batch):
                for rows in _grouped(_long_rows(al, blocks, part, size), ROWS):
                    yield pa.RecordBatch.from_pylist(rows, arrow)
        give_back()

    pieces = T.StructType([narrow.schema["id"], T.StructField("uid", T.LongType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType())])
    lengthy = narrow.withColumn("uid", F.monotonically_increasing_id()).filter(sized > size)
    dealt = lengthy.mapInArrow(cut, pieces).repartition("uid", "start")
    leaves = narrow.filter(sized <= size).mapInArrow(short, schema).unionByName(dealt.mapInArrow(long, schema))
    leaves = written(leaves, "aligned")
    of_long = leaves.filter("uid IS NOT NULL")
    unsound = of_long.filter("NOT sound").select("uid").distinct()
    sound = of_long.join(unsound, "uid", "left_anti").select(*schema.names)
    rated = _rated(leaves.filter("uid IS NULL").unionByName(sound), _aligner(a_path, b_path).code, _aligner(a_path, b_path).pairs)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    # Of long texts: sums, and one fragment composed of all.
    sums = rated.filter("uid IS NOT NULL").groupBy("uid").agg(*[F.sum(c).alias(c) for c in numbers if c != "n_groups"])
    whole = _composed(sound.select("uid", "start", *_FRAGMENT), size)
    ids = of_long.filter("start = 0").select("id", "uid")
    wide = ids.join(sums, "uid", "left").join(whole, "uid", "left")
    out = rated.filter("uid IS NULL").select("id", *numbers, "groups_sha256")
    out = out.unionByName(wide.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return out.withColumnRenamed("id", id_col)


def _short_rows(al: Aligner, blocks: _Blocks, part: pa.RecordBatch) -> Iterator[dict]:
    texts = part.column("text").to_pylist()
    split = [al.units(t) if t else [] for t in texts]
    known = al.learn(split) if split else {}
    for id_, units in zip(part.column("id").to_pylist(), split, strict=True):
        got = list(map(known.__getitem__, units))
        sound, n_a, n_b, n_groups, groups, links = zip(*got, strict=True) if got else [[False]] + [[]] * 5
        n = sum(n_groups)
        if all(sound):
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield {"id": id_, "block": blocks.of(n), "sound": True, "n_a": sum(n_a), "n_b": sum(n_b), "n_groups": n, "n_links": n, "links": b"".join(links), "groups_sha256": digest}
        else:
            yield {"id": id_, "block": blocks.of(0), "sound": False, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "links": b"", "groups_sha256": ""}


def _segments(al: Aligner, text: str, size: int) -> Iterator[tuple[int, str]]:
    """Runs of whole units of ``size`` bytes at most, with their first byte; a longer unit is alone."""
    at = start = held = 0
    run: list[str] = []
    for unit in al.units(text):
        n = len(unit.encode()) + 1
        if run and held + n > size:
            yield start, " ".join(run)
            run, start, held = [], at, 0
        run.append(unit)
        at, held = at + n, held + n
    if run:
        yield start, " ".join(run)


def _long_rows(al: Aligner, blocks: _Blocks, part: pa.RecordBatch, size: int) -> Iterator[dict]:
    for row in part.to_pylist():
        key = {"id": row["id"], "uid": row["uid"]}
        units = al.units(row["text"])
        if len(units) == 1:  # maybe longer than a range
            sound, a, b = al.tokens(units[0])
            for k, f, links, n_a, n_b in al.cut_tokens(a, b, size) if sound else []:
                n = f.groups + f.cut
                yield key | {"start": row["start"] + k * size, "block": blocks.of(n), "sound": True, "n_a": n_a, "n_b": n_b, "n_links": n, "links": links} | _columns(f)
        else:
            known = al.learn([units])
            got = [known[u] for u in units]
            sound = all(u.sound for u in got)
            if sound:
                first, _, body = ";".join([u.groups for u in got]).partition(";")
                head_a, head_b = ([int(i) for i in ids.split(",")] for ids in first.split("|"))
                n = sum(u.n_groups for u in got)
                yield (
                    key
                    | {"start": row["start"], "block": blocks.of(n), "sound": True, "n_a": sum(u.n_a for u in got), "n_b": sum(u.n_b for u in got), "n_links": n, "links": b"".join([u.links for u in got])}
                    | _columns(Fragment(True, head_a, head_b, body, n - 1, [], []))
                )
        if not sound:
            yield key | {"start": row["start"], "block": blocks.of(0), "sound": False, "n_a": 0, "n_b": 0, "n_links": 0, "links": b""} | _columns(EMPTY)


def _columns(f: Fragment) -> dict:
    return dict(zip(_FRAGMENT, f, strict=True))


def _grouped(rows: Iterator, size: int) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def _composed(parts: DataFrame, size: int) -> DataFrame:
    """(``uid``, ``n_groups``, ``groups_sha256``): each text's fragments put together in a tree."""
    last = parts.agg(F.max("start")).first()[0] or 0
    schema = parts.schema
    arrow = _arrow(schema)

    def together(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        f = reduce(Fragment.__add__, (Fragment(*[r[c] for c in _FRAGMENT]) for r in rows))
        return pa.Table.from_pylist([{"uid": rows[0]["uid"], "start": rows[0]["start"]} | _columns(f)], arrow)

    span = size
    while span <= last:
        span *= FAN
        parts = parts.groupBy("uid", F.floor(F.col("start") / F.lit(span)).alias("range")).applyInArrow(together, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                f = Fragment(*[r[c] for c in _FRAGMENT])
                yield pa.RecordBatch.from_pydict({"uid": [r["uid"]], "n_groups": [f.groups + 1], "groups_sha256": [hashlib.sha256(f.written().encode()).hexdigest()]})

    return parts.mapInArrow(digest, "uid long, n_groups long, groups_sha256 string")


def _rated(rows: DataFrame, code: str, pairs: int) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` of their links, without the links."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("links"), strict=True):
                if b != block or size > BLOCK:
                    yield from _tallied(block, held)
                    block, held, size = b, [], 0
                held.append(np.frombuffer(raw.as_buffer() or b"", code))
                size += len(held[-1])
        yield from _tallied(block, held)
        give_back()

    def _tallied(block: int | None, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(codes), block, np.int64), "code": codes.astype(np.int64), "n": n.astype(np.int64)})

    seen = written(rows.select("block", "links").mapInArrow(tally, "block long, code long, n long"), "pairs")
    counts = written(seen.groupBy("code").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.col("code") % F.lit(pairs)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    best = counts.join(most, b_id == F.col("b")).select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    known = seen.select("block", "code").join(best, "code").select("block", "code", "count", "best")
    slim = rows.select("id", "uid", "block", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256")
    schema = T.StructType([f for f in slim.schema if f.name not in ("block", "links")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    arrow = _arrow(schema)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        codes = right.column("code").to_numpy()
        order = np.argsort(codes)
        codes, count, best = codes[order], right.column("count").to_numpy()[order], right.column("best").to_numpy()[order].astype(bool)
        n_best, count_sum = [], []
        for raw in left.column("links"):
            at = np.searchsorted(codes, np.frombuffer(raw.as_buffer() or b"", code))
            n_best.append(int(best[at].sum()))
            count_sum.append(int(count[at].sum()))
        out = left.drop_columns(["block", "links"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).cast(arrow)

    return slim.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(rate, schema)
