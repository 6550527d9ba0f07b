"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word is unique, so it is told by its last token alone:
``last[i]`` is the last token of the encoding of the first ``i`` characters, and the rest
is the encoding of the prefix that this token leaves.  The tokens that could end at ``i``
are those that are suffixes of the prefix; an automaton over the vocabulary lists them,
longest first.  Of these exactly one follows ``last`` of the remaining prefix *compatibly*:
the two tokens side by side are what the merges make of their joined bytes.  Following
``last`` from the end backwards gives the ids.  The time is in proportion to the length
(times the number of suffix tokens), for words of any length.

Compatibility of two tokens.  Each token is built by a fixed tree of merges.  Along its
right edge (for the left token) and left edge (for the right token) stand the pieces that
touch the boundary at some time.  A merge that joins two touching pieces happens, and so
forbids the pair, if it comes before both pieces are used up by their own tokens; a merge
of equal rank is done from left to right, so at equal rank the left piece's own merge comes
first and the right piece's own comes later.

Words repeat, so a task keeps the ids of words it has met, up to a fixed number of short
ones, and gives them up when it ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Words that a worker keeps, and the characters of the longest of them.
KEPT_WORDS = 250_000
KEPT_LENGTH = 48
#: Pairs of tokens that a worker keeps the compatibility of.
KEPT_PAIRS = 500_000
#: Characters that are encoded together.
BATCH_CHARACTERS = 400_000
#: Rows whose ids and texts are held together.
ROWS = 500
#: Words that advance together.
PART = 8_000
#: A token takes so many bits of a packed pair.
BITS, MASK = 20, (1 << 20) - 1
#: Stands between words while they are encoded; not a letter of any vocabulary.
BETWEEN = "\u2fff"
NEVER = 1 << 40

#: Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(printable)))
    return [letters[b] for b in range(256)]


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, decoder = spec["model"], spec["pre_tokenizer"], spec["decoder"]
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
        if (
            model["type"] != "BPE"
            or any(model.get(k) not in (v, "", False) for k, v in plain.items())
            or model.get("ignore_merges")
            or spec["normalizer"]
            or spec["post_processor"]
            or pre["type"] != "ByteLevel"
            or pre["add_prefix_space"]
            or not pre["use_regex"]
            or decoder["type"] != "ByteLevel"
        ):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens with options")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(self.letters)}

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge that makes it
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if made in self.parts:
                raise ValueError(f"{path} makes a token by two merges")
            self.rank[a, b] = rank
            self.parts[made] = (a, b, rank)

        self.bytes_of = [b""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.reached: dict[int, bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if self._reached(i) and (len(token) == 1 or i in self.parts):
                self.suffixes.add_word(token, len(token) << BITS | i)
        self.suffixes.make_automaton()
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.spaced: dict[str, bytes] = {}  # what stands between two single spaces: its ids, with those of the space
        self.words: dict[str, bytes] = {}  # a pre-token: its ids
        self.table = str.maketrans({chr(b): c for b, c in enumerate(self.letters)} | {"\xff": BETWEEN})

    def forget(self) -> None:
        """Gives up what was kept of the texts met: the worker may go on with other work."""
        self.spaced.clear()
        self.words.clear()

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The pieces at one edge of a token, each with the rank of the merge that uses it up."""
        edge, used = [], NEVER
        while True:
            edge.append((token, used))
            if token not in self.parts:
                return edge
            a, b, used = self.parts[token]
            token = b if right else a

    def _fits(self, left: int, right: int) -> bool:
        pieces = self._edge(right, False)
        rank = self.rank.get
        for a, a_used in self._edge(left, True):
            for b, b_used in pieces:
                joined = rank((a, b))
                if joined is not None and joined < a_used and joined <= b_used:
                    return False
        return True

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left token << BITS | right token) is compatible."""
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        new = keys[self.pairs[at] != keys] if len(self.pairs) else keys
        if len(new):
            new = np.unique(new)
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                new = np.unique(keys)
            found = np.fromiter((self._fits(k >> BITS, k & MASK) for k in new.tolist()), bool, len(new))
            where = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, where, new), np.insert(self.fits, where, found)
            at = np.searchsorted(self.pairs, keys)
        return self.fits[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers.

        All words advance together: step ``k`` settles the prefixes of ``k`` letters.
        """
        coded = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        starts = np.zeros(len(coded), np.int64)
        np.cumsum(sizes[:-1] + 1, out=starts[1:])
        # 255 isn't a byte of UTF-8, so no token crosses it
        line = b"\xff".join(coded).decode("latin-1").translate(self.table)
        found = np.fromiter(chain.from_iterable(self.suffixes.iter(line)), np.int64).reshape(-1, 2)
        end, length, token = found[:, 0], found[:, 1] >> BITS, found[:, 1] & MASK
        start = np.repeat(starts, sizes + 1)[end] if len(end) else end
        prefix = end - start + 1
        order = np.argsort(prefix, kind="stable")  # of one end, the longest stays first
        end, length, token, whole = end[order], length[order], token[order], (length == prefix)[order]
        last, back = np.full(len(line), -1, np.int64), np.zeros(len(line), np.int64)
        steps = np.searchsorted(prefix[order], np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        for a, b in pairwise(steps.tolist()):
            e, n, t, fits = end[a:b], length[a:b], token[a:b], whole[a:b].copy()
            open_ = np.flatnonzero(~fits)
            fits[open_] = self._fit(last[e[open_] - n[open_]] << BITS | t[open_])
            e, n, t = e[fits], n[fits], t[fits]
            first = np.ones(len(e), bool)
            first[1:] = e[1:] != e[:-1]
            last[e[first]], back[e[first]] = t[first], n[first]
        at, whose = starts + sizes - 1, np.arange(len(words))
        taken, of = [], []
        while True:
            going = at >= starts[whose]
            at, whose = at[going], whose[going]
            if not len(at):
                break
            taken.append(last[at])
            of.append(whose)
            at = at - back[at]
        if not taken:
            return [b""] * len(words)
        owner = np.concatenate(of[::-1])
        order = np.argsort(owner, kind="stable")
        packed = np.concatenate(taken[::-1])[order].astype("<u4").tobytes()
        stops = (np.bincount(owner, minlength=len(words)).cumsum() * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _reached(self, token: int) -> bool:
        """Whether the merges make ``token`` of its own bytes."""
        if token not in self.reached:
            parts = self.parts.get(token)
            self.reached[token] = parts is None or (self._reached(parts[0]) and self._reached(parts[1]) and self._own(parts))
        return self.reached[token]

    def _own(self, parts: tuple[int, int, int]) -> bool:
        """Whether the merge of ``parts`` is the first that joins pieces across their boundary."""
        pieces = self._edge(parts[1], False)
        return all(
            not ((joined := self.rank.get((a, b))) is not None and (a, b) != parts[:2] and joined < a_used and joined <= b_used)
            for a, a_used in self._edge(parts[0], True)
            for b, b_used in pieces
        )

    def _of_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens; short ones are kept."""
        known = self.words
        out = {w: known[w] for w in words if w in known}
        short, long_ = [], []
        for w in words:
            if w not in out:
                (short if len(w) <= KEPT_LENGTH else long_).append(w)
        for group in (short, *([w] for w in long_)):
            for k in range(0, len(group), PART):
                part = group[k : k + PART]
                out.update(zip(part, self.encode_words(part), strict=True))
        if len(known) < KEPT_WORDS:
            known.update((w, out[w]) for w in short)
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens."""
        get = self.spaced.get
        parts: list[list] = []  # of each text: ids, or pre-tokens and what stands between spaces if these aren't known
        pieces: dict[str, list[str]] = {}
        words: set[str] = set()
        for text in texts:
            if " " in text and not _DOUBLE(text):  # each single space begins a pre-token
                head, *chunks = text.split(" ")
                heads = self.split(head)
                found = list(map(get, chunks))
                for k, ids in enumerate(found):
                    if ids is None:
                        found[k] = chunk = " " + chunks[k]
                        if chunk not in pieces:
                            pieces[chunk] = own = self.split(chunk)
                            words.update(own)
            else:
                heads, found = self.split(text), []
            words.update(heads)
            parts.append([heads, found])
        ids_of = self._of_words(words)
        fresh = {c: b"".join([ids_of[w] for w in own]) for c, own in pieces.items()}
        if len(self.spaced) < KEPT_WORDS:
            self.spaced.update((c[1:], ids) for c, ids in fresh.items() if len(c) <= KEPT_LENGTH)
        return [b"".join([*map(ids_of.__getitem__, heads), *[p if type(p) is bytes else fresh[p] for p in found]]) for heads, found in parts]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; special tokens are recognised."""
        out: list[bytes] = []
        batch: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            batch.append(text)
            size += len(text)
            if size >= BATCH_CHARACTERS or k + 1 == len(texts):
                out += self._batch(batch)
                batch, size = [], 0
        return out

    def _batch(self, texts: list[str]) -> list[bytes]:
        if not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        cut = [self.at_special.split(t) for t in texts]  # text, special, text, ...
        plain = iter(self._plain([p for parts in cut for p in parts[::2]]))
        return [b"".join([self.special[p].to_bytes(4, "little") if k % 2 else next(plain) for k, p in enumerate(parts)]) for parts in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_DOUBLE = re.compile(r"\s\s").search


@cache
def encoder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """Encodes each text of ``df`` and decodes the ids again.

    Returns, a row for each row of ``df``, ``id_col``, ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` (lowercase hex; ids packed as little-endian unsigned 32-bit
    integers) and, with ``outputs``, ``ids`` (packed) and ``decoded``.  A null text counts
    as empty; an empty text has no ids.  Strings of special tokens in a text become these
    tokens.  Null or repeated identifiers are kept; other columns are not read.
    ``path`` is a byte-level BPE file of the tokenizers library that every worker can open.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` string, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.iloc[k : k + ROWS]
                ids = bpe.encode_many([t or "" for t in part["t"].tolist()])
                decoded = [bpe.decode(i) for i in ids]
                out = {
                    id_col: part["i"].tolist(),
                    "n_tokens": [len(i) // 4 for i in ids],
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded],
                }
                yield pd.DataFrame(out | ({"ids": ids, "decoded": decoded} if outputs else {}))
        bpe.forget()
        batch = part = ids = decoded = out = None
        give_back()

    # identifiers travel as strings: pandas has no null among integers
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInPandas(run, schema)
    return rows.withColumn(id_col, F.col(f"`{id_col}`").cast(kind))
