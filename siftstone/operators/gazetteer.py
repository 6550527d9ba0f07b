"""A dictionary of place names, and the names that texts mention.

Names are admitted by rules, folded to phrases (tokens with single blanks), and grouped with
the places that they may mean.  Texts are looked through once, in time that grows with their
length: two bitmaps, whose size is bounded, tell whether a run of tokens may begin a phrase
of the dictionary and whether it may be one.  The few that pass without being one are found
beforehand, by a join with the dictionary.  Of the others, the leftmost and longest stay, and
only these leave the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Container, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, islice
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import FOLDED_TOKEN, fold
from .staging import staged

if TYPE_CHECKING:
    import pyarrow as pa

#: Tokens of a phrase at most.
LONGEST = 12
#: Fixed value: characters of a single word at least, unless it is a country's name.
SHORTEST_WORD = 4
#: Phrases that are kinds of places, and further names of countries.
GENERIC = ("national park", "nature reserve", "nature park", "botanical garden", "botanical gardens", "butterfly park", "butterfly garden", "butterfly gardens")
COUNTRY_NAMES = {
    "US": ("United States", "United States of America", "USA", "U.S.A."),
    "GB": ("United Kingdom", "UK", "Great Britain"),
    "AE": ("United Arab Emirates", "UAE"),
    "KR": ("South Korea",),
    "KP": ("North Korea",),
    "TW": ("Taiwan",),
    "VN": ("Vietnam", "Viet Nam"),
    "LA": ("Laos",),
    "RU": ("Russia",),
    "CZ": ("Czechia", "Czech Republic"),
}
#: Bits of a bitmap: so many for each beginning of a phrase, within these bounds (the largest has 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Bits that one row of Spark's bitmap aggregates holds.
ROW_BITS = 32_768
#: Runs of tokens that a task sends on at once, characters that it looks through at once (or one text), and phrases that it remembers.
RUNS, CHARACTERS, SEEN = 1 << 15, 1 << 18, 1 << 18
#: A key is one of so many, each further word multiplies it, and it sets so many bits of a bitmap.
KEYS, STEP, MIX, PROBES = 1 << 64, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 5
#: Characters below this one are folded by a table, as are ideographs.
SIMPLE = 0x3000
#: Runs that only the bitmaps take for phrases, and their bytes, that are sent to tasks at most.
MOST_FALSE, MOST_FALSE_BYTES = 1 << 17, 1 << 24
#: Frequent phrases that are sent to tasks at most, and bytes of one.
FREQUENT, FREQUENT_BYTES = 1 << 17, 1 << 7


@F.pandas_udf(ArrayType(StringType()))
def _phrase_words(name: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    of = lambda t: known[t] if t in known else known.setdefault(t, fold(t))
    return name.map(lambda x: [of(t) for t in FOLDED_TOKEN.findall(x or "")])


_phrase_words = _phrase_words.asNondeterministic()  # so that filters of it don't make it run again


def phrase_words(name: Column) -> Column:
    return _phrase_words(name)


def names_of(places: DataFrame) -> DataFrame:
    """(``place``, ``name``, ``canonical``): all names of the places of a gazetteer.

    ``places``: ``place_id``, ``name``, ``level``, ``country`` and, where there are any,
    ``ascii_name`` and ``alternates`` (parted by commas).  Names and their ASCII forms, and
    the further names of countries, are canonical; alternates are not.
    """
    has = set(places.columns)
    more = F.lit(None).cast("array<string>")
    for code, names in COUNTRY_NAMES.items():
        more = F.when((F.col("level") == "country") & (F.col("country") == code), F.array(*[F.lit(n) for n in names])).otherwise(more)
    own = F.concat(F.array("name", F.col("ascii_name") if "ascii_name" in has else F.lit(None)), F.coalesce(more, F.expr("CAST(array() AS ARRAY<STRING>)")))
    other = F.split("alternates", ",") if "alternates" in has else F.lit(None).cast("array<string>")
    named = lambda names, canonical: places.select(F.col("place_id").alias("place"), F.explode(names).alias("name"), F.lit(canonical).alias("canonical"))
    return named(own, True).unionByName(named(other, False)).filter("name IS NOT NULL")


def common_words(texts: DataFrame, text: str, share: float = 0.02) -> DataFrame:
    """(``word``,): words that at least ``share`` of the texts hold in lower case; no names of places by themselves."""
    total = texts.count()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\p{Ll}+\b"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= share * total).select("word")


def admitted(names: DataFrame, levels: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(``phrase``, ``n`` tokens, ``place``, ``canonical``): the names that may stand for places.

    ``names``: (``place``, ``name``, ``canonical``), repeats included; ``levels``: (``place``,
    ``level``).  Left out are names without tokens or of more than twelve, with a token of
    digits alone, and kinds of places (``GENERIC``); single words, unless they name a country,
    of fewer than four characters or among ``common`` (``word``).  A name that is canonical
    for a place once is so.
    """
    words = names.select("place", "canonical", phrase_words(F.col("name")).alias("w")).join(levels.select("place", "level"), "place")
    words = words.filter(F.size("w").between(1, LONGEST) & ~F.exists("w", lambda t: t.rlike(r"^\p{Nd}+$")))
    rows = words.select("place", "canonical", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"), ((F.size("w") == 1) & ~F.col("level").eqNullSafe(F.lit("country"))).alias("lone"))
    rows = rows.filter(~F.col("phrase").isin(*GENERIC) & ~(F.col("lone") & (F.char_length("phrase") < SHORTEST_WORD)))
    if common is not None:
        word = common.select(F.col("word").alias("phrase"), F.lit(True).alias("lone")).distinct()
        rows = rows.join(word, ["phrase", "lone"], "left_anti")
    return rows.groupBy("phrase", "n", "place").agg(F.bool_or(F.coalesce("canonical", F.lit(False))).alias("canonical"))


def dictionary(aliases: DataFrame, places: DataFrame, columns: Sequence[str] = ("level", "country", "latitude", "longitude")) -> DataFrame:
    """(``phrase``, ``n``, ``places``): what each phrase may mean, in the order of the places' identifiers."""
    rows = aliases.join(places.select("place", *columns), "place")
    entry = F.struct("place", "canonical", *columns)
    return rows.groupBy("phrase", "n").agg(F.sort_array(F.collect_list(entry)).alias("places"))


_RUN = StructType([StructField(n, t()) for n, t in [("at", IntegerType), ("n", IntegerType), ("start", IntegerType), ("stop", IntegerType), ("phrase", StringType)]])
_SPOTS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("at", "start", "stop")]))


def _hashes(characters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of words whose characters stand one after another."""
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(characters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, STEP, np.uint64))
    out = np.zeros(len(lengths), np.uint64)
    some = lengths > 0
    out[some] = np.add.reduceat((characters.astype(np.uint64) + np.uint64(1)) * powers[at], first[some]) if len(characters) else 0
    for shift in (np.uint64(29), np.uint64(32)):  # powers alone mix the low bits badly
        out = (out ^ (out >> shift)) * np.uint64(MIX)
    return out ^ (out >> np.uint64(31))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _beginnings(phrases: Sequence[str]) -> list[list[int]]:
    """Keys of each phrase's first word, first two words and so on."""
    words = [p.split(" ") for p in phrases]
    flat = [w for p in words for w in p]
    each = iter(_hashes(_characters("".join(flat)), np.array([len(w) for w in flat], np.int64)).tolist())
    return [list(accumulate(islice(each, len(p)), lambda key, word: (key * STEP + word) % KEYS)) for p in words]


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each character: 1 if it goes on in a token, 2 if it is one, and what it folds to, 0 where a token must be folded as a whole."""
    kinds, folded = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint32)
    every = "".join(map(chr, [*range(0xD800), *[32] * 0x800, *range(0xE000, 0x110000)]))
    for m in FOLDED_TOKEN.finditer(every):
        kinds[m.start() : m.end()] = 2 if "\u3400" <= m[0] <= "\u9fff" else 1
    for k in range(SIMPLE):
        now = fold(chr(k))
        folded[k] = ord(now) if len(now) == 1 and not "\u1100" <= now <= "\u11ff" else 0  # letters that make up syllables
    folded[0x3400:0xA000] = np.arange(0x3400, 0xA000)
    return kinds, folded


def _probe(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k``-th bits of keys in a bitmap."""
    return ((keys & np.uint64(0x7FFFFFFF)).astype(np.int64) + k * ((keys >> np.uint64(33)).astype(np.int64) | 1)) & (bits - 1)


def _passing(keys: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Which of the keys a bitmap lets pass."""
    left = np.arange(len(keys))
    for k in range(PROBES):
        at = _probe(keys[left], bits, k)
        left = left[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return left


def _bits(count: int) -> int:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, count * BITS_EACH):
        bits *= 2
    return bits


def _bitmaps(rows: DataFrame, keys: Callable[[pa.RecordBatch], Sequence[np.ndarray]], kinds: int, bits: int) -> list[bytes]:
    """Bitmaps of several kinds of keys that ``keys`` makes of the rows; tasks send on what they set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        maps = np.zeros((kinds, bits // 8), np.uint8)
        for batch in batches:
            for kind, of in enumerate(keys(batch)):
                for k in range(PROBES if len(of) else 0):
                    at = np.unique(_probe(of, bits, k))
                    first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
                    maps[kind, at[first] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)
        parts = maps.reshape(kinds, -1, ROW_BITS // 8)
        for kind in range(kinds):
            full = np.flatnonzero(parts[kind].any(axis=1))
            for k in range(0, len(full), 256):
                some = full[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([parts[kind, r].tobytes() for r in some], pa.binary())], names=["kind", "row", "b"])

    out = [bytearray(bits // 8) for _ in range(kinds)]
    for r in rows.mapInArrow(made, "kind int, row int, b binary").groupBy("kind", "row").agg(F.bitmap_or_agg("b").alias("b")).collect():  # kinds * bits / ROW_BITS rows at most
        out[r["kind"]][r["row"] * (ROW_BITS // 8) : (r["row"] + 1) * (ROW_BITS // 8)] = r["b"]
    return [bytes(b) for b in out]


def sieve(phrases: DataFrame) -> tuple[int, bytes, bytes]:
    """Bits, and bitmaps of the phrases and of their beginnings, by the keys of their words."""

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        each = _beginnings(batch.column("phrase").to_pylist())
        return np.array([k[-1] for k in each], np.uint64), np.array([x for k in each for x in k], np.uint64)

    bits = _bits(phrases.agg(F.sum(F.size(F.split("phrase", " ")))).first()[0] or 0)
    whole, begin = _bitmaps(phrases.select("phrase").filter("phrase IS NOT NULL"), keys, 2, bits)
    return bits, whole, begin


class _Text:
    """The tokens of some texts, one after another, and the runs of them that bitmaps let pass."""

    def __init__(self, texts: Sequence[str], bits: int, whole: np.ndarray, begin: np.ndarray, longest: int, false: tuple[np.ndarray, Container[str]] | None = None):
        kinds, folded = _alphabet()
        page = "\n".join(texts)
        own = _characters(page)
        kind = kinds[own]
        inside = kind > 0
        before = np.concatenate([[False], (kind[1:] != 1) | (kind[:-1] != 1)]) if len(own) else inside
        before[:1] = True
        starts = np.flatnonzero(inside & before)
        stops = np.flatnonzero(inside & np.append(before[1:], True)) + 1
        plain = folded[own]
        key = _hashes(plain[inside], stops - starts)
        step = np.full(len(key), STEP, np.uint64)
        self.whole: dict[int, str] = {}  # tokens that are folded as a whole
        hard = np.concatenate([[0], np.cumsum(inside & (plain == 0))])
        for k in np.flatnonzero(hard[stops] > hard[starts]).tolist():
            self.whole[k] = fold(page[starts[k] : stops[k]])
        for k, words in zip(self.whole, _beginnings(list(self.whole.values())), strict=True):
            key[k], step[k] = words[-1], pow(STEP, len(words), KEYS)
        plain[~inside] = own[~inside]
        self.folded = plain.astype("<u4").tobytes().decode("utf-32-le")
        # how many tokens don't go on with a blank and a token as they stand
        apart = np.ones(len(key), np.int64)
        apart[:-1] = (starts[1:] - stops[:-1] != 1) | (own[stops[:-1]] != 32)
        apart[list(self.whole)] = 1
        self.apart = np.concatenate([[0], np.cumsum(apart)]).tolist()
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where texts begin
        self.ends = np.searchsorted(starts, first[1:])
        of = np.diff(self.ends, prepend=0)
        base = np.repeat(first[:-1], of)
        self.at, self.to, self.starts, self.stops = starts.tolist(), stops.tolist(), (starts - base).tolist(), (stops - base).tolist()
        room = np.repeat(self.ends, of) - np.arange(len(key))
        at, now = np.arange(len(key)), key
        self.runs: list[tuple[int, np.ndarray]] = []
        for n in range(1, longest + 1):
            if n > 1:
                goes = room[at] >= n
                at = at[goes]
                now = now[goes] * step[at + (n - 1)] + key[at + (n - 1)]
            passing = _passing(now, bits, begin)
            at, now = at[passing], now[passing]
            if not len(at):
                break
            hit = _passing(now, bits, whole)
            if false and len(hit):
                like = np.isin(now[hit], false[0]).tolist()
                hit = hit[[not x or self.phrase(k, n) not in false[1] for x, k in zip(like, at[hit].tolist(), strict=True)]]
            self.runs.append((n, at[hit]))

    def phrase(self, at: int, n: int) -> str:
        last = at + n - 1
        if self.apart[last] == self.apart[at] and last not in self.whole and at not in self.whole:
            return self.folded[self.at[at] : self.to[last]]
        return " ".join([self.whole.get(k) or self.folded[self.at[k] : self.to[k]] for k in range(at, at + n)])

    def all(self) -> Iterator[tuple[int, int]]:
        """Place and number of tokens of each run, text by text."""
        first = np.concatenate([found for _, found in self.runs] or [np.zeros(0, np.int64)])
        length = np.repeat([n for n, _ in self.runs], [len(found) for _, found in self.runs]).astype(np.int64)
        order = np.lexsort((length, first))
        return zip(first[order].tolist(), length[order].tolist(), strict=True)

    def kept(self) -> Iterator[tuple[int, int]]:
        """The runs that stay: from left to right the longest that begins after the last one's end."""
        best = np.zeros(len(self.at), np.int64)
        for n, found in self.runs:  # longer ones later
            best[found] = n
        first, free = np.flatnonzero(best), 0
        for at, n in zip(first.tolist(), best[first].tolist(), strict=True):
            if at >= free:
                free = at + n
                yield at, n


def runs(text: str, bits: int, whole: bytes, begin: bytes, longest: int) -> list[tuple[int, int, int, int, str]]:
    """Runs of tokens that the bitmaps let pass: first token, tokens, place in the text, phrase."""
    t = _Text([text], bits, np.frombuffer(whole, np.uint8), np.frombuffer(begin, np.uint8), longest)
    return [(at, n, t.starts[at], t.stops[at + n - 1], t.phrase(at, n)) for at, n in t.all()]


def _looked(batches: Iterator[pa.RecordBatch], looked: tuple[int, bytes, bytes], longest: int, false: frozenset[str], wanted: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[tuple[pa.RecordBatch, list[int], _Text]]:
    """Each batch in parts of some ``CHARACTERS`` or one text: the batch, the rows of the part, its texts."""
    bits, *maps = looked
    whole, begin = (np.frombuffer(m, np.uint8) for m in maps)
    known = (np.array([k[-1] for k in _beginnings(list(false))], np.uint64), false) if false else None
    for batch in batches:
        rows: list[int] = []
        texts: list[str] = []
        taken = np.arange(batch.num_rows) if wanted is None else np.flatnonzero(wanted(batch))
        held, column = 0, batch.column("__text")
        for k in taken.tolist():
            if text := column[k].as_py():
                rows.append(k)
                texts.append(text)
                held += len(text)
            if held >= CHARACTERS:
                yield batch, rows, _Text(texts, bits, whole, begin, longest, known)
                rows, texts, held = [], [], 0
        if rows:
            yield batch, rows, _Text(texts, bits, whole, begin, longest, known)


def _repeated(units: DataFrame, unit: Sequence[str]) -> tuple[int, bytes] | None:
    """A bitmap of the units of several rows (and few others), if there are any."""
    several = staged(units.groupBy(F.xxhash64(*unit).alias("key")).count().filter("count > 1").select("key"))
    if not (count := several.count()):
        return None
    bits = _bits(count)
    return bits, _bitmaps(several, lambda batch: [batch.column("key").to_numpy().view(np.uint64)], 1, bits)[0]


def tried_runs(units: DataFrame, unit: Sequence[str], text: Column, phrases: DataFrame, longest: int = LONGEST, looked: tuple[int, bytes, bytes] | None = None, false: frozenset[str] = frozenset(), repeated: tuple[int, bytes] | None = None) -> DataFrame:
    """(unit, ``at``, ``n``, ``start``, ``stop``, ``phrase``): the runs of tokens that may be one of ``phrases``, a row for each.

    A task holds ``RUNS`` of them, or those of one part of a batch, at a time, however many a
    batch of texts has.  With ``repeated``, only texts of such units are looked through.
    """
    sent = phrases.sparkSession.sparkContext.broadcast((looked or sieve(phrases), false, repeated))  # 48 MB at most
    rows = units.select(*unit, text.alias("__text"), F.xxhash64(*unit).alias("__key"))
    schema = StructType([*(f for f in rows.schema if f.name not in ("__text", "__key")), *_RUN])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        looked, false, repeated = sent.value
        kinds = [pa.int32()] * 4 + [pa.string()]
        several = repeated and (lambda batch: _among(batch, *repeated))
        for batch, rows, t in _looked(batches, looked, longest, false, several):
            found = t.all()
            while part := list(islice(found, RUNS)):
                at = np.array([a for a, _ in part], np.int64)
                of = np.searchsorted(t.ends, at, "right")
                own = batch.select(list(unit)).take(pa.array(np.array(rows, np.int64)[of]))
                columns = [at - (t.ends[of] - np.diff(t.ends, prepend=0)[of]), [n for _, n in part], [t.starts[a] for a, _ in part], [t.stops[a + n - 1] for a, n in part], [t.phrase(a, n) for a, n in part]]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(find, schema)


def _among(batch: pa.RecordBatch, bits: int, bitmap: bytes) -> np.ndarray:
    out = np.zeros(batch.num_rows, bool)
    out[_passing(batch.column("__key").to_numpy().view(np.uint64), bits, np.frombuffer(bitmap, np.uint8))] = True
    return out


def _met(units: DataFrame, text: Column, phrases: DataFrame, longest: int, looked: tuple[int, bytes, bytes]) -> DataFrame:
    """(``phrase``, ``hits``, ``known``): what the bitmaps let pass in the texts, how often, and whether it is a phrase."""
    sent = phrases.sparkSession.sparkContext.broadcast(looked)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def made(seen: Counter[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["phrase", "hits"])

        seen: Counter[str] = Counter()
        for _, _, t in _looked(batches, sent.value, longest, frozenset()):
            found = t.all()
            while part := [t.phrase(at, n) for at, n in islice(found, RUNS)]:
                seen.update(part)
                if len(seen) > SEEN:
                    yield made(seen)
                    seen = Counter()
        if seen:
            yield made(seen)

    rows = units.select(text.alias("__text")).mapInArrow(find, "phrase string, hits long").groupBy("phrase").agg(F.sum("hits").alias("hits"))
    return staged(rows.join(phrases.select("phrase", F.lit(True).alias("known")), "phrase", "left"))


def _false(met: DataFrame) -> frozenset[str] | None:
    """What the bitmaps let pass though it is no phrase; None if that is too much to send to tasks."""
    other = met.filter("known IS NULL")
    size = other.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST_FALSE or size["bytes"] > MOST_FALSE_BYTES:
        return None
    return frozenset(r["phrase"] for r in other.select("phrase").collect())


def _frequent(met: DataFrame, known: DataFrame) -> dict[str, int]:
    """``places`` of the phrases that texts have most often, ``FREQUENT`` at most."""
    short = met.filter(F.col("known") & (F.octet_length("phrase") <= FREQUENT_BYTES)).withColumn("steps", F.floor(F.log2("hits") * 4))
    least, count = None, 0
    for r in sorted(short.groupBy("steps").count().collect(), reverse=True):  # some 250 rows at most
        count += r["count"]
        if count > FREQUENT:
            break
        least = r["steps"]
    if least is None:
        return {}
    return {r["phrase"]: r["places"] for r in short.filter(F.col("steps") >= least).select("phrase").join(known, "phrase").collect()}


@F.pandas_udf(ArrayType(IntegerType()))
def _leftmost_longest(at: pd.Series, n: pd.Series) -> pd.Series:
    """Which of a text's hits stay: from left to right the longest that begins after the last one's end."""

    def one(first: np.ndarray, length: np.ndarray) -> list[int]:
        order = np.lexsort((-length, first))
        kept, free = [], 0
        for k in order.tolist():
            if first[k] >= free:
                kept.append(k)
                free = first[k] + length[k]
        return kept

    return pd.Series([one(np.asarray(a), np.asarray(b)) for a, b in zip(at, n, strict=True)], dtype=object, index=at.index)


def _of_rows(met: DataFrame, unit: Sequence[str]) -> DataFrame:
    """:func:`phrase_spots` of runs that all are phrases."""
    rows = met.groupBy(*unit).agg(F.collect_list(F.struct("at", "n", "start", "stop", "phrase")).alias("all"))
    kept = rows.withColumn("kept", _leftmost_longest(F.col("all.at"), F.col("all.n"))).select(*unit, F.explode(F.transform("kept", lambda k: F.get("all", k))).alias("h"))
    return kept.groupBy(*unit, F.col("h.phrase").alias("phrase"), F.col("h.n").alias("n")).agg(F.collect_list(F.struct("h.at", "h.start", "h.stop")).alias("spots"))


def _of_texts(units: DataFrame, unit: Sequence[str], text: Column, longest: int, looked: tuple[int, bytes, bytes], false: frozenset[str], repeated: tuple[int, bytes] | None) -> DataFrame:
    """:func:`phrase_spots` of texts that are one row each, which are looked through by themselves."""
    sent = units.sparkSession.sparkContext.broadcast((looked, false, repeated))  # 48 MB at most
    rows = units.select(*unit, text.alias("__text"), F.xxhash64(*unit).alias("__key"))
    schema = StructType([*(f for f in rows.schema if f.name not in ("__text", "__key")), StructField("phrase", StringType()), StructField("n", IntegerType()), StructField("spots", _SPOTS)])

    def made(batch: pa.RecordBatch, rows: list[int], t: _Text, spots: dict[tuple[int, int, str], list[int]]) -> pa.RecordBatch:
        import pyarrow as pa

        of, length, phrase = (list(c) for c in zip(*spots, strict=True))
        count = [len(at) for at in spots.values()]
        at = np.array([a for x in spots.values() for a in x], np.int64)
        last = (at + np.repeat(length, count) - 1).tolist()
        places = [at - np.repeat(np.concatenate([[0], t.ends])[of], count), [t.starts[a] for a in at.tolist()], [t.stops[a] for a in last]]
        each = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in places], names=["at", "start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), each)
        own = batch.select(list(unit)).take(pa.array(np.array(rows, np.int64)[of]))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(phrase, pa.string()), pa.array(length, pa.int32()), lists], names=schema.names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked, false, repeated = sent.value
        single = repeated and (lambda batch: ~_among(batch, *repeated))
        for batch, rows, t in _looked(batches, looked, longest, false, single):
            ends, row = t.ends.tolist(), 0
            spots: dict[tuple[int, int, str], list[int]] = {}
            for at, n in t.kept():
                if at >= ends[row]:
                    while at >= ends[row]:
                        row += 1
                    if len(spots) >= RUNS:
                        yield made(batch, rows, t, spots)
                        spots = {}
                spots.setdefault((row, n, t.phrase(at, n)), []).append(at)
            if spots:
                yield made(batch, rows, t, spots)

    return rows.mapInArrow(find, schema)


def _counts_of_texts(units: DataFrame, unit: Sequence[str], text: Column, longest: int, looked: tuple[int, bytes, bytes], false: frozenset[str], repeated: tuple[int, bytes] | None, frequent: dict[str, int]) -> DataFrame:
    """(unit, ``phrase``, ``n``, ``places``, ``hits``) of texts that are one row each: frequent phrases are summed up by their ``places``, others have none yet."""
    sent = units.sparkSession.sparkContext.broadcast((looked, false, repeated, frequent))
    rows = units.select(*unit, text.alias("__text"), F.xxhash64(*unit).alias("__key"))
    schema = StructType([*(f for f in rows.schema if f.name not in ("__text", "__key")), StructField("phrase", StringType()), StructField("n", IntegerType()), StructField("places", LongType()), StructField("hits", LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        looked, false, repeated, frequent = sent.value
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]

        def made(batch: pa.RecordBatch, rows: list[int], counts: Counter[tuple]) -> pa.RecordBatch:
            of, phrase, n, places = zip(*counts, strict=True)
            own = batch.select(list(unit)).take(pa.array(np.array(rows, np.int64)[list(of)]))
            columns = [phrase, n, places, list(counts.values())]
            return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

        single = repeated and (lambda batch: ~_among(batch, *repeated))
        for batch, rows, t in _looked(batches, looked, longest, false, single):
            ends, row = t.ends.tolist(), 0
            counts: Counter[tuple] = Counter()
            for at, n in t.kept():
                if at >= ends[row]:
                    while at >= ends[row]:
                        row += 1
                    if len(counts) >= RUNS:
                        yield made(batch, rows, counts)
                        counts = Counter()
                phrase = t.phrase(at, n)
                places = frequent.get(phrase)
                counts[(row, phrase, n, None) if places is None else (row, None, n, places)] += 1
            if counts:
                yield made(batch, rows, counts)

    return rows.mapInArrow(find, schema)


def phrase_spots(units: DataFrame, unit: Sequence[str], text: Column, known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(unit, ``phrase``, ``n`` tokens, ``spots``): the phrases of ``known`` that stay in each text, with all their places, a row for each.

    The texts are looked through twice: what the bitmaps let pass though it is no phrase is
    settled first, so that a task then knows which runs stay, and nothing else leaves it.  If
    that is too much to send, or a unit has several rows, all runs are joined or gathered.
    """
    looked = sieve(known)
    false = _false(_met(units, text, known, longest, looked))
    if false is None:
        return _of_rows(tried_runs(units, unit, text, known, longest, looked).join(known.select("phrase"), "phrase"), unit)
    repeated = _repeated(units, unit)
    out = _of_texts(units, unit, text, longest, looked, false, repeated)
    return out.unionByName(_of_rows(tried_runs(units, unit, text, known, longest, looked, false, repeated), unit)) if repeated else out


def phrase_hits(units: DataFrame, unit: Sequence[str], text: Column, known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(unit, ``at``, ``n`` tokens, ``start``, ``stop``, ``places``): the phrases of ``known`` in each text, a row for each.

    Leftmost, then longest, without overlaps.  ``known``: (``phrase``, ``places``).  Null and
    empty texts have none.  ``unit`` tells texts apart; rows that share it are one text.
    """
    known = staged(known.select("phrase", "places"))
    # the places of a phrase, which may be many, join only what stays
    rows = phrase_spots(units, unit, text, known, longest).join(known, "phrase")
    return rows.select(*unit, "n", "places", F.inline("spots")).select(*unit, "at", "n", "start", "stop", "places")


def phrase_counts(units: DataFrame, unit: Sequence[str], text: Column, known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(unit, ``n`` tokens, ``places``, ``hits``): how many of the hits of :func:`phrase_hits` a text has by their tokens and places.

    ``known``: (``phrase``, ``places``), a number.  Those of the most frequent phrases are sent
    to the tasks, so that few rows leave a text, however many hits it has.
    """
    known = staged(known.select("phrase", F.col("places").cast("long").alias("places")))
    looked = sieve(known)
    met = _met(units, text, known, longest, looked)
    false, nothing = _false(met), F.lit(None).cast("long").alias("places")
    counted = lambda spots: spots.select(*unit, "phrase", "n", nothing, F.size("spots").cast("long").alias("hits"))
    if false is None:
        rows = counted(_of_rows(tried_runs(units, unit, text, known, longest, looked).join(known.select("phrase"), "phrase"), unit))
    else:
        repeated = _repeated(units, unit)
        rows = _counts_of_texts(units, unit, text, longest, looked, false, repeated, _frequent(met, known))
        if repeated:
            rows = rows.unionByName(counted(_of_rows(tried_runs(units, unit, text, known, longest, looked, false, repeated), unit)))
    # rows that have their places go past the join, dealt by their unit
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "phrase"), F.pmod(F.xxhash64(*unit), F.lit(4096)).cast("string"))).drop("phrase")
    own = known.select(F.concat(F.lit("="), "phrase").alias("key"), F.col("places").alias("own"))
    return rows.join(own, "key", "left").groupBy(*unit, "n", F.coalesce("places", "own").alias("places")).agg(F.sum("hits").alias("hits"))


def found_phrases(units: DataFrame, unit: Sequence[str], text: Column, known: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(unit, ``hits``): what :func:`phrase_hits` finds, as an array by place in the text; texts without any have no row."""
    rows = phrase_hits(units, unit, text, known, longest)
    return rows.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("at", "n", "start", "stop", "places"))).alias("hits"))


def read_zipped_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(``value``,): the lines of a member of zip archives, unpacked where Spark reads them."""

    def lines(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z, io.TextIOWrapper(z.open(member), encoding="utf-8") as f:
                    while part := f.readlines(1 << 20):
                        yield pa.RecordBatch.from_pydict({"value": pa.array([x.rstrip("\r\n") for x in part], pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")
