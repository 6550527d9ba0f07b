"""What texts say about places and times, recognised over their words.

A text is cut into words once; each word is looked up in small tables of values, and the
words after (or before) it decide.  So the time grows with the text, whatever it says.
Coordinates are read from lexemes (numbers, words, signs) by a small grammar.  All functions
on columns take Arrow batches of whole texts and give arrays, which are for exploding.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import parse_qs, urlsplit

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

# The words and phrases that tell kinds of statements apart.  "|" parts
# alternatives, and a "*" at the end stands for any ending.
SEEN = frozenset("taken photographed captured spotted sighted observed seen found shot visited feeding perched".split())
SEEN_OR_VISITING = SEEN | {"visiting"}
NEAR = frozenset("in at near outside around along".split())
LABEL = frozenset("location locality".split())
CUES = {
    "spread": [
        "native to", "distribution|distributed|widespread", "range extends", "ranges from", "found|occurs throughout", "introduced|endemic to", "species is found",
        "species|genus|family|plant found|occur|occurs|occurring|grow|grows",
        "species|genus|family|plant is|are found|occur|occurs|occurring|grow|grows",
        "species|genus|family|plant can|may be found|occur|occurs|occurring|grow|grows",
    ],
    "biology": ["species|genus|family|native|widespread|distributed|distribution|habitat|migration|migrant|pierid", "medium-sized", "medium sized", "remaining few species"],
    "asserted": ["this|my|the photo|photograph|image|picture|shot", "i saw|found|photographed|spotted|took", "we saw|found|photographed|spotted"],
    "greeting": [
        "greeting|greetings|regard|regards|hello|cheers from", "welcome|invited to", "post|add to", "post|add it|this to", "our group", "join us", "join the group", "flickr group",
    ],
    "question": ["where", "which country|place|park|city", "is|was this in|at", "was this taken"],
    "stage": ["pupa|pupae|chrysalis|emerg*|hatch*|larva*"],
    "travel": ["bus|train|breakfast|hotel|hike|journey|arriv*|depart*|driv*|travel*|walk*"],
}
#: Numbers in words, minutes of a unit, and which way a word points.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "twelve": 12, "twenty-four": 24}
MINUTES = {"hour": 60, "hours": 60, "hr": 60, "hrs": 60, "minute": 1, "minutes": 1, "min": 1, "mins": 1, "day": 1440, "days": 1440, "week": 10080, "weeks": 10080}
DIRECTIONS = {"before": "before", "prior": "before", "earlier": "before", "ago": "before", "later": "after", "after": "after"}
#: What the words around a time say that it is about; the first that is met.
NARRATIVES = (("stage", "biological_stage_timing"), ("greeting", "group_or_greeting_timing"), ("travel", "travel_or_itinerary_timing"))
#: Characters around a mention that count, and before it for how it is introduced.
AROUND, BEFORE = 140, 150
#: Characters of a locality, and words that may stand between a verb and a preposition, or before a mention.
SHORTEST, LONGEST = 3, 180
BETWEEN = 4

_WORD = regex.compile(r"\w+(?:[-'’]\w+)*")
_LEXEME = regex.compile(r"-?\d+(?:\.\d+)?|[^\W\d_]+|\S")


class Words:
    """The words of a text: in lower case (without what follows an apostrophe), and their places."""

    def __init__(self, text: str):
        self.text = text
        found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        self.start = [a for a, _ in found]
        self.stop = [b for _, b in found]
        self.word = [text[a:b].replace("’", "'").partition("'")[0].lower() for a, b in found]

    def __len__(self) -> int:
        return len(self.word)

    def gap(self, k: int) -> str:
        """What stands between word k and the next."""
        return self.text[self.stop[k] : self.start[k + 1]]

    def joined(self, k: int) -> bool:
        """Whether only white space parts word k from the next."""
        return k + 1 < len(self.word) and self.gap(k).isspace()


class Phrases:
    """Sequences of alternatives, found by their first word."""

    def __init__(self, cues: dict[str, list[str]]):
        self.by_first: dict[str, list[tuple[str, list[frozenset[str]]]]] = defaultdict(list)
        self.endings: list[tuple[str, str]] = []
        for kind, lines in cues.items():
            for first, *rest in (line.split() for line in lines):
                later = [frozenset(slot.split("|")) for slot in rest]
                for word in first.split("|"):
                    if word.endswith("*"):
                        self.endings.append((word[:-1], kind))
                    else:
                        self.by_first[word].append((kind, later))

    def find(self, w: Words) -> dict[str, list[tuple[int, int]]]:
        """Of each kind the places of its phrases, in order."""
        out: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, word in enumerate(w.word):
            for kind, later in self.by_first.get(word, ()):
                at = k
                for slot in later:
                    if not w.joined(at) or w.word[at + 1] not in slot:
                        break
                    at += 1
                else:
                    out[kind].append((w.start[k], w.stop[at]))
            for beginning, kind in self.endings:
                if word.startswith(beginning):
                    out[kind].append((w.start[k], w.stop[k]))
        return out


PHRASES = Phrases(CUES)


def _within(places: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether a phrase lies between two places."""
    for k in range(bisect_left(places, (first, 0)), len(places)):
        if places[k][0] >= last:
            return False
        if places[k][1] <= last:
            return True
    return False


def introduced(w: Words, at: int) -> bool:
    """Whether what stands right before ``at`` says that something was seen there.

    A verb, up to four words, a preposition and up to four more words (commas between them
    are fine), or a label with a colon.
    """
    k, low = bisect_left(w.start, at) - 1, at - BEFORE
    if k < 0 or w.stop[k] > at:
        return False
    between = w.text[w.stop[k] : at]
    if w.word[k] in LABEL and w.start[k] >= low and between.strip() in (":", "："):
        return True
    for i in range(k, max(-1, k - BETWEEN - 1), -1):
        if w.start[i] < low or between.replace(",", " ").strip() or not between:
            return False
        if w.word[i] in NEAR and between.isspace():
            for j in range(i - 1, max(-1, i - BETWEEN - 2), -1):
                if w.start[j] < low or not w.joined(j):
                    break
                if w.word[j] in SEEN_OR_VISITING:
                    return True
        between = w.gap(i - 1) if i else ""
    return False


def cut_out(text: str, start: int, stop: int) -> str:
    return text[max(0, start - AROUND) : stop + AROUND].strip()


class Mention(NamedTuple):
    matched: str
    excerpt: str
    capture: bool
    spread: bool
    greeting: bool
    question: bool


def mentions(text: str, places: list[tuple[int, int]]) -> list[Mention]:
    """What is said around each of the places of a text."""
    w = Words(text)
    cues = PHRASES.find(w)
    out = []
    for start, stop in places:
        first, last = max(0, start - AROUND), min(len(text), stop + AROUND)
        said = {kind: _within(cues[kind], first, last) for kind in ("spread", "biology", "asserted", "greeting", "question")}
        spread = said["spread"] or said["biology"] and not said["asserted"]
        asked = said["question"] and "?" in text[first:last]
        out.append(Mention(text[start:stop], text[first:last].strip(), introduced(w, start), spread, said["greeting"], asked))
    return out


def localities(text: str) -> list[tuple[str, int, int]]:
    """What a text says after "seen in", "location:" and the like, up to the end of the sentence, with the whole phrase's place."""
    w, out, free = Words(text), [], 0
    for k, word in enumerate(w.word):
        if w.start[k] < free:
            continue
        begin = None
        if word in SEEN:
            for i in range(k + 1, min(len(w), k + 5)):
                if not w.joined(i - 1):
                    break
                if w.word[i] in NEAR and text[w.stop[i] : w.stop[i] + 1].isspace():
                    begin = w.stop[i]  # the last preposition in reach
        elif word in LABEL and text[w.stop[k] :].lstrip()[:1] in (":", "："):
            begin = text.index(text[w.stop[k] :].lstrip()[0], w.stop[k]) + 1
        if begin is None:
            continue
        while begin < len(text) and text[begin].isspace():
            begin += 1
        end = begin
        while end < len(text) and end - begin < LONGEST and text[end] not in "\n.!?":
            end += 1
        if end - begin >= SHORTEST:
            out.append((text[begin:end], w.start[k], end))
            free = end
    return out


def clocks(text: str) -> list[tuple[str, int, int]]:
    """Times of day with am or pm after "at", "around", "about" or "by": the time, and the whole phrase's place."""
    w, out, free = Words(text), [], 0
    for k, word in enumerate(w.word):
        if w.start[k] < free or word not in ("at", "around", "about", "by") or not w.joined(k):
            continue
        i = k + 2 if w.word[k + 1] == "around" and w.joined(k + 1) else k + 1
        if not w.word[i].isdigit() or len(w.word[i]) > 2 or i + 1 >= len(w) or w.gap(i) not in (":", ".") or not w.word[i + 1][:2].isdigit() or len(w.word[i + 1]) < 2:
            continue
        at = w.start[i + 1] + 2
        while text[at : at + 1].isspace():
            at += 1
        for half in ("a.m", "p.m", "am", "pm"):
            end = at + len(half)
            if text[at:end].lower() == half and not text[end : end + 1].isalnum():
                out.append((text[w.start[i] : end], w.start[k], end))
                free = end
                break
    return out


class Timing(NamedTuple):
    expression: str
    minutes: float
    relation: str
    narrative: str
    excerpt: str


def timings(text: str) -> list[Timing]:
    """Phrases such as "two hours later" or "half an hour ago"."""
    w, out, free = Words(text), [], 0
    cues = None
    for k, word in enumerate(w.word):
        if w.start[k] < free:
            continue
        minutes = None
        i = k  # the last word of the amount
        if word in ("half", "quarter"):
            if word == "quarter" and w.joined(i) and w.word[i + 1] == "of":
                i += 1
            if w.joined(i) and w.word[i + 1] in ("a", "an"):
                i += 1
            if w.joined(i) and w.word[i + 1] == "hour":
                i, minutes = i + 1, 30.0 if word == "half" else 15.0
        else:
            number = float(NUMBERS[word]) if word in NUMBERS else None
            if word == "twenty" and w.joined(k) and w.word[k + 1] == "four":
                i, number = k + 1, 24.0
            elif word.isdecimal():
                number = float(word)
                if k + 1 < len(w) and w.gap(k) == "." and w.word[k + 1].isdecimal():
                    i, number = k + 1, float(f"{word}.{w.word[k + 1]}")
            if number is not None and w.joined(i) and w.word[i + 1] in MINUTES:
                i, minutes = i + 1, number * MINUTES[w.word[i + 1]]
        if minutes is None or not w.joined(i) or w.word[i + 1] not in DIRECTIONS:
            continue
        relation = DIRECTIONS[w.word[i + 1]]
        i += 1
        if w.word[i] == "prior" and w.joined(i) and w.word[i + 1] == "to":
            i += 1
        cues = PHRASES.find(w) if cues is None else cues
        first, last = max(0, w.start[k] - AROUND), min(len(text), w.stop[i] + AROUND)
        told = next((name for kind, name in NARRATIVES if _within(cues[kind], first, last)), "relative_time_unspecified")
        out.append(Timing(text[w.start[k] : w.stop[i]], minutes, relation, told, text[first:last].strip()))
        free = w.stop[i]
    return out


# --- coordinates ----------------------------------------------------------------------


class Lexeme(NamedTuple):
    text: str
    start: int
    stop: int

    @property
    def number(self) -> bool:
        return self.text[-1].isdecimal()

    @property
    def whole(self) -> int:
        """Digits before the point."""
        return len(self.text.lstrip("-").partition(".")[0])

    @property
    def decimals(self) -> int:
        return len(self.text.partition(".")[2])


def lexemes(text: str) -> list[Lexeme]:
    return [Lexeme(m[0], m.start(), m.end()) for m in _LEXEME.finditer(text)]


def valid(lat: float, lon: float) -> tuple[float, float] | None:
    """A point on the globe that isn't where both are zero."""
    return (lat, lon) if -90 <= lat <= 90 and -180 <= lon <= 180 and (lat or lon) else None


class Reader:
    """Steps through lexemes; what doesn't fit gives None and leaves the place as it was."""

    def __init__(self, text: str, items: list[Lexeme]):
        self.text, self.items, self.at = text, items, 0

    def take(self, fits) -> Lexeme | None:
        if self.at < len(self.items) and fits(self.items[self.at]):
            self.at += 1
            return self.items[self.at - 1]
        return None

    def sign(self, signs: str) -> Lexeme | None:
        return self.take(lambda x: x.text in signs)

    def word(self, *words: str) -> Lexeme | None:
        return self.take(lambda x: x.text.lower() in words)

    def number(self, whole: int, least: int = 0, most: int = 99) -> Lexeme | None:
        return self.take(lambda x: x.number and x.whole <= whole and least <= x.decimals <= most)

    def parted(self) -> bool:
        """Steps over commas, semicolons and slashes; whether these or a blank stand there."""
        last = self.items[self.at - 1].stop
        while self.sign(",;/"):
            pass
        here = self.items[self.at].start if self.at < len(self.items) else last
        return any(c in ",;/ " for c in self.text[last:here])


def _labelled(r: Reader) -> tuple[float, float] | None:
    if r.word("latitude", "lat") and r.sign(":=") and (lat := r.number(2)) and r.parted() and r.word("longitude", "lon", "lng") and r.sign(":=") and (lon := r.number(3)):
        return float(lat.text), float(lon.text)
    return None


def _sided(value: float, side: Lexeme) -> float:
    return -abs(value) if side.text.upper() in "SW" else abs(value)


def _hemispheres(r: Reader) -> tuple[float, float] | None:
    if (lat := r.number(2, least=2)) and (ns := r.word("n", "s")) and r.parted() and (lon := r.number(3, least=2)) and (ew := r.word("e", "w")):
        return _sided(float(lat.text), ns), _sided(float(lon.text), ew)
    return None


def _angle(r: Reader, whole: int, sides: tuple[str, str]) -> float | None:
    if (d := r.number(whole, most=0)) and r.sign("°º") and (m := r.number(2, most=0)) and r.sign("'′") and (s := r.number(2)):
        r.sign('"″')
        side = r.word(*sides)
        if side and float(m.text) < 60 and float(s.text) < 60:
            return _sided(float(d.text) + float(m.text) / 60 + float(s.text) / 3600, side)
    return None


def _degrees(r: Reader) -> tuple[float, float] | None:
    lat = _angle(r, 2, ("n", "s"))
    if lat is None or not r.parted():
        return None
    lon = _angle(r, 3, ("e", "w"))
    return None if lon is None else (lat, lon)


#: How coordinates are written, in the order in which they are reported.
WRITTEN = (("labelled_decimal", _labelled), ("hemisphere_decimal", _hemispheres), ("degrees", _degrees))


def coordinates(text: str) -> list[tuple[str, str, float, float, int, int]]:
    """Valid coordinates in a text: kind, as written, latitude, longitude, place."""
    if not any(c.isdecimal() for c in text):
        return []
    r, out = Reader(text, lexemes(text)), []
    for kind, grammar in WRITTEN:
        k = 0
        while k < len(r.items):
            r.at = k
            point = grammar(r)
            k += 1
            if point is not None:
                start, stop = r.items[k - 1].start, r.items[r.at - 1].stop
                k = r.at
                if valid(*point):
                    out.append((kind, text[start:stop], *point, start, stop))
    return out


#: Names of an axis, and maps by a part of their host's name, or its end.
LATITUDES, LONGITUDES = ("latitude", "lat"), ("longitude", "lon", "lng")
MAPS_PART, MAPS_END = ("google.",), ("openstreetmap.org", "toolforge.org")


def tag_axes(text: str) -> tuple[set[float], set[float]]:
    """The values in range that tags such as ``geo:lat=1.5`` give each axis."""
    items = lexemes(text)
    out: tuple[set[float], set[float]] = set(), set()
    for k, x in enumerate(items):
        name = x.text.lower()
        axis = 0 if name.endswith(LATITUDES) else 1 if name.endswith(LONGITUDES) else None
        i = k + 1
        if axis is None or i >= len(items) or items[i].text not in "=:":
            continue
        i += 2 if i + 1 < len(items) and items[i + 1].text in "\"'" else 1
        if i < len(items) and items[i].number:
            value = float(items[i].text)
            if abs(value) <= (90, 180)[axis]:
                out[axis].add(value)
    return out


def tag_point(*texts: str | None) -> tuple[float, float] | None:
    """The valid pair of the first text with one value for each axis; none if a text on the way contradicts itself."""
    for text in texts:
        lat, lon = tag_axes(text or "")
        if len(lat) > 1 or len(lon) > 1:
            return None
        if lat and lon:
            return valid(lat.pop(), lon.pop())
    return None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _pair(text: str) -> tuple[float, float] | None:
    """The first two numbers with decimals and a comma between them."""
    items = lexemes(text)
    for a, comma, b in zip(items, items[1:], items[2:], strict=False):
        if comma.text == "," and a.number and b.number and a.decimals and b.decimals and a.whole <= 2 and b.whole <= 3:
            return valid(float(a.text), float(b.text))
    return None


def link_point(url: str | None) -> tuple[float, float] | None:
    """The point that a link to a map carries."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return None
    if not (any(p in host for p in MAPS_PART) or host.endswith(MAPS_END)):
        return None
    asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
    for a, b in (("mlat", "mlon"), ("lat", "lon")):
        if a in asked and b in asked:
            lat, lon = _number(asked[a]), _number(asked[b])
            return None if lat is None or lon is None else valid(lat, lon)
    for text in (asked.get("q", ""), asked.get("ll", ""), parts.path):
        if point := _pair(text):
            return point
    _, named, rest = parts.fragment.partition("map=")
    zoom, *axes = rest.split("/")
    if not named or not zoom.isdecimal() or len(axes) < 2:
        return None
    lat, lon = (next((x for x in lexemes(a) if x.number), None) for a in axes[:2])
    return valid(float(lat.text), float(lon.text)) if lat and lon and lat.whole <= 2 and lon.whole <= 3 else None


# --- on columns -----------------------------------------------------------------------


def _array(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(n, t()) for n, t in fields.items()]))


def once(find):
    """``find`` that looks at equal arguments once; for the rows of one batch."""
    known: dict = {}

    def found(*args):
        if args not in known:
            known[args] = find(*args)
        return known[args]

    return found


def _each(text: pd.Series, find, names: tuple[str, ...]) -> pd.Series:
    of = once(lambda t: [dict(zip(names, x, strict=False)) for x in find(t)])
    return pd.Series([of(t or "") for t in text], dtype=object, index=text.index)


@F.pandas_udf(_array(matched=StringType, excerpt=StringType, capture=BooleanType, spread=BooleanType, greeting=BooleanType, question=BooleanType))
def mention_signals(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """For each place (``starts``, ``stops``) of a text: what stands there, the text around it, and what that says."""
    of = once(lambda t, a, b: [m._asdict() for m in mentions(t, list(zip(a, b, strict=True)))])
    rows = zip(text, starts, stops, strict=True)
    return pd.Series([of(t or "", tuple(map(int, a)), tuple(map(int, b))) for t, a, b in rows], dtype=object, index=text.index)


@F.pandas_udf(_array(kind=StringType, text=StringType, lat=DoubleType, lon=DoubleType, excerpt=StringType))
def text_coordinates(text: pd.Series) -> pd.Series:
    """All valid coordinates written in a text.

    Labelled decimals come first, then decimals with hemispheres, then degrees with minutes
    and seconds (below 60); each kind in the order of the text.
    """

    def find(t: str) -> Iterator[tuple]:
        for kind, raw, lat, lon, start, stop in coordinates(t):
            yield kind, raw, lat, lon, cut_out(t, start, stop)

    return _each(text, find, ("kind", "text", "lat", "lon", "excerpt"))


_POINT = StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())])


def _points(found: list[tuple[float, float] | None], index: pd.Index) -> pd.DataFrame:
    both = [p or (None, None) for p in found]
    return pd.DataFrame({"lat": [p[0] for p in both], "lon": [p[1] for p in both]}, index=index, dtype="float64")


@F.pandas_udf(_POINT)
def link_points(url: pd.Series) -> pd.DataFrame:
    of = once(link_point)
    return _points([of(u) for u in url], url.index)


@F.pandas_udf(_POINT)
def tag_points(first: pd.Series, second: pd.Series, third: pd.Series) -> pd.DataFrame:
    of = once(tag_point)
    return _points([of(*t) for t in zip(first, second, third, strict=True)], first.index)


@F.pandas_udf(_array(expression=StringType, minutes=DoubleType, relation=StringType, narrative=StringType, excerpt=StringType))
def relative_times(text: pd.Series) -> pd.Series:
    """All phrases such as "two hours later": ``expression``, ``minutes``, ``relation`` (before, after), ``narrative``, ``excerpt``.

    ``narrative`` is what the 140 characters on either side are about.
    """
    return _each(text, timings, Timing._fields)


@F.pandas_udf(_array(time=StringType, expression=StringType, excerpt=StringType))
def clock_phrases(text: pd.Series) -> pd.Series:
    def find(t: str) -> Iterator[tuple]:
        for time, start, stop in clocks(t):
            yield time, t[start:stop], cut_out(t, start, stop)

    return _each(text, find, ("time", "expression", "excerpt"))


@F.pandas_udf(_array(locality=StringType, excerpt=StringType))
def locality_phrases(text: pd.Series) -> pd.Series:
    def find(t: str) -> Iterator[tuple]:
        for locality, start, stop in localities(t):
            yield locality, cut_out(t, start, stop)

    return _each(text, find, ("locality", "excerpt"))


def link_coordinates(url: Column) -> tuple[Column, Column]:
    """The point that a link to a map carries; null if it has none that is valid.

    ``mlat`` with ``mlon``, or ``lat`` with ``lon``, settle it, valid or not.  Else the first
    valid pair in ``q``, in ``ll`` or in the path counts, and last the fragment's.
    """
    found = link_points(url)
    return found["lat"], found["lon"]


def relative_minutes(text: Column) -> tuple[Column, Column]:
    """Minutes and relation (before, after) of the first phrase in :func:`relative_times`; null without one."""
    first = F.get(relative_times(text), 0)
    return first["minutes"], first["relation"]


def machine_tag_pair(*sources: Column) -> tuple[Column, Column]:
    """The valid pair of the first of up to three texts whose tags give one value for each axis.

    Values off the globe don't count; null if a text on the way contradicts itself.
    """
    found = tag_points(*sources, *[F.lit(None).cast("string")] * (3 - len(sources)))
    return found["lat"], found["lon"]
