"""License notices in texts: exact base phrases, and short notices with a few edits.

Texts are lowered (A-Z), cut into words and joined by single spaces. A notice that may
have k edits is split into k + 1 seeds; if it occurs with at most k edits, one seed occurs
as it is (pigeonhole). All seeds of all notices are found in one pass (Aho-Corasick). Every seed
has a window of its own, as long as the notice and k edits on both sides. Windows that can't hold it are
ruled out first: an edit spoils at most ``GRAM`` of a notice's runs of ``GRAM`` characters, so too many runs must not
be lacking, and the fewest edits up to each character (bit vectors of differences, one step a character) must
not exceed k. Then the regex library's matching with bounded errors, no more than these, says where the notice
is. Of overlapping matches of one notice that with the fewest edits stays, then
the first. Equal windows are judged once, so a text that repeats itself costs little.

Defined cases: null and empty texts have no words, no labels and score 0. Repeated rows are
scanned one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from logwarden.llm.rows import raw_texts, type_of

#: Words, and the base phrases with their labels.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices in normal form, by label. One edit is allowed for every ``PER_EDIT`` characters.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "mit": ("released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy"),
    "bsd": ("redistribution and use in source and binary forms with or without modification",
            "redistributions of source code must retain the above copyright notice"),
    "gpl": ("gnu general public license", "licensed under the gnu general public license version 3"),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2.0": ("mozilla public license version 2 0",),
    "epl": ("eclipse public license",),
    "cc-by": ("creative commons attribution", "licensed under cc by 4 0", "licensed under cc by nc 4 0"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "reserved": ("all rights reserved",),
    "public-domain": ("released into the public domain", "dedicated to the public domain"),
}
PER_EDIT = 12
GRAM = 4
#: Windows whose matches a worker remembers.
REMEMBERED = 100_000


class Notice(NamedTuple):
    label: str
    text: str
    edits: int
    patterns: tuple[regex.Pattern, ...]  # by number of edits
    grams: frozenset[str]
    masks: dict[str, int]


class Found(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int
    score: float


def seeds(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 parts of about equal length, and where each begins."""
    cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def grams_of(text: str) -> frozenset[str]:
    return frozenset(text[k:k + GRAM] for k in range(len(text) - GRAM + 1))


def masks_of(text: str) -> dict[str, int]:
    return {char: sum(1 << k for k, c in enumerate(text) if c == char) for char in set(text)}


def fewest_edits(masks: dict[str, int], size: int, window: str) -> tuple[int, int]:
    """The fewest edits between a notice and any part of the window, and where the first such part ends.

    ``masks`` has, for each character, the places where the notice has it. The column of edit distances to all
    beginnings of the notice is kept as the bits that rise and those that fall from one to the next.
    """
    full, top = (1 << size) - 1, 1 << size - 1
    rises, falls, edits = full, 0, size
    least, place = size, 0
    for k, char in enumerate(window, 1):
        same = masks.get(char, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        more, less = falls | ~(across | rises) & full, rises & across
        edits += bool(more & top) - bool(less & top)
        more, less = more << 1, less << 1
        rises, falls = (less | ~(down | more)) & full, more & down & full
        if edits < least:
            least, place = edits, k
    return least, place


@lru_cache(maxsize=REMEMBERED)
def verified(notices: tuple[tuple[str, str], ...], per_edit: int, k: int, window: str) -> tuple[int, int, int] | None:
    """Begin, end and edits of notice ``k`` in a window, with the fewest edits; the first of such."""
    notice = index(notices, per_edit)[0][k]
    size = len(notice.text)
    if len(notice.grams) - len(notice.grams & grams_of(window)) > GRAM * notice.edits:
        return None
    edits, end = fewest_edits(notice.masks, size, window)
    if edits > notice.edits:
        return None
    begin = max(0, end - size - edits)
    match = notice.patterns[edits].search(window, begin, end)
    return (match.start(), match.end(), sum(match.fuzzy_counts)) if match and match[0].strip() else None


@lru_cache(maxsize=4)
def index(notices: tuple[tuple[str, str], ...], per_edit: int) -> tuple[list[Notice], ahocorasick.Automaton]:
    """The notices, and an automaton from each seed to the notices and places in them that it stands for."""
    known, places = [], {}
    for label, text in notices:
        edits = len(text) // per_edit
        patterns = tuple(regex.compile(f"(?:{regex.escape(text, special_only=True)}){{e<={e}}}") for e in range(edits + 1))
        for at, seed in seeds(text, edits):
            places.setdefault(seed, []).append((len(known), at))
        known.append(Notice(label, text, edits, patterns, grams_of(text), masks_of(text)))
    automaton = ahocorasick.Automaton()
    for seed, where in places.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return known, automaton


def normal(text: bytes) -> str:
    """The words of a text, lowered, joined and surrounded by single spaces."""
    return " " + " ".join(WORD.findall(text.lower().decode("utf-8", "replace"))) + " "


def windows(text: str, known: list[Notice], automaton: ahocorasick.Automaton) -> dict[int, list[int]]:
    """Per notice, the places where it would begin by the seeds found, in order."""
    found: dict[int, set[int]] = {}
    for end, (size, where) in automaton.iter(text):
        for k, at in where:
            found.setdefault(k, set()).add(end + 1 - size - at)
    return {k: sorted(places) for k, places in found.items()}


def fuzzy(text: str, notices: tuple[tuple[str, str], ...], per_edit: int) -> list[Found]:
    """Notices in a normal text, with the numbers of their first and last words."""
    known, automaton = index(notices, per_edit)
    spaces: list[int] | None = None
    found = []
    for k, places in windows(text, known, automaton).items():
        notice = known[k]
        matches = set()
        for place in places:
            begin, stop = max(0, place - notice.edits), place + len(notice.text) + notice.edits
            match = verified(notices, per_edit, k, text[begin:stop])
            if match:
                a, b = begin + match[0], begin + match[1]
                matches.add((match[2], a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())))
        for edits, start, end in apart(matches):
            if spaces is None:
                spaces = [m.start() for m in re.finditer(" ", text)]
            found.append(Found(
                notice.label, bisect_right(spaces, start) - 1, bisect_right(spaces, end - 1) - 1,
                edits, round(1 - edits / len(notice.text), 6)))
    return sorted(found)


def apart(matches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches (edits, begin, end) without those that overlap one with fewer edits, or as many and an earlier begin."""
    kept: list[tuple[int, int]] = []  # in order of place, none overlapping
    out = []
    for edits, begin, end in sorted(matches):
        at = bisect_right(kept, (begin, end))
        if (at == 0 or kept[at - 1][1] <= begin) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (begin, end))
            out.append((edits, begin, end))
    return out


def base_places(text: str) -> list[tuple[int, int, str]]:
    """First word, number of words and label of every place of a base phrase in a normal text."""
    hits = []
    for phrase, label in BASE.items():
        at = text.find(f" {phrase} ")
        while at >= 0:
            hits.append((at, phrase.count(" ") + 1, label))
            at = text.find(f" {phrase} ", at + 1)
    places, word, last = [], 0, 0
    for at, size, label in sorted(hits):
        word += text.count(" ", last, at)
        last = at
        places.append((word, size, label))
    return places


FOUND = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:bigint,score:double>>"
SCHEMA = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          f"score double, notices {FOUND}")


def scan(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, per_edit: int = PER_EDIT) -> DataFrame:
    """Per row: doc_id, counts and places of base phrases, labels, score, and the notices found."""
    pairs = tuple((label, text) for label, some in (notices or NOTICES).items() for text in some)
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                               ("edits", pa.int64()), ("score", pa.float64())]))

    def one(raw: bytes) -> tuple:
        text = normal(raw)
        base, near = base_places(text), fuzzy(text, pairs, per_edit)
        labels = {label for _, _, label in base}
        score = max([1.0] * bool(base) + [f.score for f in near], default=0.0)
        return (
            text.count(" ") - 1 if text.strip() else 0, len(base), min((p[0] for p in base), default=None),
            max((p[0] for p in base), default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {f.label for f in near})), score, [f._asdict() for f in near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), kind]
        for batch in batches:
            columns = zip(*map(one, raw_texts(batch.column("text")))) if len(batch) else [[]] * len(kinds)
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id"] + names)

    rows = docs.selectExpr("doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, {SCHEMA}")
