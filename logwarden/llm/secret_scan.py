"""Secrets in texts: fixed patterns, and literals assigned to names that sound secret.

Source code and configuration are read around every ``:`` and ``=``: the name before it
(dotted, quoted, in brackets, with a type annotation) and the literal after it (quoted,
triple-quoted, joined by ``+`` or side by side, or bare) form a pair. A name on the right
stands for the literal last given to it, so a constant's literal is judged by
every name it reaches. A pair's score is how secret the name sounds times how much the
literal looks like a secret.

Three fixed patterns are always reported: ``assign``, ``access`` and ``hex``. Spans of the
method are ``literal`` (assigned to the name itself) and ``const`` (reached through another name).
Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans. Repeated rows are scanned one by one.
Extra columns are ignored by ``spans`` and kept by ``redact``. Time and memory are linear in a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase, digits
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logwarden.llm.rows import texts, type_of

#: The base patterns, taken apart at their operator so that texts are searched for it alone.
BASE_NAME = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*\Z")
BASE_VALUE = re.compile(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
LONGEST_BASE_NAME = len("password") + 1

KINDS = ("assign", "access", "hex", "literal", "const")

#: How secret the parts of a name sound (0 to 1), and parts that say it is about a secret, not one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.7,
    "key": 0.5, "private": 0.5, "access": 0.4, "api": 0.4, "signing": 0.5, "encryption": 0.5, "client": 0.2, "dsn": 0.6,
}
ABOUT = {"count", "length", "len", "size", "name", "type", "file", "path", "field", "label", "hint", "url", "id", "min",
         "max", "limit", "expiry", "ttl", "public", "foreign", "primary", "sort", "index"}
PLACEHOLDER = re.compile(
    r"(?ai:change_?me|example|placeholder|your[_-].*|x+|\*+|none|null|true|false|todo|test|redacted|<.*>|\$\{.*\}|\{\{.*\}\})")
THRESHOLD = 0.4

OPERATOR = re.compile(r"[:=]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
QUOTED = re.compile(r'[rbfuRBFU]?(?:"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\\n]|\\.)*`)')
JOIN = re.compile(r"[ \t]*\+?[ \t]*(?=[rbfuRBFU]?[\"'`])")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?(?=[ \t]*(?:[;,)\]}#\n]|\Z))")
IN_BARE = r"[^\s\"'`,;(){}\[\]<>=&]"
#: Equals signs belong to a bare literal as padding only if no value follows them.
BARE = re.compile(rf"{IN_BARE}+(?:=+(?!=|{IN_BARE}))?")
YOURS = re.compile(r"(?ai:your[_-])")
IN_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")


class Span(NamedTuple):
    """A secret: the whole match, the value in it, and its score."""

    start: int
    kind: int
    end: int
    value_start: int
    value_end: int
    score: float


def base_spans(text: str) -> Iterator[Span]:
    """Leftmost matches of the fixed patterns that are long enough."""
    done = 0
    for operator in OPERATOR.finditer(text):
        at = operator.start()
        # spaces are stepped over first, so that any number of them is allowed
        stem = at
        while stem > done and text[stem - 1] == " ":
            stem -= 1
        name = BASE_NAME.search(text, max(done, stem - LONGEST_BASE_NAME), stem)
        value = BASE_VALUE.match(text, at) if name else None
        if value:
            done = value.end()
            if len(value[1]) >= LEAST_VALUE:
                yield Span(name.start(), 0, done, value.start(1), done, 1.0)
    for found in ACCESS.finditer(text):
        if found.end() - found.start() >= LEAST_ACCESS:
            yield Span(found.start(), 1, found.end(), found.start(), found.end(), 1.0)
    for found in HEX.finditer(text):
        yield Span(found.start(), 2, found.end(), found.start(), found.end(), 1.0)


def name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before ``at`` (spaces, quotes and closing brackets skipped) and where it begins."""
    while at and text[at - 1] in " \t\"'`])":
        at -= 1
    end = at
    while at and text[at - 1] in IN_NAME:
        at -= 1
    return text[at:end], at


def targets(text: str, at: int, typed: bool = True) -> tuple[list[str], list[str]]:
    """Names that an operator at ``at`` assigns to, and those of them that may be used as constants.

    A name after ``other:`` may be the type of ``other`` or a name of its own (``Note: NAME=value``): both are
    judged, but a type is no constant. ``typed`` tells whether a type is looked for.
    """
    name, begin = name_before(text, at)
    names = [name] if name else []
    constants = names
    if name and typed and text[at] == "=":
        colon = begin
        while colon and text[colon - 1] in " \t":
            colon -= 1
        if colon and text[colon - 1] == ":":
            annotated, _ = name_before(text, colon - 1)
            if annotated:
                names = [annotated, name]
                constants = names if begin + len(name) == at else [annotated]
    return names, constants


class Literal(NamedTuple):
    """A literal: how much it looks like a secret, and where it is."""

    score: float
    start: int
    end: int
    quoted: bool
    parts: int


def joined_strings(text: str, found: re.Match[str]) -> Literal | None:
    """The literal that begins with the string found, strings joined; none if it is empty."""
    value, at = [], found.start()
    while found:
        value.append(found[0].lstrip("rbfuRBFU").strip(found[0][-1]))
        end = found.end()
        joined = JOIN.match(text, end)
        found = QUOTED.match(text, joined.end()) if joined else None
    whole = "".join(value)
    return Literal(value_score(whole, True), at, end, True, len(value)) if whole else None


class Bare:
    """A stretch of text without spaces, quotes and brackets, and the literals that begin after each ``:`` in it."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.scores: dict[int, float] = {}

    def literal(self, at: int) -> Literal:
        if at == self.start:
            score = value_score(self.text[at : self.end], False)
        else:
            self.scores = self.scores or self.inner_scores()
            score = self.scores[at]
        return Literal(score, at, self.end, False, 1)

    def inner_scores(self) -> dict[int, float]:
        """``value_score`` of what follows each ``:``, all in one pass from the end."""
        counts: Counter[str] = Counter()
        found, weight = {}, 0.0  # weight: sum of n log2 n over the counts
        for at in range(self.end - 1, self.start - 1, -1):
            char, size = self.text[at], self.end - at - 1
            if char == ":" and size:
                plain = PLACEHOLDER.fullmatch(self.text, at + 1, self.end) if not counts[":"] else YOURS.match(self.text, at + 1)
                mixed = [any(counts[c] for c in some) for some in (ascii_lowercase, ascii_uppercase, digits)]
                few = size < LEAST_VALUE or plain or not mixed[2]
                found[at + 1] = 0.0 if few else shape_score(math.log2(size) - weight / size, sum(mixed))
            n = counts[char] = counts[char] + 1
            weight += n * math.log2(n) - ((n - 1) * math.log2(n - 1) if n > 1 else 0.0)
        return found


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    whole = "".join(parts)
    best = min(1.0, sum(SENSITIVE.get(p, 0.0) for p in parts))
    for word, weight in SENSITIVE.items():
        if len(word) > 5 and word in whole:
            best = max(best, weight)
    return best * (0.3 if parts and ABOUT.intersection(parts[-1:] + parts[:1]) else 1.0)


def shape_score(bits: float, mixed: int) -> float:
    return min(1.0, min(1.0, bits / 3.5) * (0.7 + 0.15 * mixed))


def value_score(value: str, quoted: bool) -> float:
    """0 for placeholders and short or spaced words, towards 1 for long values of many different characters."""
    if len(value) < LEAST_VALUE or PLACEHOLDER.fullmatch(value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    mixed = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value))))
    score = shape_score(bits, mixed)
    if not quoted and not re.search("[0-9]", value):
        return 0.0  # a bare word is prose, a type or another name
    return score * (0.4 if re.search(r"\s", value) else 1.0)


def assigned_spans(text: str) -> Iterator[Span]:
    """Literals that are assigned to secret names, directly or through constants."""
    constants: dict[str, Literal] = {}
    last, done = -2, 0
    bare: Bare | None = None
    for operator in OPERATOR.finditer(text):
        at = operator.start()
        if at < done:
            continue  # inside a chain of strings: no text is read again and again
        if at == last + 1 or text[at + 1 : at + 2] == "=" and text[at] == "=":
            last = at  # the second half of := or ==
            if text[at - 1 : at + 1] != ":=":
                continue
        last = at
        # an = that pads a value is none of the value's name, but may still stand after a name of its own
        padding = bare is not None and bare.start < at < bare.end and text[at] == "=" and value_score(
            text[bare.start : bare.end], False) > 0
        names, kept = targets(text, at - 1 if text[at - 1 : at + 1] == ":=" else at, not padding)
        if not names:
            continue
        begin = at + 1
        while begin < len(text) and text[begin] in " \t>":
            begin += 1
        reference = REFERENCE.match(text, begin)
        reached = constants.get(reference[1]) if reference else None
        literal = reached
        quoted = None if reached else QUOTED.match(text, begin)
        if quoted:
            literal = joined_strings(text, quoted)
        elif not reached:
            # what follows a : inside a bare stretch ends with the stretch, which is not read again
            if not bare or not bare.start < begin < bare.end:
                found = BARE.match(text, begin)
                bare = Bare(text, begin, found.end()) if found else None
            literal = bare.literal(begin) if bare else None
        if not literal:
            continue
        if not reached and literal.parts > 1:
            done = literal.end
        for name in names:
            if name in kept:
                constants[name] = literal
            score = name_score(name) * literal.score
            if score >= THRESHOLD:
                start, end = literal.start, literal.end
                yield Span(start, 4 if reached else 3, end, start, end, round(score, 6))


def find(text: str) -> list[Span]:
    """All spans of a text, sorted, each once."""
    best: dict[tuple[int, int, int], Span] = {}
    for span in (*base_spans(text), *assigned_spans(text)):
        key = span[:3]
        if key not in best or best[key].score < span.score:
            best[key] = span
    return [best[key] for key in sorted(best)]


SPAN = "array<struct<start:bigint,kind:string,`end`:bigint,value_start:bigint,value_end:bigint,score:double>>"


def as_rows(found: list[Span]) -> list[dict]:
    return [s._asdict() | {"kind": KINDS[s.kind]} for s in found]


def spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and its spans, sorted by start, kind and end."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()),
                               ("value_start", pa.int64()), ("value_end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_rows(find(t)) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.selectExpr("doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, spans {SPAN}")


def without_secrets(text: str, mask: str) -> str:
    """The text with every value replaced; overlapping values become one mask."""
    parts, at = [], 0
    values = sorted((s.value_start, s.value_end) for s in find(text))
    for k, (begin, end) in enumerate(values):
        if begin >= at:
            parts += [text[at:begin], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secret values masked in ``text``; texts without any, and null, stay as they are."""
    column = "text"

    @F.pandas_udf("string")
    def masked(values):
        return values.map(lambda t: t if t is None else without_secrets(t, mask))

    return docs.withColumn(column, masked(F.col(column).cast("string")))
