"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick.

Texts are folded first: lower case, letters that look like Latin ones (Cyrillic, Greek, full
width) and digits or signs that stand for letters inside words become those letters; what is
left between words is one space. Lexicon terms are beginnings of folded words, so that one term
covers a word's forms. Only the longest term counts at a place, and none inside an
exception phrase. A text's density is the weight of its terms per word; its score is
density / (density + threshold), which is 0.5 where the density is at the threshold.

Training uses labelled rows whose crc32(doc_id) mod 5 is 1, 2 or 3 for the terms and
exceptions, and 4 for the threshold; remainder 0 is held out. At most ``SAMPLE`` labelled
rows are used (those with the smallest hashes of their ids), which bounds the broadcast of
their labels, and with it the telling terms and phrases that are in enough of them. Counting is
distributed, and only closed terms (no longer term is in the same documents) reach the driver; none
is cut.

Defined cases: null and empty texts have density and score 0. Null labels and ids are no
training rows; a doc_id labelled twice is toxic if any label says so. Without toxic rows the lexicon
is empty and all scores are 0. Repeated rows are scored alike. Extra columns are
ignored by ``scores`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logwarden.llm.rows import spare, texts
from logwarden.sources.landing import land

SAMPLE = 20_000
FOLDS = 5
#: Things that a task counts before it passes the counts on.
THINGS = 50_000
SHORTEST, LONGEST = 3, 12
#: Share of toxic documents among those with a term, and the chance (natural log) that luck alone does it.
PRECISION, LUCK = 0.8, -16.0
#: A phrase around a term is an exception if it is in so many clean training documents and hardly any toxic one.
EXCEPTION_SUPPORT, EXCEPTION_PRECISION = 5, 0.95

#: Letters that look like Latin ones, digits and signs used for letters, and harmless phrases.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ґ": "r", "α": "a", "ε": "e", "ο": "o", "τ": "t",
    "υ": "u", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "χ": "x", "γ": "y", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ո": "n", "ց": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "keep it simple stupid")

LETTER = "a-zß-öø-ÿœ"
IN_WORD = re.compile(f"(?<![0-9@$!])[013457@$!8]{{1,2}}(?=[{LETTER}])")
WORDS = re.compile(f"[{LETTER}]+")
PLAIN = re.compile(r"[\x00-\x7fÀ-ÿ]*")
BACK = str.maketrans(DIGITS)
LATIN = str.maketrans(LOOKALIKES)
INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])


def fold(text: str) -> list[str]:
    """The words of a text after folding."""
    text = text.lower()
    if not PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(LATIN).translate(INVISIBLE)
    text = IN_WORD.sub(lambda m: m[0].translate(BACK), text)
    return WORDS.findall(text)


def beginnings(words: Iterable[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Lexicon:
    """Terms with weights and exception phrases, as an automaton over folded texts."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> None:
        self.terms, self.exceptions = terms, tuple(exceptions)
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, None))
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in the joined words of the longest term at each place, exceptions left out."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                free.append((end - size, end))
            else:
                best[end + 1 - size] = (end + 1, weight)  # longer terms end later
        found, k = [], 0
        covered = -1
        for begin in sorted(best):
            while k < len(free) and free[k][0] <= begin:
                covered = max(covered, free[k][1])
                k += 1
            if begin >= covered:
                found.append((begin, *best[begin]))
        return found

    def density(self, text: str) -> float:
        words = fold(text)
        return sum(w for _, _, w in self.hits(words)) / len(words) if words else 0.0


class Model(NamedTuple):
    terms: dict[str, float]
    exceptions: tuple[str, ...]
    threshold: float


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic and fold of at most ``sample`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(F.col("doc_id")) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most ``sample`` rows of two numbers
    return rows.join(F.broadcast(known), "doc_id").select(
        "text", (F.col("toxic") > 0).alias("toxic"), remainder(F.col("doc_id")).alias("fold"))


def partial_counts(batches: Iterator[pa.RecordBatch], things: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    """(thing, toxic, clean) of a task's texts; what is counted is passed on whenever it holds ``THINGS`` things."""

    def summed(clean: Counter, toxic: Counter) -> pa.RecordBatch:
        names = sorted(clean.keys() | toxic.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
             pa.array([clean[n] for n in names], pa.int64())], ["thing", "toxic", "clean"])

    for batch in batches:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
            sums[toxic].update(things(text))
            if len(sums[0]) + len(sums[1]) >= THINGS:
                yield summed(*sums)
                sums = (Counter(), Counter())
        yield summed(*sums)


def counted(rows: DataFrame, things: Callable[[str], set[str]]) -> DataFrame:
    """(thing, toxic, clean): training documents with each thing that ``things(text)`` names."""
    parts = rows.select("text", "toxic").mapInArrow(
        lambda batches: partial_counts(batches, things), "thing string, toxic bigint, clean bigint")
    return parts.groupBy("thing").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def closed_terms(telling: DataFrame) -> DataFrame:
    """Terms without those that a term longer by one letter is found as often as."""
    longer = telling.select(F.expr("substring(thing, 1, length(thing) - 1)").alias("thing"), "toxic", "clean")
    return telling.join(longer, ["thing", "toxic", "clean"], "left_anti")


def weights(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Smoothed log odds of (term, toxic, clean) counts."""
    return {
        term: round(math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)), 6)
        for term, toxic, clean in sorted(found)
    }


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Terms, exception phrases and threshold from labelled rows that are not held out."""
    rows = training_rows(docs, labels, sample).persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.where(f"fold <> {FOLDS - 1}").groupBy("toxic").agg(
            F.count("*").alias("n")).collect()}
        n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
        if not n_toxic:
            return Model({}, exceptions, 1.0)
        base = n_toxic / (n_toxic + n_clean)
        first = rows.where(f"fold <> {FOLDS - 1}")
        both = F.col("toxic") + F.col("clean")
        luck = F.col("toxic") * math.log(base) if base < 1 else F.lit(0.0)
        tried = counted(first, lambda text: beginnings(fold(text)))
        telling = tried.where((F.col("toxic") >= PRECISION * both) & (F.col("toxic") >= 3)).withColumn("luck", luck)
        found = closed_terms(land(telling.where(F.col("luck") <= LUCK), "terms")).collect()
        terms = weights([(r["thing"], r["toxic"], r["clean"]) for r in found], n_toxic, n_clean)
        learned = learned_exceptions(first, Lexicon(terms, exceptions)) if terms else ()
        lexicon = Lexicon(terms, (*exceptions, *learned))
        return Model(terms, lexicon.exceptions, threshold(rows.where(f"fold = {FOLDS - 1}"), lexicon))
    finally:
        rows.unpersist()


def learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases with a term that are common in clean training documents and rare in toxic ones."""
    terms, exceptions = lexicon.terms, lexicon.exceptions

    def phrases(text: str) -> set[str]:
        words = fold(text)
        joined = f" {' '.join(words)} "
        found = set()
        for begin, _, _ in lexicon_of(terms, exceptions).hits(words):
            k = joined.count(" ", 0, begin + 1) - 1
            found |= {" ".join(words[j:j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1}
        return found

    seen = counted(rows, phrases)
    kept = seen.where((F.col("clean") >= EXCEPTION_SUPPORT) & (
        F.col("clean") >= EXCEPTION_PRECISION * (F.col("toxic") + F.col("clean"))))
    return tuple(sorted(r["thing"] for r in kept.collect()))


_BUILT: list = [None, None]


def lexicon_of(terms: dict[str, float], exceptions: tuple[str, ...]) -> Lexicon:
    """The automaton of a task's copy of a lexicon, built once."""
    if _BUILT[0] is not terms:
        _BUILT[:] = [terms, Lexicon(terms, exceptions)]
    return _BUILT[1]


def densities(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """``docs`` with the density of ``text`` under ``name``."""
    terms, exceptions = lexicon.terms, lexicon.exceptions
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(terms, exceptions)
        at = columns.index("text")
        for batch in batches:
            found = [own.density(t) for t in texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def threshold(rows: DataFrame, lexicon: Lexicon) -> float:
    """The density that separates labels best: the middle, in powers of two, of the best range of sixteenth steps."""
    least = 2.0 ** -16
    step = F.floor(16 * F.log2(F.greatest(F.col("density"), F.lit(least)))).cast("int")
    seen = densities(rows.select("text", "toxic"), lexicon, "density").groupBy(step.alias("step")).agg(
        F.sum(F.col("toxic").cast("int")).alias("toxic"), F.sum((~F.col("toxic")).cast("int")).alias("clean"))
    bins = {r["step"]: (r["toxic"], r["clean"]) for r in seen.collect()}  # a few hundred at most
    if not bins:
        return 2.0 ** -8
    low, high = min(bins), max(bins)
    right = {cut: sum(b for s, (_, b) in bins.items() if s < cut) + sum(a for s, (a, _) in bins.items() if s >= cut)
             for cut in range(low + 1, high + 2)}
    best = [cut for cut in right if right[cut] == max(right.values())]
    run_end = next((c for c in best if c + 1 not in right or right[c + 1] != right[c]), best[-1])
    return 2.0 ** ((best[0] + run_end) / 2 / 16)


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a score from 0 to 1 under ``name``."""
    found = densities(docs, Lexicon(model.terms, model.exceptions), name)
    return found.withColumn(name, F.col(name) / (F.col(name) + F.lit(model.threshold)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted. A null id is never held out."""
    rows = docs.selectExpr("doc_id", "cast(text as string) as text")
    return scored(rows, model, "score").select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, all columns kept."""
    name = spare(docs, "toxicity")
    return scored(docs, model, name).where(F.col(name) < 0.5).drop(name)
