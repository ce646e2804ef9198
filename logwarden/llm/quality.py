"""Quality rules evaluated once into a ledger of failure bits; policies are masks over them.

``ledger`` measures each text and sets one bit per failed rule. A policy is a version and
the set of rules it enforces; applying it is one bitwise AND, so new policies and
their ablations need no second look at the texts. ``ablation`` counts documents per
distinct failure mask (at most 2 to the number of rules, combined before the shuffle)
and answers from these counts how many documents each rule alone keeps out.

All of it is DataFrame expressions. Repeated word windows are found within a row: windows
are sorted with their places, equal neighbours are repeats, and the words they cover are
summed up over the sorted places.

Defined cases: null and empty texts have no words and fail ``few_words``. Ratios of
nothing are 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: What separates words, and the characters counted as symbols.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Fails where the condition holds; conditions read the measurements' columns."""

    name: str
    fails: Callable[[], Column]


def per_word(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("n_words"), F.lit(1))


#: The order is the bits' order: rules are only ever added at the end.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    Rule("short_words", lambda: per_word("word_chars") < 3.0),
    Rule("long_words", lambda: per_word("word_chars") > 16.0),
    Rule("symbols", lambda: per_word("n_symbols") > 0.2),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") > 0.4 * F.col("n_lines")),
    Rule("huge", lambda: F.col("n_words") > 100_000),
)

#: Policies by version: the rules that reject a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "huge"),
}
POLICY = "v1"


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Columns that are computed one time, whatever reads them: a generator of one row is in between."""
    made = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.inline(F.array(made)))


def placed_windows(words: Column) -> Column:
    """The array's three-word windows with their places, sorted."""
    n = F.size(words)
    windows = F.when(n >= 3, F.zip_with(
        F.zip_with(F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), lambda a, b: F.concat_ws(" ", a, b)),
        F.slice(words, 3, n - 2), lambda ab, c: F.concat_ws(" ", ab, c)))
    return F.sort_array(F.transform(
        F.coalesce(windows, F.array().cast("array<string>")), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))


def equal_neighbours(placed: Column) -> Column:
    """From sorted (window, place): the places of windows that have an equal neighbour, ascending."""
    nothing = F.array(F.lit(None).cast("struct<w:string,i:int>"))
    n = F.size(placed)
    like_next = F.zip_with(
        placed, F.concat(F.slice(placed, 2, F.greatest(n, F.lit(1))), nothing),
        lambda x, y: F.when(x["w"] == y["w"], x["i"]))
    like_last = F.zip_with(
        placed, F.concat(nothing, placed), lambda x, y: F.when(x["w"] == y["w"], x["i"]))
    return F.sort_array(F.filter(F.zip_with(like_next, like_last, lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()))


def covered(places: Column) -> Column:
    """Words that windows of three at these ascending places cover."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, state, lambda s, p: F.struct(
        (s["n"] + (p + 3 - F.greatest(s["end"], p))).alias("n"), (p + 3).alias("end")))["n"]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = once(docs.select("doc_id", "text"), __words=F.filter(
        F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != ""))
    rows = once(
        rows,
        __placed=placed_windows(F.col("__words")),
        __lines=F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != ""),
    )
    rows = once(rows, __places=equal_neighbours(F.col("__placed")))
    big = lambda c: c.cast("bigint")
    return rows.select(
        "doc_id", big(F.size("__words")).alias("n_words"), big(F.length(without(text, SPACE))).alias("word_chars"),
        big(F.length(text) - F.length(without(text, SYMBOLS))).alias("n_symbols"),
        big(F.size("__lines")).alias("n_lines"),
        big(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        covered(F.col("__places")).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and ``failed``: bit k is set if rule k fails."""
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return once(measured(docs), failed=bits)


def apply(entries: DataFrame, mask: int) -> Column:
    """Whether an entry of the ledger passes all rules of a mask."""
    return entries["failed"].bitwiseAND(F.lit(mask).cast("bigint")) == 0


def ablation(entries: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES,
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule of it: documents that fail the rule, only the rule, and that are kept with and without it."""
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"))
    steps = [(version, name, mask_of(names, rules), mask_of((name,), rules))
             for version, names in policies.items() for name in names]
    each = masks.select("failed", "n", F.inline(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("mask"),
                 F.lit(b).cast("bigint").alias("bit")) for p, r, m, b in steps])))
    of_policy = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(of_policy == F.col("bit")).alias("n_only"),
        count(of_policy == 0).alias("n_kept"),
        count(of_policy.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def judged(docs: DataFrame, version: str = POLICY, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; what the base rules reject is never kept."""
    entries = ledger(docs)
    base = apply(entries, mask_of(POLICIES["base"]))
    return entries.select("*", (~base).alias("base_failed"), (base & apply(entries, mask_of(policies[version]))).alias("kept"))
