from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logwarden.llm import divergence, oracles, queries

from .oracle import compared


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(rows, min_docs, top):
    """Rows of (text, lang, source)."""
    rows = [(words(t), l or "", s or "") for t, l, s in rows]
    held = defaultdict(Counter)
    for w, lang, _ in rows:
        held[lang].update(set(w))
    kept = {lang: {t for t, d in held[lang].items() if d >= min_docs} for lang in held}
    counts, langs = defaultdict(Counter), defaultdict(Counter)
    for w, lang, source in rows:
        known = [t for t in w if t in kept[lang]]
        counts[lang, source].update(known)
        langs[lang].update(known)

    def p(counter, lang, term):
        return 1 + 10**9 * (counter[term] + 2) // (sum(counter.values()) + 2 * len(kept[lang]))

    def apart(x, y):
        return (x - y) ** 2 // (x + y)

    out = []
    for lang, source in counts:
        mine = counts[lang, source]
        pairs = [(sum(apart(p(mine, lang, t), p(counts[lang, other], lang, t)) for t in kept[lang]), other)
                 for l, other in counts if l == lang and other != source]
        terms = [(apart(p(mine, lang, t), p(langs[lang], lang, t)), t) for t in kept[lang]
                 if mine[t] and p(mine, lang, t) > p(langs[lang], lang, t)]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            found = found if part == "pair" else found[:top]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def made_up(seed, n=90, sources=5, vocabulary=60):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "z", "ß", "語", "Q"]
    known = ["".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(vocabulary)]
    return [(rng.choice([" ", "1", "\n-", "_"]).join(rng.choices(known, k=rng.randrange(30))),
             rng.choice(["en", "de", None, ""]), rng.choice([None, *(f"s{k}" for k in range(sources))])) for _ in range(n)]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_equals_sql(spark, sf_dir):
    got, want = compared(queries.op12_divergence(spark, sf_dir), oracles.OP12, sf_dir)
    assert got == want


@pytest.mark.parametrize("bits, tile, cells, held", [(64, 64, 1 << 20, 10**6), (4, 2, 8, 50), (1, 3, 20, 1), (64, 1, 1, 7)])
def test_equals_brute_force(spark, monkeypatch, bits, tile, cells, held):
    for name, value in (("TILE", tile), ("CELLS", cells), ("HELD", held), ("SLICE", 3), ("STRETCH", 10)):
        monkeypatch.setattr(divergence, name, value)
    rows = made_up(bits)
    got = rows_of(divergence.audit(table_of(spark, rows).repartition(4), min_docs=3, top=4, bits=bits))
    assert got == brute(rows, 3, 4)


def test_defined_cases(spark):
    rows = [("word " * 5, "xx", None)] * 12 + [(None, "xx", "a"), ("", "xx", "b"), ("rare", "yy", "a"), (None, "yy", "b"), ("w", None, None)]
    rows += [("tie" + c + " same", "zz", s) for c in "abc" for s in ("p", "q", "p") for _ in range(10)]
    docs = table_of(spark, rows).withColumns({n: F.lit(1) for n in ("digest", "term", "part", "n", "place", "tiles", "value")})
    assert rows_of(divergence.audit(docs)) == brute(rows, 10, 10)
    assert divergence.audit(table_of(spark, [])).count() == 0


def test_long_texts_are_cut_between_terms():
    text = ("ab é9" * 50).encode()
    for size in (1, 2, 3, 7):
        divergence.STRETCH, kept = size, divergence.STRETCH
        try:
            assert sum(divergence.term_lists(text), []) == [w.encode() for w in words(text.decode())]
        finally:
            divergence.STRETCH = kept


def test_only_digests_are_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = divergence.cells(divergence.counted(docs), ["lang", "digest"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search(r"Exchange.*term", plan)
