from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from logwarden.llm import licenses, queries


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = licenses.WORD.findall(lowered)
    hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
            if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in hits]
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in hits})))


def row_of(r):
    return tuple(r[n] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir, corpus_rows):
    got = {r["doc_id"]: r for r in queries.op2_licenses(spark, sf_dir).collect()}
    for doc_id, text in corpus_rows:
        assert row_of(got[doc_id]) == brute_base(text)
        assert set(filter(None, got[doc_id]["base_labels"].split(","))) <= set(got[doc_id]["labels"].split(","))
        assert 0 <= got[doc_id]["score"] <= 1
    assert len(got) == len(corpus_rows) and any("apache-2.0" in r["labels"] for r in got.values())


def distance_inside(notice, text):
    """Fewest edits of the notice against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(notice, 1):
        last, row = row, [k] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b))
    return min(row)


def test_fuzzy_search_equals_edit_distance():
    rng = random.Random(6)
    pairs = (("a", "released under the mit license"), ("b", "all rights reserved"), ("c", "gnu general public license"))
    for _ in range(300):
        label, notice = rng.choice(pairs)
        chars = list(notice)
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(chars))
            chars[k:k + 1] = rng.choice([[], [rng.choice("abc ")], [chars[k], rng.choice("xyz")]])
        text = licenses.normal(("some words " + "".join(chars) + " and more").encode())
        found = {f.label for f in licenses.fuzzy(text, pairs, licenses.PER_EDIT)}
        want = {name for name, n in pairs if distance_inside(n, text) <= len(n) // licenses.PER_EDIT}
        assert found == want, (text, found, want)


def test_spans_name_the_words():
    text = licenses.normal(b"Foo bar. Relased under the MIT Licence, all right reserved")
    found = {f.label: f for f in licenses.fuzzy(text, tuple((k, v) for k, some in licenses.NOTICES.items() for v in some), 12)}
    assert (found["mit"].first_word, found["mit"].last_word) == (2, 6) and 0 < found["mit"].score < 1
    assert (found["reserved"].first_word, found["reserved"].last_word) == (7, 9)


def test_edge_rows_and_clashing_columns(docs_of):
    rows = [(1, None), (1, None), (2, ""), (3, "..."), (None, "CC-BY, cc by/CC by"), (4, "cc by cc by"),
            (5, "All rights reserved. " * 3000), (6, "GENERAL public\nlicenſe general-public-license"), (7, "ccby all rights")]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("n_words", "labels", "score", "notices")})
    got = licenses.scan(docs).collect()
    assert sorted(((r["doc_id"], *row_of(r)) for r in got), key=str) == sorted(((i, *brute_base(t)) for i, t in rows), key=str)
    assert all(r["score"] == 0 and r["labels"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert licenses.scan(docs_of([])).count() == 0


PAIRS = tuple((label, text) for label, some in licenses.NOTICES.items() for text in some)


def test_repeated_notices_are_all_found():
    """As many spans as copies, whatever was misspelled in which."""
    rng = random.Random(4)
    for label, notice in (("reserved", "all rights reserved"), ("gpl", "gnu general public license")):
        for _ in range(40):
            copies = []
            for _ in range(rng.randrange(1, 7)):
                chars = list(notice)
                for _ in range(rng.randrange(len(notice) // licenses.PER_EDIT + 1)):
                    k = rng.randrange(1, len(chars) - 1)
                    if chars[k] != " ":
                        chars[k:k + 1] = rng.choice([["z"], [], [chars[k], "z"]])
                copies.append("".join(chars))
            text = licenses.normal(" ".join(copies).encode())
            found = [f for f in licenses.fuzzy(text, ((label, notice),), licenses.PER_EDIT) if f.label == label]
            assert len(found) == len(copies), (text, found)
            for f, copy in zip(sorted(found, key=lambda f: f.first_word), copies):
                assert f.edits == distance_inside(notice, f" {copy} ")
    text = licenses.normal(b"all rights reservd all rights reserved all rights rezerved")
    assert [(f.first_word, f.last_word, f.edits) for f in licenses.fuzzy(text, (("r", "all rights reserved"),), 12)] == [
        (0, 2, 1), (3, 5, 0), (6, 8, 1)]


def test_near_misses_cost_little():
    """A megabyte of beginnings of notices, alike and each a little different, in seconds."""
    rng = random.Random(8)
    begin = "permission to use copy modify and "
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for text in (begin * 30_000, "".join(f"{begin}{word()} " for _ in range(25_000)), "all rights " * 90_000,
                 "".join(f"gnu general {word()} license " for _ in range(40_000)),
                 "".join(f"permission to use copy modify {word()} or distribute {word()} software for " for _ in range(14_000))):
        start = time.perf_counter()
        licenses.fuzzy(licenses.normal(text.encode()), PAIRS, licenses.PER_EDIT)
        assert time.perf_counter() - start < 10, text[:60]
