from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import queries, runs


def brute(w, shortest=12):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(steps):
    a, b = [0], [0, 1]
    for _ in range(steps):
        a, b = b, b + a
    return b


def made_up(rng):
    """Words over few letters: at random, periodic from some place on, nested repetitions, Fibonacci words."""
    k, n = rng.choice([1, 2, 3, 5, 30]), rng.randrange(0, 120)
    w = [rng.randrange(k) for _ in range(n)]
    kind = rng.randrange(4)
    if kind == 1 and n:
        a, p = rng.randrange(n), rng.randrange(1, 20)
        w = [w[min(n - 1, a + (i - a) % p)] if i >= a else w[i] for i in range(n)]
    if kind == 2:
        x = [rng.randrange(k) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 5) + [rng.randrange(k)]
        w = (x * rng.randrange(1, 6))[:150]
    return fibonacci(rng.randrange(2, 9))[:150] if kind == 3 else w


def sequence_of(docs):
    words = np.array([x for d in docs for x in d], np.int64)
    end = np.zeros(len(words), bool)
    end[np.cumsum([len(d) for d in docs if d]) - 1] = True
    return words, end


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("shortest", [12, 3, 7])
def test_runs_equal_brute_force(seed, shortest):
    rng = random.Random(seed)
    for _ in range(15):
        docs = [made_up(rng) for _ in range(rng.randrange(1, 6))]
        docs += docs[:2]
        if not any(docs):
            continue
        first, last, period = runs.runs_of(*sequence_of(docs), shortest)
        got = sorted(zip(first.tolist(), (last - first).tolist(), period.tolist()))
        at = np.cumsum([0, *map(len, docs)]).tolist()
        assert got == sorted((s + a, n, q) for d, a in zip(docs, at) for s, n, q in brute(d, shortest))


def test_grammar_spells_its_text():
    rng = random.Random(2)
    for _ in range(40):
        words, end = sequence_of([made_up(rng) + [rng.randrange(9)] for _ in range(4)])
        g = runs.compress(words, end)

        def spelled(symbol):
            if symbol < g.words:
                return [symbol]
            return spelled(g.left[symbol - g.words]) + spelled(g.right[symbol - g.words])

        assert [w for s in g.rest for w in spelled(s)] == words.tolist()
        pairs = [(a, b) for a, b, e in zip(g.rest, g.rest[1:], g.end) if not e]
        places = {}
        for k, pair in enumerate(pairs):
            places.setdefault(pair, []).append(k)
        assert all(len(p) == 1 for p in places.values())
        for k in range(len(g.left)):
            assert words[g.first[k]:g.first[k] + g.size[k]].tolist() == spelled(g.words + k)


def test_long_repetitions_need_few_symbols_and_rounds():
    words = np.tile(np.arange(500), 400)
    end = np.zeros(len(words), bool)
    end[-1] = True
    g = runs.compress(words, end)
    assert len(g.rounds) < 100 and len(g.left) < 2000 and len(g.rest) < 20
    first, last, period = runs.runs_of(words, end)
    assert (first.tolist(), last.tolist(), period.tolist()) == ([0], [200_000], [500])
    for odd in ([7] * 300_001, fibonacci(22)):
        words = np.array(odd)
        end = np.zeros(len(words), bool)
        end[-1] = True
        assert runs.runs_of(words, end)[0][0] == 0


def row_of(doc_id, text):
    """The query's row, by brute force."""
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept))


def rows_of(frame):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, frame.select(names).collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, corpus_rows):
    # the brute force tries every period, so it takes all but the longest texts
    some = [(i, t) for i, t in corpus_rows if len(t or "") < 20_000]
    assert len(some) > 0.9 * len(corpus_rows)
    want = sorted((row_of(*r) for r in some), key=str)
    ids = {i for i, _ in some}
    got = [r for r in rows_of(queries.op11_runs(spark, sf_dir)) if r[0] in ids]
    assert got == want and sum(r[1] for r in want) > 10


def test_planted_periods_are_the_contracts(docs_of, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(200)))) for k in range(300)]
    rows += [(k, t) for k in range(300, 340) for t in (None, "", " \n", "one")]
    docs = docs_of(rows)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert rows_of(queries.op11_runs(None, "")) == sorted((row_of(*r) for r in rows), key=str)


def test_defined_cases(docs_of, monkeypatch):
    texts = [None, "", " \n\t ", "w", "a b " * 3000, "x " * 11, "x\x0by\x0cz\rw\tv x" * 9, "é 語 " * 12, "nb sp\x85 " * 20,
             ("line of words here\n" * 30 + "end. ") * 4]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 9)] * 3 + [(4, "a b " * 9)]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("runs", "n_words", "start", "length", "period", "w")})
    monkeypatch.setattr(runs, "BLOCK_WORDS", 50)
    got = sorted((tuple(r) for r in runs.scan(docs).collect()), key=str)
    want = []
    for name, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        if len(w) > 3000:
            found = [(0, 6000, 2)]
        else:
            found = brute(w)
        dropped = {k for s, length, q in found for k in range(s + q, s + length)}
        want.append((name, len(w), found, " ".join(x for k, x in enumerate(w) if k not in dropped)))
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in got] == sorted(want, key=str)


def test_empty_table(docs_of):
    assert runs.scan(docs_of([])).count() == 0
