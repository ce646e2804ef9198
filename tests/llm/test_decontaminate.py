from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from .oracle import compared
from pyspark.sql import functions as F

from logwarden.llm import decontaminate, oracles, queries
from logwarden.llm.rows import flat_utf8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    """doc_id, n_words, n_hit, longest match (item, length, begin, item_begin) of every item, contaminated."""
    out = []
    for doc_id, text in docs:
        words, hit, best = words_of(text), set(), {}
        for item_id, passage in items:
            other, name = words_of(passage), "null" if item_id is None else str(item_id)
            size = min(window, len(other))
            for k in range(len(other) - size + 1 if other else 0):
                for i in range(len(words) - size + 1):
                    if words[i:i + size] != other[k:k + size]:
                        continue
                    hit |= set(range(i, i + size))
                    n = size
                    while i + n < len(words) and k + n < len(other) and words[i + n] == other[k + n]:
                        n += 1
                    best[name] = min(best.get(name, (0, 0, 0)), (-n, i, k)) if name in best else (-n, i, k)
        matches = [(name, -n, i, k) for name, (n, i, k) in sorted(best.items())]
        out.append((doc_id, len(words), len(hit), matches, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def row_of(r):
    return (r["doc_id"], r["n_words"], r["n_hit"], [tuple(m) for m in r["matches"]], r["contaminated"])


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_query_equals_sql(spark, sf_dir):
    got, want = compared(queries.op9_decontamination(spark, sf_dir), oracles.OP9, sf_dir)
    assert got == want and any(row for row in got)


def cases():
    rng = random.Random(9)
    draw = lambda n: " ".join(rng.choice(["a", "b", "É", "c9", "日本"]) for _ in range(n))
    items = [(k, draw(rng.choice([2, 4, 5, 9]))) for k in range(12)] + [(3, "zz zz"), (None, "lone Wolf"), (50, None), (51, ""), (10, "b a b a b a")]
    docs = [(k, draw(rng.randrange(0, 60))) for k in range(40)] + [(3, None), (3, None), (None, "a LONE wolf-lone,wolf"), (99, ""), (98, "zz.zz zz"), (97, "a b " * 3000)]
    return docs, items


def test_brute_force_with_small_windows_parts_and_blocks(spark, docs_of):
    rows, items = cases()
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in (
        "items", "N_WORDS", "n_hit", "contaminated", "item_id", "spans", "_spans", "matches", "__text", "__n_words", "__spans")})
    want = brute(rows, items, 4)
    for part_words, block_bytes in ((10**6, 10**6), (20, 64)):
        got = decontaminate.overlaps(docs, items_of(spark, items), 4, part_words, block_bytes).collect()
        assert sorted(map(row_of, got), key=str) == want
        for r in got:
            assert sum(e - b for b, e in r["spans"]) == r["n_hit"]
            assert all(x[1] < y[0] for x, y in zip(r["spans"], r["spans"][1:]))
            for _, length, begin, _ in r["matches"]:
                assert any(b <= begin and begin + length <= e for b, e in r["spans"])
        kept = decontaminate.decontaminate(docs, items_of(spark, items), 4, part_words, block_bytes)
        assert kept.columns == docs.columns
        clean = sorted((r[0] for r in want if not r[4]), key=str)
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == clean


def test_empty_tables(spark, docs_of):
    assert decontaminate.overlaps(docs_of([]), items_of(spark, [(1, "a b")])).count() == 0
    rows = decontaminate.overlaps(docs_of([(1, "a b"), (2, None)]), items_of(spark, [])).collect()
    assert [(r["n_words"], r["n_hit"], r["matches"], r["contaminated"]) for r in sorted(rows)] == [(2, 0, [], False), (0, 0, [], False)]


def test_suffix_array_and_longest_matches():
    rng = random.Random(1)
    for _ in range(60):
        words = np.array([rng.randrange(0, 4) for _ in range(rng.randrange(0, 200))] + [0], np.int32)
        depth = rng.choice([1, 3, 7, 40])
        array = decontaminate.suffix_array(words, depth)
        keys = [words[i:i + depth].tolist() for i in array]
        assert sorted(array.tolist()) == np.flatnonzero(words > 0).tolist()
        assert all(a <= b or a[: len(b)] == b or b[: len(a)] == a for a, b in zip(keys, keys[1:]))
    text = [" ".join(rng.choice("abc") for _ in range(300)), "x y z", "", "c c c c"]
    block = decontaminate.Block(*flat_utf8(pa.array(text)))
    items = [("1", " ".join(rng.choice("abcq") for _ in range(80))), ("2", "c c c c c"), ("3", "nowhere")]
    parts = decontaminate.Queries(items, 5)
    suffix, first, last, length = block.search(parts)
    found = {}
    for k, a, b, n in zip(suffix.tolist(), first.tolist(), last.tolist(), length.tolist()):
        for place in block.array[a:b].tolist():
            assert found.setdefault((k, place), n) == n
    want, at = {}, 0
    numbers = block.numbers(parts)
    for _, passage in items:
        size = len(passage.split())
        for k in range(at, at + size):
            for place in range(len(block.words)):
                n = 0
                while k + n < at + size and numbers[k + n] > 0 and block.words[place + n] == numbers[k + n]:
                    n += 1
                if n >= 5:
                    want[k, place] = n
        at += size
    assert found == want and max(want.values()) > 5


def test_parts_share_a_blocks_suffix_array(spark, docs_of, monkeypatch):
    rows, items = cases()
    made, real = [], decontaminate.suffix_array
    monkeypatch.setattr(decontaminate, "suffix_array", lambda *a: made.append(1) or real(*a))
    parts = [decontaminate.Queries([(str(i), t or "")], 4) for i, t in items]
    block = decontaminate.Block(*flat_utf8(pa.array([t or "" for _, t in rows])))
    n_hit, _, matches = decontaminate.against_all(block, parts)
    assert len(made) == 1
    assert [(int(n), [(m["item"], m["length"], m["begin"], m["item_begin"]) for m in found])
            for n, found in zip(n_hit, matches)] == [
        (r[2], [("None" if m[0] == "null" else m[0], *m[1:]) for m in r[3]]) for row in rows for r in brute([row], items, 4)]
    plan = decontaminate.overlaps(docs_of(rows), items_of(spark, items), 4, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
