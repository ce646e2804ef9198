from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from logwarden.llm import queries, simhash
from logwarden.llm.components import components


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = {k: plain_print(t) for k, (_, t) in enumerate(rows)}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = roots_of(pairs, list(prints))
    least = {}
    for k, r in roots.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], f"{prints[k]:016x}", least.get(roots[k])) for k in prints), key=str)


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir, corpus_rows):
    got = sorted((tuple(r) for r in queries.op3_simhash(spark, sf_dir).collect()), key=str)
    assert got == brute(corpus_rows)


def test_edge_texts_ids_and_clashing_columns(spark, docs_of):
    rows = [(7, None), (3, ""), (5, " \t"), (None, "one two"), (None, "one two"), (9, "ONE\ttwo"), (9, "ONE\ttwo"),
            (4, "a b c d e " * 5000), (2, "a b c d e " * 5000), (11, "İ ß É"), (12, "lone")]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("fp", "root", "key", "component_id", "text_hash")})
    got = simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 9, 2, 11, 12], key=str)


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.deduplicate(docs_of([])).count() == 0


def test_links_find_every_pair_once(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            prints.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in
           simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()]
    assert sorted(got) == sorted((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 400)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5)]
    pairs += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = roots_of([p for p in pairs if p[0] != p[1]], nodes)
    assert set(got) == nodes
    groups = {}
    for n in nodes:
        groups.setdefault(want[n], set()).add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")) is None
