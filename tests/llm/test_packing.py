from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm import packing, queries, tokens


@pytest.fixture(scope="module")
def tokenizer():
    whole = Tokenizer.from_file(tokens.vocabulary_path(packing.VOCABULARY))
    whole.encode_special_tokens = True
    return whole


def check(rows, pieces, tokenizer, capacity=4096):
    """Every id lies in exactly one piece, and the sequences are whole."""
    wanted = defaultdict(list)
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[doc_id].append(np.array(ids, "<u4"))
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(got) == set(wanted)
    for doc_id, docs in wanted.items():
        have = sorted((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in got[doc_id])
        want = []
        for ids in docs:  # rows of one id are cut alike only if alone; cut each as found
            at = 0
            while at < len(ids):
                options = [p for p in have if p[0] == len(ids) and p[1] == at
                           and zlib.crc32(ids[at:at + p[2]].tobytes()) == p[3]]
                assert options, (doc_id, at)
                have.remove(options[0])
                want.append(options[0])
                at += options[0][2]
            assert at == len(ids)
        assert not have
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_query_over_the_whole_table(spark, sf_dir, corpus_rows, tokenizer):
    pieces = queries.op7_packing(spark, sf_dir).collect()
    padding = check(corpus_rows, pieces, tokenizer)
    assert padding <= 0.01 * sum(p["length"] for p in pieces)


def test_edge_texts(spark, docs_of, tokenizer):
    rows = [(1, None), (1, None), (2, ""), (None, "one. two"), (3, "a" * 9000), (4, "x. " * 9000), (5, " \n\t "),
            (6, "日本語のテキスト。 emoji 😀 mixed"), (7, "don't WE'LL <|endoftext|> Σας ﬁ x²³"), (7, "don't"),
            (8, "é café  nbsp line İstanbul 3.14 ½ ª")]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("start", "length", "offset", "sequence_id")})
    for n in (1, 4):
        check(rows, packing.pack(docs.repartition(n)).collect(), tokenizer)


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).count() == 0


def test_ids_equal_the_tokenizers(corpus_rows, tokenizer):
    own = tokens.WordTokenizer(tokens.vocabulary_path(packing.VOCABULARY))
    rng = random.Random(2)
    letters = "aZ'sté ßÀ.!#0 9\t\n ́²日İ😀ΣςḀ-_<|>"
    texts = [t for _, t in corpus_rows if t][:60]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in texts:
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def brute_cost(positions, cuts, capacity, powers):
    """Cheapest way to every position, trying all pairs."""
    at, best = [0, *positions], [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            length = at[j] - at[i]
            if length <= capacity:
                options.append(best[i] + (0 if length in powers else capacity - length))
        best.append(min(options) + cuts[j - 1] + packing.EACH)
    return at, best


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    capacity, powers = 64, {4, 8, 16, 32, 64}
    for _ in range(150):
        positions = np.cumsum([rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))])
        cuts = np.array([rng.choice([0, 8, 50]) for _ in positions])
        at, best = brute_cost(positions.tolist(), cuts.tolist(), capacity, powers)
        for last in (True, False):
            ends = packing.best_cuts(positions, cuts, capacity, last)
            cost, begin = 0, 0
            for end in ends:
                length = end - begin
                assert 0 < length <= capacity
                cost += packing.EACH + int(cuts[positions.tolist().index(end)])
                cost += 0 if length in powers else capacity - length
                begin = end
            if last:
                assert begin == positions[-1] and cost == best[-1]
            else:
                assert cost == min(c for p, c in zip(at, best) if p > at[-1] - capacity)


def test_stretches_join_without_loss(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 300)
    rng = random.Random(1)
    stream = packing.Stream(64, [7], 0)
    docs = [np.array([rng.randrange(9) for _ in range(rng.choice([1, 5, 40, 900]))], np.uint32) for _ in range(80)]
    for k, ids in enumerate(docs):
        stream.add(k, ids)
    stream.pack(last=True)
    got = defaultdict(int)
    for doc, start, length, crc, total, _, _ in stream.pieces:
        assert got[doc] == start and total == len(docs[doc])
        assert crc == zlib.crc32(docs[doc][start:start + length].tobytes())
        got[doc] += length
    assert all(got[k] == len(ids) for k, ids in enumerate(docs))
