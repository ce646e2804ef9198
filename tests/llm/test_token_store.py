from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm import queries, token_store, tokens
from logwarden.sources.landing import land


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(token_store.VOCABULARY))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def brute(rows, whole):
    """(doc_id, start, n_tokens, crc) of documents in order of id; equal ids by place in the files."""
    out, start = [], 0
    for name, text in rows:
        ids = np.array([*whole(text), 0], "<u4")
        out.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 3000))
    ids = rng.integers(0, [1, 2, 300, 50_257, 2**31, 2**32][seed], n, dtype=np.uint32)
    ids[rng.random(n) < 0.05] = rng.integers(0, 2**32, dtype=np.uint32)
    for percentile in (0, 50, 90, 100):
        data, starts = token_store.encode(ids, percentile)
        assert (token_store.decode(data, starts).reshape(-1)[:n] == ids).all()
        if n > 600:
            assert (token_store.decode(data, starts[1:2])[0] == ids[256:512]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(256, dtype=np.uint32) % 16 + 1000
    small = len(token_store.encode(ids)[0])
    ids[7] = 2**32 - 1
    assert small == 8 + 32 * 4 and len(token_store.encode(ids)[0]) == small + 5


def test_checksums_of_pieces():
    data = bytes(random.Random(3).randbytes(1000))
    for cut in (0, 1, 500, 999, 1000):
        assert token_store.shifted(zlib.crc32(data[:cut]), 1000 - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def test_query_equals_the_tokenizer(spark, sf_dir, corpus_rows, whole):
    got = [tuple(r) for r in queries.op13_token_store(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == brute(sorted(corpus_rows, key=lambda r: r[0]), whole)


TEXTS = [
    None, "", " ", "\n\n", "a", " a  b\t\tc \n", "it's we'll I'D 'tis ''s", "<|endoftext|> as text", "x1y22 333,.;!? \x00\x1c\x7f",
    "naïve Überstraße ×÷ ª²³ ¼", "日本語 と English 😀😀     end", "word  word \u0085 x", "a " * 3000, "z" * 5000, "é" * 300,
    "tabs\t \tand  spaces   　 　x", " lead", "trail ", "\r\n mixed \r\n", "don’t “quote” — dash…",
]


def test_ids_equal_the_tokenizers_on_edge_texts(whole, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 40)
    mine = tokens.ByteTokenizer(tokens.vocabulary_path(token_store.VOCABULARY))
    rng = random.Random(5)
    pieces = ["a", "B", " ", "  ", "\n", "'s", "é", "ß", "1", "-", "…", "語", " ", "\x1f", "😀", "\t", "'"]
    for text in [t for t in TEXTS if t] + ["".join(rng.choices(pieces, k=rng.randrange(90))) for _ in range(400)]:
        assert mine.ids(text).tolist() == whole(text), repr(text)


@pytest.mark.parametrize("chunk", [256, 1024, token_store.CHUNK])
def test_chunks_split_documents(spark, docs_of, whole, chunk):
    rows = list(enumerate(TEXTS))
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("file", "chunk", "n", "__text", "__row", "ordinal")})
    got = token_store.documents(land(token_store.write(docs, chunk=chunk), "ids")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, whole)


def test_repeated_and_null_ids(spark, docs_of, whole):
    rows = [(None, "b"), (None, None), (7, "same text")] + [(7, "same text")] * 40 + [(7, "other"), (3, "x y")]
    got = token_store.stored(docs_of(rows).repartition(5)).collect()
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in brute(rows, whole))
    places = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:])) and places[0][0] == 0
    assert [p[2] for p in places] == [None, None, 3] + [7] * 42


def test_reads_single_blocks(spark, docs_of, whole):
    written = land(token_store.write(docs_of([(1, "a b c " * 1000), (2, "x")]), chunk=512), "ids")
    ids = [*whole("a b c " * 1000), 0]
    file = written.where(F.array_contains("doc_ids", 1)).first()["file"]
    for begin, end in ((0, 1), (250, 260), (500, 1300), (len(ids) - 1, len(ids)), (0, len(ids))):
        got = sorted(tuple(r) for r in token_store.ids_between(written, file, begin, end).collect())
        assert got == list(enumerate(ids))[begin:end]


def test_empty_table(docs_of):
    assert token_store.stored(docs_of([])).count() == 0
