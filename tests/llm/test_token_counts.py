from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm import queries, token_counts, tokens


def brute(ids, end):
    """(document, start, n_tokens, complete) of one file."""
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, k - start, True))
            start = k + 1
    return out + [(len(out), start, len(ids) - start, False)] * (start < len(ids))


def files_of(spark, files, block):
    rows = [(name, k // block, bytearray(np.array(ids[k:k + block], "<u2").tobytes()))
            for name, ids in files.items() for k in range(0, max(len(ids), 1), block)]
    return spark.createDataFrame(rows, "file string, block bigint, data binary")


def rows_of(frame):
    return sorted((r["file"], r["document"], r["start"], r["n_tokens"], r["complete"]) for r in frame.collect())


@pytest.mark.parametrize("block, group", [(1, 2), (3, 2), (7, 1024), (1000, 1024)])
def test_scan_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    rng = random.Random(block)
    files = {f"f{k}": [rng.choice([5, 6, 7, 9, 9 if k % 2 else 5]) for _ in range(rng.randrange(0, 60))] for k in range(8)}
    files |= {"none": [5] * 20, "all": [9] * 20, "empty": [], "one": [9]}
    got = rows_of(token_counts.count_tokens(files_of(spark, files, block), 9))
    assert got == sorted((name, *row) for name, ids in files.items() for row in brute(ids, 9))


def test_query_equals_the_tokenizers_counts(spark, sf_dir, corpus_rows):
    whole = Tokenizer.from_file(tokens.vocabulary_path(token_counts.VOCABULARY))
    whole.encode_special_tokens = True
    want = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in corpus_rows)
    got = queries.op6_token_counts(spark, sf_dir).collect()
    assert sorted(r["n_tokens"] for r in got) == want and all(r["complete"] for r in got)


def test_edge_texts(spark, docs_of):
    rows = [(1, None), (1, None), (2, ""), (None, "<|endoftext|> as text"), (3, "word " * 30_000)]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("file", "block", "data", "n_tokens")})
    path = tokens.vocabulary_path(token_counts.VOCABULARY)
    end = Tokenizer.from_file(path).token_to_id(token_counts.END)
    files = token_counts.flat_files(docs.coalesce(1), path, block=1000)
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(files, end).collect())[:3] == [0, 0, 0]
    assert max(r["n_tokens"] for r in token_counts.count_tokens(files, end).collect()) == 30_000
    assert token_counts.corpus_token_counts(docs_of([])).count() == 0


def test_files_on_disk(spark, tmp_path):
    ids = np.array([5, 9, 6, 6, 9, 9, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = token_counts.read_files(spark, [str(tmp_path)], block=2)
    assert [r[1:] for r in rows_of(token_counts.count_tokens(files, 9))] == brute(ids.tolist(), 9)
