from __future__ import annotations

import random
import re
from collections import Counter

from .oracle import compared
from pyspark.sql import functions as F

from logwarden.llm import oracles, quality, queries


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def test_query_equals_sql(spark, sf_dir):
    got, want = compared(queries.op8_quality(spark, sf_dir), oracles.OP8, sf_dir)
    assert got == want


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op8_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_measurements_of_edge_texts(docs_of):
    rng = random.Random(8)
    texts = [None, "", " ", "\n\n \n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\x0by\x0cz\rw\tv", "é 😀 é 😀 é 😀", "# | <> &\n# | <> &\n", " nbsp\x85word\x1cunit ", "a b " * 20000]
    texts += [" ".join(rng.choice("ab#") for _ in range(rng.randrange(40))) + "\n" * rng.randrange(3) for _ in range(60)]
    docs = docs_of([(k, t) for k, t in enumerate(texts)] + [(0, None), (None, "a b")]).withColumns(
        {n: F.lit(1) for n in ("n_words", "failed", "__words", "w", "kept")})
    got = quality.judged(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(k, *brute(t)) for k, t in enumerate(texts)] + [(0, *brute(None)), (None, *brute("a b"))]
    assert sorted([(r["doc_id"], *(r[n] for n in names)) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_policies_and_ablations_equal_direct_counts(corpus):
    entries = quality.ledger(corpus).persist()
    failed = [r["failed"] for r in entries.collect()]
    for row in quality.ablation(entries).collect():
        mask = quality.mask_of(quality.POLICIES[row["policy"]])
        bit = quality.mask_of((row["rule"],))
        assert row["n_failed"] == sum(f & bit != 0 for f in failed)
        assert row["n_only"] == sum(f & mask == bit for f in failed)
        assert row["n_kept"] == sum(f & mask == 0 for f in failed)
        assert row["n_kept_without"] == sum(f & mask & ~bit == 0 for f in failed)


def test_keeps_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = queries.op8_quality(spark, sf_dir).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert found.where("not kept").count() <= 0.01 * found.count()


def test_empty_table(docs_of):
    assert quality.judged(docs_of([])).count() == 0
    assert quality.ablation(quality.ledger(docs_of([]))).count() == 0
