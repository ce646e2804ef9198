from __future__ import annotations

import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from logwarden.llm import queries, rows, toxicity
from logwarden.llm.toxicity import Lexicon, Model, fold

SF = "/root/testdata/sf0.1"


def test_folding():
    assert fold("St​upid ѕtuріd STUPID ｓｔｕｐｉｄ $tup1d stup1d") == ["stupid"] * 6
    assert fold("1d10t 4711 a$$h 3.14 trash###") == ["idiot", "assh", "trash"]
    assert fold("Éré ñu ß") == ["éré", "ñu", "ß"] and fold("") == [] and fold("123 !!! ###") == []


def test_longest_terms_and_exceptions():
    lexicon = Lexicon({"tra": 1.0, "trash": 4.0, "clown": 2.0}, ("trash can", "clown fish"))
    joined = lambda text: [(f" {' '.join(fold(text))} "[a:b].strip(), w) for a, b, w in lexicon.hits(fold(text))]
    assert joined("trash trace ultra Trashy") == [("trash", 4.0), ("tra", 1.0), ("trash", 4.0)]
    assert joined("trash can, trash candy clown fish clown") == [("trash", 4.0), ("clown", 2.0)]
    assert lexicon.density("a trash can") == 0 and lexicon.density("a trash") == 2.0
    assert Lexicon({}).density("trash") == 0.0 and Lexicon({}, ()).density("trash") == 0.0


def test_held_out_accuracy(spark):
    found = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.02 * counts[0, 0]


def test_held_out_rows_and_other_columns_teach_nothing(spark, docs_of):
    rows = [(k, f"plain words number {'moron' if k % 3 == 0 else 'fine'} again {k}") for k in range(120)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id bigint, toxic int")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0
    one = toxicity.learn(docs, labels)
    other = toxicity.learn(docs.withColumn("source", F.lit("toxic")),
                           labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert one == other and set(one.terms) == {"moron"}
    got = {r["doc_id"]: r for r in toxicity.scores(docs, one).collect()}
    for k, _ in rows:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert got[k]["predicted"] == int(k % 3 == 0) and 0 <= got[k]["score"] <= 1


def test_edge_rows_and_clashing_columns(spark, docs_of):
    rows = [(1, None), (1, None), (2, ""), (None, "what a moron"), (3, "moron " * 50_000), (4, "clean")]
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("toxic", "score", "fold", "density", "thing")})
    model = Model({"moron": 3.0}, (), 0.1)
    got = toxicity.scores(docs, model).collect()
    assert sorted(((r["doc_id"], r["predicted"]) for r in got), key=str) == sorted(
        [(1, 0), (1, 0), (2, 0), (None, 1), (3, 1), (4, 0)], key=str)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 4]
    no_labels = spark.createDataFrame([(None, 1), (9, None)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, no_labels).terms == {}
    assert toxicity.scores(docs_of([]), toxicity.learn(docs_of([]), no_labels)).count() == 0
    assert toxicity.learn(docs, spark.createDataFrame([(3, 1), (3, 0)], "doc_id bigint, toxic int")).terms == {}


def test_a_large_batch_is_counted_in_little_memory():
    """A batch of many texts without a common word: a task holds some texts and counts at a time, and the sums are whole."""
    given = [(" ".join(f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}{'x' * (j % 8)}{chr(97 + j)}" for j in range(26)),
              k % 3 == 0) for k in range(9_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in given]), pa.array([b for _, b in given])], ["text", "toxic"])
    want = {b: Counter(x for t, toxic in given if toxic == b for x in toxicity.beginnings(fold(t))) for b in (False, True)}
    got = {False: Counter(), True: Counter()}
    for part in toxicity.partial_counts(iter([batch]), lambda text: toxicity.beginnings(fold(text))):
        assert part.num_rows < toxicity.THINGS + 1_000
        for thing, toxic, clean in zip(*(c.to_pylist() for c in part.columns)):
            got[True][thing] += toxic
            got[False][thing] += clean
    assert {b: +c for b, c in got.items()} == want and sum(map(len, want.values())) > 4 * toxicity.THINGS


def test_texts_are_made_some_at_a_time():
    column = pa.array(["ä" * 2_000, None] * 5_000)
    tracemalloc.start()
    assert sum(len(t) for t in rows.texts(column)) == 10_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # all of them together take twice and more
