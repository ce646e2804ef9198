from __future__ import annotations

import zlib
from collections import Counter

import pytest
from .oracle import compared
from pyspark.sql import functions as F

from logwarden.llm import oracles, queries, sharding
from logwarden.llm.sharding import Node, descend, tree_of


def test_query_equals_sql_and_keeps_its_law(spark, sf_dir):
    found = queries.op5_sharding(spark, sf_dir).persist()
    got, want = compared(found, oracles.OP5, sf_dir)
    assert got == want
    assert found.where("grown_shard <> shard and grown_shard <> 8").isEmpty()
    counts = found.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in counts.collect())


@pytest.mark.parametrize("run", [2, 65_536])
def test_edge_rows_and_repeats(docs_of, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = [(None, None), (None, None), (1, None), (2, ""), (3, "é😀"), (3, "other")] + [(7, "same")] * 9
    docs = docs_of(rows).withColumns({n: F.lit(1) for n in ("size", "shard", "slot", "part", "n", "base", "run", "law")})
    got = sharding.shard(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_empty_table(docs_of):
    assert sharding.shard(docs_of([])).count() == 0


def placed(spark, tree):
    keys = spark.range(20_000).select("id", descend(F.col("id").cast("string"), tree).alias("shard"))
    return {r["id"]: r["shard"] for r in keys.collect()}


def test_weights_and_confined_movement(spark):
    before = placed(spark, tree_of(8))
    assert all(abs(n - 2500) < 300 for n in Counter(before.values()).values())
    heavier = placed(spark, tree_of(8, weights={5: 3.0}))
    share = Counter(heavier.values())[5] / 20_000
    assert abs(share - 0.3) < 0.02
    # rows move into the region (4-7) whose weight grew, or within it; never among the others
    assert all(heavier[k] in (4, 5, 6, 7) for k in before if before[k] != heavier[k])
    assert all(heavier[k] == before[k] for k in before if before[k] in (6, 7) and heavier[k] in (6, 7))
    for shards in (4, 8, 12):
        small, large = placed(spark, tree_of(shards)), placed(spark, tree_of(shards + 1))
        assert all(large[k] in (small[k], shards) for k in small)
    with pytest.raises(ValueError):
        tree_of(0)
    with pytest.raises(ValueError):
        tree_of(2, weights={1: 0.0})
    assert placed(spark, Node("root", (Node("only", (), 1.0, 3),)))[5] == 3
