"""Fresh tokens after the time to live, on tables and on streams, and replies that are asked for once."""

from __future__ import annotations

import datetime

from conftest import entries_of
from pyspark.sql import functions as F

from logwarden.operators import epochs, mask, scoring
from logwarden.options import MaskOptions
from logwarden.sources.landing import fresh_folder
from logwarden.streaming import detect, stateful
from test_streaming import staged

OPTIONS = MaskOptions(salt="s", token_ttl=100)


def test_tokens_change_with_the_epoch_and_resolve(spark):
    at = [0, 40, 100, 101, 150, 201, 202, 500, 601]
    rows = [{"seq": k, "at": t, "line": f"10.1.1.1 asked {t} and mail@x.example"} for k, t in enumerate(at)]
    rows += [{"seq": 50, "at": 90, "line": "10.1.1.2 asked"}, {"seq": 51, "at": 91, "line": "nothing here"}]
    masked = mask.mask_hashed(entries_of(spark, rows), OPTIONS)
    found = epochs.epoch_occurrences(masked, OPTIONS)
    own = {r.seq: r for r in found.where("original = '10.1.1.1'").collect()}
    assert [own[k].epoch_no for k in range(9)] == [1, 1, 1, 2, 2, 2, 3, 4, 5]
    assert len({own[k].token for k in range(9)}) == 5 and len({own[k].hashed for k in range(9)}) == 1
    lines = {r.seq: r.sanitized_line for r in epochs.mask_epochs(masked, found).collect()}
    assert all(own[k].token in lines[k] and "10.1.1" not in lines[k] for k in range(9))
    assert lines[51] == "nothing here"
    dictionary = epochs.epoch_dictionary(found)
    start = datetime.datetime(2024, 1, 1)
    asked = spark.createDataFrame(
        [(k, own[k].token, start + datetime.timedelta(seconds=at[k])) for k in range(9)]
        + [(99, own[0].token, start + datetime.timedelta(seconds=101))], "seq bigint, token string, asked_at timestamp")
    got = {r.seq: r.original for r in mask.resolve_tokens(asked, dictionary, OPTIONS.token_ttl).collect()}
    assert got == {k: "10.1.1.1" for k in range(9)} | {99: None}


def test_a_hot_value_meets_its_epochs_in_slices(spark):
    """Rows of one value are spread over as many keys as there are slices of time."""
    rows = spark.range(20_000).select(F.lit("hot").alias("value"), F.col("id").alias("epoch"))
    opened = mask.token_epochs(rows, 100)
    got = epochs.with_epochs(rows, opened, 100)
    assert got.count() == 20_000
    assert got.where("epoch_start is null or epoch < epoch_start or epoch > epoch_start + 100").count() == 0
    assert got.select("epoch_no").distinct().count() == -(-20_000 // 101)


def test_old_values_leave_the_state(spark, tmp_path):
    stateful.use_rocksdb(spark)
    start = datetime.datetime(2024, 1, 1)
    at = lambda v, *ts: [(v, int((start - datetime.datetime(1970, 1, 1)).total_seconds()) + t, start + datetime.timedelta(seconds=t)) for t in ts]
    batches = [at("a", 0, 50, 101) + at("b", 0), at("a", 150) + at("c", 1000), at("b", 1001), at("c", 5000), at("d", 9000)]
    stream = staged(spark, tmp_path, batches, "value string, epoch bigint, ts timestamp")
    living = stateful.stream_living_epochs(stream, 100, "10 seconds")
    table, checkpoint = fresh_folder(spark, "t"), fresh_folder(spark, "s")
    query = detect.write_keyed(living, table, checkpoint, once=True)
    query.awaitTermination()
    zero = at("", 0)[0][1]
    got = {(r.value, r.epoch_start - zero, r.event) for r in spark.read.parquet(table).collect()}
    opened = {("a", 0), ("a", 101), ("b", 0), ("c", 1000), ("b", 1001), ("c", 5000), ("d", 9000)}
    assert {g[:2] for g in got if g[2] == "opened"} == opened
    # an epoch that another one replaced in its own batch needs no timer; the last one's is to come
    purged = {g[:2] for g in got if g[2] == "purged"}
    assert {("a", 101), ("b", 1001), ("c", 5000)} <= purged <= opened - {("a", 0), ("d", 9000)}
    # what the state still holds: the value of the last batch
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] <= 2


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scorer(prompts):
        for prompt in prompts:
            with open(calls / "asked", "a") as out:
                out.write(prompt + "\n")
        return [p.upper() for p in prompts]

    folder = fresh_folder(spark, "cache")
    rows = [(k, f"p{k % 7}" if k else None) for k in range(500)]
    frame = spark.createDataFrame(rows, "prompt_key int, text string")
    for n in range(3):
        got = scoring.score_once(frame, scorer, "text", "reply", scoring.reply_cache(spark, folder), at_once=2)
        assert got.columns == ["prompt_key", "text", "reply"]
        assert {(r.prompt_key, r.reply) for r in got.collect()} == {(k, t and t.upper()) for k, t in rows}
        assert got.count() == 500
    assert sorted((calls / "asked").read_text().split()) == [f"p{k}" for k in range(7)]
