from __future__ import annotations

import datetime
import os
from collections import deque

import pytest
from conftest import entries_of
from pyspark.sql import functions as F

from logwarden.catalog.queries import QUERIES
from logwarden.operators import activity, mask
from logwarden.operators import rules as R
from logwarden.options import Options
from logwarden.sources import files, tail
from logwarden.sources.landing import fresh_folder
from logwarden.streaming import detect, stateful

LINE = '10.0.0.%d - - [15/Jan/2024:10:%02d:%02d +0000] "%s %s HTTP/1.1" %d 5 "-" "Mozilla"'


def line(ip=1, minute=0, second=0, method="GET", path="/", status=200):
    return LINE % (ip, minute, second, method, path, status)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)
    tail.register(spark)


class Tail:
    """One tail query over a folder; every ``step`` is a run from its checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.options = spark, options
        self.paths = f"{folder}/*.log"
        self.table, self.state = fresh_folder(spark, "tail"), fresh_folder(spark, "tail-state")

    def step(self):
        reader = self.spark.readStream.format("growing_log").option("paths", self.paths)
        for key, value in self.options.items():
            reader = reader.option(key, value)
        query = (
            reader.load().writeStream.format("parquet").option("path", self.table)
            .option("checkpointLocation", self.state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if not os.path.exists(self.table):
            return []
        rows = self.spark.read.parquet(self.table).orderBy("file_path", "byte_offset").collect()
        return [r.raw_line for r in rows]


def test_tail_reads_what_was_appended(spark, tmp_path):
    log = tmp_path / "a.log"
    run = Tail(spark, tmp_path)
    log.write_text("one\n\ntwo\nhal")
    assert run.step() == ["one", "two"]
    with log.open("a") as f:
        f.write("f\nthree\r\n")
    assert run.step() == ["one", "two", "half", "three"]
    assert run.step() == ["one", "two", "half", "three"]
    (tmp_path / "b.log").write_text("other\n")
    assert run.step()[-1] == "other"


def test_tail_after_rotation_and_truncation(spark, tmp_path):
    log = tmp_path / "a.log"
    run = Tail(spark, tmp_path)
    log.write_text("one\ntwo\n")
    assert run.step() == ["one", "two"]
    log.rename(tmp_path / "a.log.1")
    log.write_text("new file one\nnew file two\n")
    assert sorted(run.step()) == ["new file one", "new file two", "one", "two"]
    log.write_text("x\n")
    assert "x" in run.step()


def test_tail_splits_large_files_at_line_ends(spark, tmp_path):
    texts = [f"line {i} " + "y" * (i % 37) for i in range(500)]
    (tmp_path / "a.log").write_text("\n".join(texts) + "\n")
    assert Tail(spark, tmp_path, span_bytes=100).step() == texts
    reader = tail.GrowingLogReader({"paths": str(tmp_path / "a.log"), "span_bytes": "100"})
    spans = reader.partitions({}, reader.latestOffset())
    assert len(spans) > 50 and all(s.end - s.start < 200 for s in spans)


def test_tail_takes_in_a_bounded_amount_at_a_time(spark, tmp_path):
    texts = [f"line {i}" for i in range(100)] + ["z" * 400]
    path = tmp_path / "a.log"
    path.write_text("\n".join(texts) + "\n")
    reader = tail.GrowingLogReader({"paths": str(path), "max_bytes_per_file": "100"})
    seen, start = [], {}
    for _ in range(100):
        end = reader.latestOffset()
        if end == start:
            break
        for span in reader.partitions(start, end):
            seen += [row[1] for row in reader.read(span)]
        start = end
    assert seen == texts


def test_tail_feeds_the_detection(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(
        line(second=i, method="POST", path="/login", status=401) + "\n" for i in range(6)))
    lines = spark.readStream.format("growing_log").option("paths", f"{tmp_path}/*.log").load()
    paths = detect.run_once(spark, detect.path_counts(detect.signal_rows(lines)), detect.PATH_KEYS)
    (row,) = detect.window_findings(detect.window_counts(paths)).collect()
    assert (row.rule, row.actor, row.n, row.source_label) == ("bruteforce", "10.0.0.1", 6, "a.log")


def test_shipped_files_and_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, state = fresh_folder(spark, "t"), fresh_folder(spark, "s")

    def run():
        lines = files.stream_lines(spark, str(folder), {"web": "web"}, max_files=1)
        stream = detect.path_counts(detect.signal_rows(lines))
        detect.write_keyed(stream, table, state, once=True).awaitTermination()
        counts = detect.window_counts(detect.latest(spark, table, detect.PATH_KEYS))
        return {(r.actor, r.rule): r.n for r in detect.window_findings(counts).collect()}

    tries = lambda n, ip: "".join(
        line(ip, 0, i, "POST", "/login", 401) + "\n" for i in range(n))
    (folder / "web-1.log").write_text(tries(5, 1) + tries(3, 2))
    assert run() == {("10.0.0.1", "bruteforce"): 5}
    # the second file lifts the count of the first one's window: state outlived the restart
    (folder / "web-2.log").write_text(tries(2, 2) + tries(1, 1))
    assert run() == {("10.0.0.1", "bruteforce"): 6, ("10.0.0.2", "bruteforce"): 5}


def test_repeats_of_a_finding_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    texts = [line(1, m, s, "POST", "/login", 401) for m in (0, 6, 12) for s in range(5)]
    texts += [line(2, 3, s, path=f"/x{s}", status=404) for s in range(5)]
    texts.append(line(9, 59))
    (src / "a.log").write_text("\n".join(texts) + "\n")
    lines = files.stream_lines(spark, str(src))
    paths = detect.path_counts(detect.signal_rows(lines), delay="1 minute")
    counts = detect.window_counts(paths)
    once = detect.first_per_actor(detect.window_findings(counts))
    table, state = fresh_folder(spark, "t"), fresh_folder(spark, "s")
    once.writeStream.format("parquet").option("path", table).option(
        "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert sorted((r.rule, r.actor, r.n) for r in rows) == [
        ("bruteforce", "10.0.0.1", 5), ("path_fuzz", "10.0.0.2", 5)]


def test_table_and_stream_count_alike(spark, sf_dir):
    from logwarden.catalog import derived as D

    options = Options().overlay({"rules": {"brute_force_threshold": 2, "path_fuzz_threshold": 2}})
    rows = detect.signal_rows(D.access_lines(spark, sf_dir))
    paths = detect.path_counts(rows, options, "1 day")
    table = detect.window_findings(detect.window_counts(paths, options), options)
    want = {(r.window_start.timestamp(), r.actor, r.rule, r.n) for r in table.collect()}
    got = {(r.window_start, r.actor, r.rule, r.n)
           for r in QUERIES["stream_detect"](spark, sf_dir).collect()}
    assert {(int(a), b, c, d) for a, b, c, d in want} == got


def staged(spark, tmp_path, batches, schema):
    """A stream that takes in one of ``batches`` (lists of rows) at a time, in order."""
    folder = str(tmp_path / "stage")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("b"):
                target = os.path.join(folder, f"b{i}.parquet")
                os.rename(os.path.join(folder, name), target)
                os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "b*.parquet").parquet(folder)


def test_sessions_of_stream_and_table(spark, tmp_path):
    rows = [{"at": t, "ip": ip} for ip, ts in {"a": [0, 5, 9, 40], "b": [3, 30, 31]}.items() for t in ts]
    entries = entries_of(spark, rows)
    want = {(r.actor, r.start, r.n) for r in activity.sessions(entries, ["actor"], 10).collect()}
    stream = staged(spark, tmp_path, [entries.collect()], entries.schema)
    counted = detect.session_counts(stream, ["actor"], "10 seconds").withColumn(
        "start", F.unix_seconds("start"))
    # sessions are complete only when the watermark passes, so the sink takes whole results
    query = counted.writeStream.outputMode("complete").format("memory").queryName("sess").option(
        "checkpointLocation", fresh_folder(spark, "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.actor, r.start, r.n) for r in spark.table("sess").collect()}
    assert got == want and len(got) == 4


def test_token_epochs_of_stream_and_table(spark, tmp_path):
    rows = [{"at": t, "ip": ip} for t in range(0, 3000, 7) for ip in ("a", "b") if t % (3 if ip == "a" else 5)]
    schema = "value string, epoch bigint, ts timestamp"
    seen = entries_of(spark, rows).select(
        F.col("actor").alias("value"), F.unix_seconds("ts").alias("epoch"), "ts")
    want = {tuple(r)[:3] for r in mask.token_epochs(seen.drop("ts"), 100).collect()}
    data = sorted(seen.collect(), key=lambda r: r.epoch)
    thirds = [data[:200], data[200:400], data[400:]]
    opened = stateful.stream_token_epochs(staged(spark, tmp_path, thirds, schema), 100)
    got = {tuple(r) for r in detect.run_once(spark, opened, ["value", "epoch_no"]).collect()}
    assert got == want


def test_approvals_with_timers(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    schema = "alert_id string, kind string, at timestamp"
    batches = [
        [("a", "alert", at(0)), ("b", "alert", at(0)), ("c", "alert", at(1)), ("x", "approve", at(2))],
        [("a", "approve", at(10)), ("b", "reject", at(20)), ("a", "reject", at(30))],
        [("d", "alert", at(1000)), ("c", "approve", at(1000))],
        [("e", "alert", at(2000))],
    ]
    states = stateful.stream_approvals(staged(spark, tmp_path, batches, schema), 300)
    rows = detect.run_once(spark, states, ["alert_id", "status"]).collect()
    ms = lambda s: int((at(s) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    got = {(r.alert_id, r.status): r.at_ms for r in rows}
    assert {k for k in got if k[1] != "pending"} == {
        ("a", "approved"), ("b", "rejected"), ("c", "expired"), ("d", "expired")}
    assert got[("a", "approved")] == ms(10) and got[("c", "expired")] == ms(301)


def consume_by_hand(rows, size, threshold):
    out, recent = set(), {}
    for seq, source, shard, actor, failed in sorted(rows):
        kept = recent.setdefault((source, shard), deque(maxlen=size))
        kept.append((seq, actor, failed))
        mine = [r for r in kept if r[2] and r[1] == actor]
        if failed and len(mine) >= threshold:
            out.add((source, shard, actor, mine[0][0], seq, len(mine)))
            recent[(source, shard)] = deque((r for r in kept if r not in mine), maxlen=size)
    return out


def test_context_with_consumption(spark, sf_dir):
    from logwarden.catalog import derived as D

    rows = detect.signal_rows(D.access_lines(spark, sf_dir)).select(
        "seq", "source_label", (F.conv(F.substring(F.md5("actor"), 1, 8), 16, 10).cast("bigint") % 16).cast("int"), "actor",
        R.is_failed_login())
    want = consume_by_hand([tuple(r) for r in rows.collect()], 30, 3)
    got = {(r.source_label, r.shard, r.actor, r.first_seq, r.last_seq, r.n)
           for r in QUERIES["context_consume"](spark, sf_dir).collect()}
    assert got == want and want


def test_context_lives_across_batches(spark, tmp_path):
    rows = [(i, "s", "a" if i % 3 else "b", i % 4 != 0) for i in range(60)]
    schema = "seq bigint, source_label string, actor string, failed boolean"
    stream = staged(spark, tmp_path, [rows[:7], rows[7:31], rows[31:]], schema)
    found = stateful.context_consume(stream, context_rows=10, threshold=3, shards=1)
    got = {(r.source_label, 0, r.actor, r.first_seq, r.last_seq, r.n)
           for r in detect.run_once(spark, found, ["actor", "last_seq"]).collect()}
    assert got == consume_by_hand([(i, s, 0, a, f) for i, s, a, f in rows], 10, 3)


def test_tail_finishes_a_file_rotated_between_plan_and_read(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\n")
    reader = tail.GrowingLogReader({"paths": str(path)})
    end = reader.latestOffset()
    spans = reader.partitions({}, end)
    os.rename(path, tmp_path / "a.log.1")
    path.write_text("new\n")
    assert [r[1] for s in spans for r in reader.read(s)] == ["one", "two"]
    with open(tmp_path / "a.log.1", "a") as old:
        old.write("three\nhalf")
    later = reader.latestOffset()
    texts = [r[1] for s in reader.partitions(end, later) for r in reader.read(s)]
    assert texts == ["three", "half", "new"]
    # read to its end, the old file may go
    os.rename(tmp_path / "a.log.1", tmp_path.parent / f"{tmp_path.name}-gone")
    assert reader.partitions(later, reader.latestOffset()) == []


def test_tail_fails_rather_than_skip_what_is_gone(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\n")
    for on_lost in ("fail", "skip"):
        reader = tail.GrowingLogReader({"paths": f"{tmp_path}/*.log", "on_lost": on_lost})
        end = reader.latestOffset()
        (span,) = reader.partitions({}, end)
        os.rename(path, tmp_path.parent / f"{tmp_path.name}-{on_lost}")
        path.write_text("one\n")
        if on_lost == "fail":
            with pytest.raises(FileNotFoundError):
                list(reader.read(span))
            with pytest.raises(RuntimeError, match="gone before its end"):
                reader.latestOffset()
        else:
            assert list(reader.read(span)) == []
            assert len(reader.partitions(end, reader.latestOffset())) == 1


def test_tail_reads_a_rotated_file_once_though_its_new_name_matches(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\n")
    reader = tail.GrowingLogReader({"paths": f"{tmp_path}/a.log*"})
    end = reader.latestOffset()
    os.rename(path, tmp_path / "a.log.1")
    path.write_text("two\n")
    later = reader.latestOffset()
    assert [r[1] for s in reader.partitions(end, later) for r in reader.read(s)] == ["two"]


def test_rolling_counts_of_rows_out_of_order(spark):
    """Parts that overlap by less than the delay: every second once, as over a table; old state is dropped."""
    import random

    rng = random.Random(2)
    start = 1_700_000_000
    rows = [(start + part * 100 + rng.randrange(-30, 100), rng.choice("xxxxyz")) for part in range(5) for _ in range(60)]
    folder, table, state = (fresh_folder(spark, f"rolling-{n}") for n in ("in", "out", "state"))
    schema = "ts timestamp, actor string"
    for part in range(6):
        mine = rows[part * 60:(part + 1) * 60] or [(start + 10_000, "tick")]
        spark.createDataFrame([(datetime.datetime.fromtimestamp(t, datetime.UTC), a) for t, a in mine], schema).write.mode(
            "append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        out = stateful.stream_rolling(stream, ["actor"], 50, "135 seconds")
        query = out.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(
            availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.actor, r.epoch, r.n, r.rolling) for r in spark.read.schema(out.schema).parquet(table).collect())
    assert all(p.stateOperators[-1].numRowsDroppedByWatermark == 0 for p in query.recentProgress)
    want = []
    for actor, epoch in sorted({(a, t) for t, a in rows}):
        mine = [t for t, a in rows if a == actor]
        want.append((actor, epoch, mine.count(epoch), sum(epoch - 50 < t <= epoch for t in mine)))
    assert got == want
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 1


def test_rolling_counts_of_many_actors_share_calls_of_the_state(spark, monkeypatch):
    """As over a table, with missing actors and numbers for keys, and with few values in the state for many actors."""
    import random

    stateful.use_rocksdb(spark)
    rng = random.Random(4)
    start = 1_700_000_000
    rows = [(start + part * 100 + rng.randrange(100), rng.choice([None, *range(2**53 + 1, 2**53 + 40)]), rng.choice("ab"))
            for part in range(2) for _ in range(300)]
    folder, table, state = (fresh_folder(spark, f"shared-{n}") for n in ("in", "out", "state"))
    schema = "ts timestamp, actor bigint, source_label string"
    held = []
    for mine in (rows[:300], rows[300:], [(start + 1000, 0, "tick")]):
        spark.createDataFrame([(datetime.datetime.fromtimestamp(t, datetime.UTC), a, s) for t, a, s in mine], schema).write.mode(
            "append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        out = stateful.stream_rolling(stream, ["actor", "source_label"], 50, "10 seconds", buckets=3)
        query = out.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(
            availableNow=True).start()
        query.awaitTermination()
        held += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert dict(out.dtypes)["actor"] == "bigint"
    got = sorted((r.source_label, str(r.actor), r.epoch, r.n, r.rolling) for r in spark.read.schema(out.schema).parquet(table).collect())
    want = []
    for label, actor, epoch in {(s, a, t) for t, a, s in rows}:
        mine = [t for t, a, s in rows if (a, s) == (actor, label)]
        want.append((label, str(actor), epoch, mine.count(epoch), sum(epoch - 50 < t <= epoch for t in mine)))
    assert got == sorted(want)
    assert 0 < max(held) <= 3
