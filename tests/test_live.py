"""The live pipeline: keyed tables, the outbox, failing channels, restarts and crashes."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F, types as T

from logwarden.options import Options
from logwarden.sources import files
from logwarden.sources.landing import fresh_folder
from logwarden.streaming import detect, live, stateful
from logwarden.streaming.keyed import KeyedTable

LINE = '10.0.0.%d - - [15/Jan/2024:10:%02d:%02d +0000] "%s %s HTTP/1.1" %d 5 "-" "Mozilla"'
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def tries(ip, minute, n, path="/login"):
    return "".join(LINE % (ip, minute, s, "POST", path, 401) + "\n" for s in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def values(table):
    return {r.k: r.v for r in table.read().collect()}


def test_keyed_table_keeps_the_latest_row_in_few_files(spark):
    folder = fresh_folder(spark, "keyed")
    table = KeyedTable(spark, folder, ["k"], SCHEMA, every=4, keep=2)
    assert values(table) == {}
    want = {}
    for batch in range(23):
        rows = [(f"k{batch % 5}", batch), (f"only{batch}", batch)]
        want |= dict(rows)
        assert table.put(rows_of(spark, rows), batch)
        assert {r.k for r in table.changed().collect()} == {k for k, _ in rows}
        # a replay, also by another process, changes nothing
        again = KeyedTable(spark, folder, ["k"], SCHEMA, every=4, keep=2)
        assert not again.put(rows_of(spark, [("k0", -1)]), batch)
    assert values(table) == want
    names = os.listdir(folder.removeprefix("file:"))
    # those of the last two versions: a snapshot and its deltas, perhaps the one before
    assert sum(n.startswith(("snapshot", "delta")) for n in names) <= 2 * (4 + 1)
    assert len(table._versions()) <= 2 + 4


def test_reader_sees_one_version(spark):
    table = KeyedTable(spark, fresh_folder(spark, "keyed"), ["k"], SCHEMA, every=3, keep=3)
    table.put(rows_of(spark, [("a", 1)]), 0)
    before = table.read()
    table.put(rows_of(spark, [("a", 2), ("b", 2)]), 1)
    assert [(r.k, r.v) for r in before.collect()] == [("a", 1)]
    assert values(table) == {"a": 2, "b": 2}
    # rows written, but no version that names them: as after a crash
    rows_of(spark, [("a", 9)]).withColumn("_version", F.lit(9).cast("bigint")).write.parquet(f"{table.folder}/delta-9-x")
    assert values(table) == {"a": 2, "b": 2}


def test_fold_drops_rows_at_compaction(spark):
    table = KeyedTable(spark, fresh_folder(spark, "keyed"), ["k"], SCHEMA, every=2,
                       fold=lambda rows: rows.where("v >= 2"))
    for batch in range(4):
        table.put(rows_of(spark, [(f"k{batch}", batch)]), batch)
    assert values(table) == {"k2": 2, "k3": 3}


class Sink:
    """A channel into a list, that fails at some calls."""

    def __init__(self, fails=(), dies=()):
        self.calls, self.fails, self.dies, self.got = 0, fails, dies, []

    def send(self, texts):
        self.calls += 1
        if self.calls in self.fails:
            raise ConnectionError(f"call {self.calls}")
        self.got += [(r.alert_id, r.part, r.message) for r in texts.collect()]
        if self.calls in self.dies:
            raise Died()

    def delivered(self, spark):
        return spark.createDataFrame([(a,) for a, _, _ in self.got], "alert_id string")


class Died(BaseException):
    """The process ends; nothing after it runs."""


def states(pipeline):
    return {(r.channel, r.state): r["count"] for r in pipeline.outbox.read().groupBy("channel", "state").count().collect()}


@pytest.fixture
def source(tmp_path, spark):
    stateful.use_rocksdb(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + at,) * 2)

    return folder, add


def test_alerts_of_several_batches_with_failures_and_a_restart(spark, source, tmp_path):
    folder, add = source
    good, flaky, broken = Sink(), Sink(fails=(1, 2, 3)), Sink(fails=range(99))
    at_hand = lambda: live.LiveAlerts(
        spark, str(tmp_path / "live"), {"good": live.Channel(good.send), "flaky": live.Channel(flaky.send, style="chat"),
                                        "broken": live.Channel(broken.send)}, tries=12, every=3)

    def run():
        pipeline = at_hand()
        pipeline.start(files.stream_lines(spark, str(folder), {".log": "web"}), once=True).awaitTermination()
        return pipeline

    add("a.log", tries(1, 1, 5) + tries(2, 1, 3), 0)
    pipeline = run()
    assert states(pipeline).items() >= {("good", "sent"): 1, ("broken", "pending"): 1}.items() and flaky.calls
    # three tries of the second address before the restart and two after it make one alert
    add("b.log", tries(2, 2, 2) + tries(1, 2, 4), 1)
    pipeline = run()
    assert states(pipeline).items() >= {("good", "sent"): 2, ("broken", "pending"): 2}.items()
    add("c.log", LINE % (3, 3, 1, "GET", "/x?id=1%27", 200) + "\n", 2)
    pipeline = run()
    pipeline.drain()
    assert states(pipeline) == {("good", "sent"): 3, ("flaky", "sent"): 3, ("broken", "dead"): 3}
    for sink in (good, flaky):
        assert len({a for a, _, _ in sink.got}) == 3 == len(sink.got)
    alerts = {(r.rule, r.actor, r.n) for r in pipeline.alerts().collect()}
    assert alerts == {("bruteforce", "10.0.0.1", 5), ("bruteforce", "10.0.0.2", 5), ("sqli", None, 1)}
    texts = "\n".join(m for _, _, m in good.got)
    assert "THREAT DETECTED" in texts and "deny 10.0.0.2;" in texts and "PENDING" in texts
    assert {r.error for r in pipeline.outbox.read().where("channel = 'broken'").collect()} <= {
        f"call {k}" for k in range(99)}


def changed_counts(spark, *texts):
    lines = spark.createDataFrame([("site", t) for text in texts for t in text.splitlines()], "source_label string, raw_line string")
    return detect.path_counts(detect.signal_rows(lines))


def test_crash_between_sending_and_noting_it(spark, tmp_path):
    """The batch is replayed by a new process: the channel that can tell gets nothing twice."""
    asked, blind = Sink(dies=(1,)), Sink()
    at_hand = lambda: live.LiveAlerts(spark, str(tmp_path / "live"), {
        "asked": live.Channel(asked.send, asked.delivered), "blind": live.Channel(blind.send)})
    batch = changed_counts(spark, tries(1, 1, 6))
    with pytest.raises(Died):
        at_hand().put(batch, 0)
    assert states(at_hand()) == {("asked", "sending"): 1, ("blind", "sending"): 1}
    at_hand().put(batch, 0)
    assert states(at_hand()) == {("asked", "sent"): 1, ("blind", "sent"): 1}
    assert len(asked.got) == 1 == len(blind.got)
    # without an answer the message is sent again, under the same id
    blind.dies = (2,)
    with pytest.raises(Died):
        at_hand().put(changed_counts(spark, tries(2, 2, 6)), 1)
    at_hand().put(changed_counts(spark, tries(2, 2, 6)), 1)
    assert len(asked.got) == 2 and len(blind.got) == 3 and len(set(blind.got)) == 2


def test_old_windows_leave_the_tables(spark, tmp_path):
    sink = Sink()
    pipeline = live.LiveAlerts(spark, str(tmp_path / "live"), {"c": live.Channel(sink.send)}, horizon="30 minutes", every=2)
    for number, minute in enumerate((1, 2, 50, 51)):
        pipeline.put(changed_counts(spark, tries(number + 1, minute, 5)), number)
    kept = pipeline._paths.read()
    assert kept.agg(F.min("window.end")).first()[0] >= datetime.datetime(2024, 1, 15, 10, 50)
    pipeline.outbox.compact()
    assert states(pipeline) == {("c", "sent"): 2} and len(sink.got) == 4
    assert pipeline.alerts().count() == 4


def test_nothing_to_tell(spark, source, tmp_path):
    folder, add = source
    sink = Sink()
    pipeline = live.LiveAlerts(spark, str(tmp_path / "live"), {"c": live.Channel(sink.send)})
    lines = files.stream_lines(spark, str(folder), {".log": "web"})
    assert detect.run_once(spark, detect.path_counts(detect.signal_rows(lines)), detect.PATH_KEYS).count() == 0
    add("a.log", LINE % (1, 1, 1, "GET", "/", 200) + "\n", 0)
    pipeline.start(lines, once=True).awaitTermination()
    pipeline.drain()
    assert pipeline.alerts().count() == 0 and states(pipeline) == {} and sink.calls == 0
