"""Lines to delivered alerts, live: every micro-batch raises what is new and hands it to the channels.

A stream of lines keeps counts per (window, source, actor, path). Each micro-batch brings the counts that
changed. They go to a keyed table; the findings of the windows and sources they touch are worked out
anew, and those that have no alert yet become alerts with rules, a status and messages.

Between the detection and the channels stands an outbox: a keyed table with one row per (alert, channel)
and its state. A batch commits its alerts there before anything is sent, marks what it is about to hand
to a channel as ``sending``, and what the channel took as ``sent``. A channel that fails leaves its
messages ``pending`` for the next batch and does not hold up the others; after ``tries`` failures they are
``dead``. A batch that is replayed after a crash finds its alerts committed and goes on with the
delivery. What was ``sending`` when the process died may or may not have arrived: a channel with
``delivered`` is asked, and one without gets it again under the same (alert_id, channel), which it can use to tell
repeats. An alert is raised when its threshold is first reached, and stays even if later rows give its
rows to an earlier rule.

State and files are bounded by the windows that are open: counts of windows that ended ``horizon``
before the newest one are dropped when the table is compacted, so is what was settled for that long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import respond
from ..options import Options
from ..plans.detection import respond_from
from ..sources.landing import exists, land
from . import detect
from .keyed import KeyedTable

PENDING, SENDING, SENT, DEAD = "pending", "sending", "sent", "dead"
OUTBOX = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("raised_in", T.LongType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("failures", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
KEYS = ("alert_id", "channel")


@dataclass(frozen=True)
class Channel:
    """``send`` takes a DataFrame of messages (alert_id, channel, part, message) and raises if it fails.

    ``delivered``, if the receiver can tell, gives the alert_ids it already has. ``style`` is that of the
    texts: chat or plain.
    """

    send: Callable[[DataFrame], None]
    delivered: Callable[[SparkSession], DataFrame] | None = None
    style: str = "plain"


@dataclass
class LiveAlerts:
    """One live pipeline. All it knows is in ``folder``: a new object over the same folder goes on."""

    spark: SparkSession
    folder: str
    channels: dict[str, Channel]
    options: Options = field(default_factory=Options)
    created_at: Callable[[], Column] = F.current_timestamp
    tries: int = 3
    horizon: str = "7 days"
    every: int = 8
    max_lines: int = 100

    def __post_init__(self) -> None:
        self._paths: KeyedTable | None = None
        self.outbox = KeyedTable(
            self.spark, f"{self.folder}/outbox", KEYS, OUTBOX, every=self.every, fold=self._unsettled)

    # --- what is kept --------------------------------------------------------------

    def _recent(self, rows: DataFrame, end: Column) -> Column:
        newest = rows.agg(F.max(end)).first()[0]
        if newest is None:
            return F.lit(True)
        return end >= F.lit(newest) - F.expr(f"interval {self.horizon}")

    def _unsettled(self, rows: DataFrame) -> DataFrame:
        """The outbox without what was settled before the horizon; its alerts' windows are no longer counted."""
        return rows.where(self._recent(rows, F.col("window_end")) | F.col("state").isin(PENDING, SENDING))

    def counts(self, schema: T.StructType) -> KeyedTable:
        if self._paths is None:
            self._paths = KeyedTable(
                self.spark, f"{self.folder}/counts", detect.PATH_KEYS, schema, every=self.every,
                fold=lambda rows: rows.where(self._recent(rows, F.col("window.end"))))
        return self._paths

    # --- one micro-batch -----------------------------------------------------------

    def put(self, batch: DataFrame, number: int) -> None:
        """Take in changed path counts: alerts are committed first, then delivered."""
        if not self.outbox.has(number):
            table = self.counts(batch.schema)
            table.put(batch, number)
            touched = table.changed().select(*detect.SCOPE).distinct()
            if not touched.isEmpty():
                paths = table.read().join(touched, list(detect.SCOPE), "left_semi")
                self._raise(land(detect.window_counts(paths, self.options), "actors"), number)
        self.deliver()

    def _raise(self, actors: DataFrame, number: int) -> None:
        response = respond_from(
            actors, self.created_at(), self.options, scope=detect.SCOPE, raised=self.outbox.read())
        alerts = land(response.alerts, "raised")
        if alerts.isEmpty():
            return
        alerts.write.mode("overwrite").parquet(f"{self.folder}/alerts/raised_in={number}")
        response.rules.write.mode("overwrite").parquet(f"{self.folder}/rules/raised_in={number}")
        lines = None
        for name, channel in self.channels.items():
            mine = respond.message_lines(alerts, response.rules, channel.style).withColumn("channel", F.lit(name))
            lines = mine if lines is None else lines.unionByName(mine)
        respond.messages(lines, self.max_lines).write.mode("overwrite").parquet(
            f"{self.folder}/messages/raised_in={number}")
        self.outbox.put(alerts.select(
            "alert_id", F.explode(F.array(*[F.lit(n) for n in self.channels])).alias("channel"),
            F.lit(number).alias("raised_in"), F.col("window.end").alias("window_end"),
            F.lit(PENDING).alias("state"), F.lit(0).alias("failures"), F.lit(None).alias("error")), number)

    def deliver(self) -> dict[str, str]:
        """Send what waits, channel by channel. Gives the errors of the channels that failed."""
        # messages of a channel that is no longer configured keep waiting
        waiting = self.outbox.read().where(
            F.col("state").isin(PENDING, SENDING) & F.col("channel").isin(*self.channels))
        if waiting.isEmpty():
            return {}
        asked = land(self._asked(waiting), "due")
        due, arrived = asked.where(F.col("state") != SENT), asked.where(F.col("state") == SENT)
        names = sorted(r["channel"] for r in due.select("channel").distinct().collect())
        if names:
            self.outbox.put(due.withColumn("state", F.lit(SENDING)))
        failed: dict[str, str] = {}
        for name in names:
            failed |= respond.dispatch(self._texts(due.where(F.col("channel") == name)), {name: self.channels[name].send})
        if names or not arrived.isEmpty():
            self.outbox.put(self._settled(due, failed).unionByName(arrived))
        return failed

    def _asked(self, waiting: DataFrame) -> DataFrame:
        """What was being sent when a process died is ``sent`` where its channel says that it arrived."""
        for name, channel in self.channels.items():
            if channel.delivered is None:
                continue
            there = channel.delivered(self.spark).select(
                "alert_id", F.lit(name).alias("channel"), F.lit(True).alias("_there")).distinct()
            waiting = waiting.join(there, list(KEYS), "left").withColumn(
                "state", F.when(F.col("_there") & (F.col("state") == SENDING), SENT).otherwise(F.col("state"))
            ).drop("_there")
        return waiting

    def _texts(self, due: DataFrame) -> DataFrame:
        texts = self.spark.read.parquet(f"{self.folder}/messages")
        return texts.join(due.select(*KEYS, "raised_in"), [*KEYS, "raised_in"]).drop("raised_in")

    def _settled(self, due: DataFrame, failed: dict[str, str]) -> DataFrame:
        error = F.lit(None).cast("string")
        for name, text in failed.items():
            error = F.when(F.col("channel") == name, F.lit(text)).otherwise(error)
        failures = F.col("failures") + F.when(error.isNotNull(), 1).otherwise(0)
        return due.withColumns({
            "state": F.when(error.isNull(), SENT).when(failures >= self.tries, DEAD).otherwise(PENDING),
            "failures": failures, "error": error})

    def drain(self) -> None:
        """Try what waits again until it is delivered or dead, without new lines."""
        for _ in range(self.tries):
            if not self.deliver():
                return

    # --- the stream ------------------------------------------------------------------

    def start(self, lines: DataFrame, window: str = "5 minutes", delay: str = "10 minutes",
              once: bool = False) -> StreamingQuery:
        """Run over a stream of lines; a second start from the same folder goes on where the first one ended."""
        changed = detect.path_counts(detect.signal_rows(lines, self.options), self.options, window, delay=delay)
        writer = changed.writeStream.outputMode("update").option(
            "checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self.put)
        return writer.trigger(availableNow=True).start() if once else writer.trigger(
            processingTime=detect.INTERVAL).start()

    def alerts(self) -> DataFrame:
        """All alerts raised so far; before the first one, no rows and no other columns than the id."""
        if not exists(self.spark, f"{self.folder}/alerts"):
            return self.spark.createDataFrame([], "alert_id string")
        return self.spark.read.parquet(f"{self.folder}/alerts")
