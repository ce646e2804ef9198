"""Operators that keep their own state: token epochs, rolling counts, approvals, consumed context.

They need the RocksDB state store (``use_rocksdb``). State per key is small and
bounded: one anchor, the seconds of one trailing window, one alert, or one context of a few dozen rows. Of a key's rows in one
micro-batch, only what the operator needs in order is gathered (distinct seconds, an alert's
decisions, a shard's rows), so the source's admission limit bounds the memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- token epochs ---------------------------------------------------------------


class _EpochState(StatefulProcessor):
    def __init__(self, ttl: int) -> None:
        self._ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._epoch = handle.getValueState("epoch", "anchor bigint, number bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        anchor, number = self._epoch.get() if self._epoch.exists() else (None, 0)
        opened = []
        # sightings of one micro-batch may come in any order; only their distinct
        # seconds matter, and a batch covers a bounded stretch of time
        seen = sorted({int(t) for pdf in rows for t in pdf["epoch"].unique()})
        for t in seen:
            if anchor is None or t > anchor + self._ttl:
                anchor, number = t, number + 1
                opened.append((key[0], number, anchor))
        if opened:
            self._epoch.update((int(anchor), int(number)))
        yield pd.DataFrame(opened, columns=["value", "epoch_no", "epoch_start"])

    def close(self) -> None:
        pass


def stream_token_epochs(
    occurrences: DataFrame, ttl_seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """(value, epoch_no, epoch_start) as epochs open. Input: value, epoch, ts.

    Repeats within a second are dropped first, keyed by (value, second), so a hot
    value's rows are thinned on many tasks before they reach its state. ``delay`` is how
    late sightings may come: choose it by the source. Later ones are not used; the query's
    progress counts them (``numRowsDroppedByWatermark``).
    """
    thin = occurrences.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["value", "epoch"]
    )
    return thin.groupBy("value").transformWithStateInPandas(
        statefulProcessor=_EpochState(ttl_seconds),
        outputStructType="value string, epoch_no bigint, epoch_start bigint",
        outputMode="Append",
        timeMode="None",
    )


class _LivingEpochState(StatefulProcessor):
    """The anchor of a value's epoch, for as long as the epoch lasts."""

    def __init__(self, ttl: int) -> None:
        self._ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._anchor = handle.getValueState("anchor", "anchor bigint")

    def _end(self, anchor: int) -> int:
        return (anchor + self._ttl) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        anchor = self._anchor.get()[0] if self._anchor.exists() else None
        before, opened = anchor, []
        for t in sorted({int(t) for pdf in rows for t in pdf["epoch"].unique()}):
            if anchor is None or t > anchor + self._ttl:
                anchor = t
                opened.append((key[0], anchor, "opened"))
        if anchor != before:
            if before is not None:
                self._handle.deleteTimer(self._end(before))
            self._anchor.update((int(anchor),))
            self._handle.registerTimer(self._end(anchor))
        yield pd.DataFrame(opened, columns=["value", "epoch_start", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = []
        if self._anchor.exists():
            gone.append((key[0], int(self._anchor.get()[0]), "purged"))
            self._anchor.clear()
        yield pd.DataFrame(gone, columns=["value", "epoch_start", "event"]).astype({"epoch_start": "int64"})

    def close(self) -> None:
        pass


def stream_living_epochs(
    occurrences: DataFrame, ttl_seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """(value, epoch_start, event): epochs as they open, and as their state is dropped.

    The state of a value is dropped by an event-time timer once the watermark has passed the end of its epoch:
    whatever comes later opens a new epoch anyway, so nothing changes but the size of the state, which is
    the values seen within the time to live. ``occurrences``: value, epoch, ts.
    """
    thin = occurrences.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["value", "epoch"])
    return thin.groupBy("value").transformWithStateInPandas(
        statefulProcessor=_LivingEpochState(ttl_seconds),
        outputStructType="value string, epoch_start bigint, event string",
        outputMode="Append",
        timeMode="EventTime",
    )


# --- rolling counts ---------------------------------------------------------------


class _RollingState(StatefulProcessor):
    """The seconds of the trailing window and their counts, for all keys of a bucket as one Arrow table; a timer
    drops them when all are too old."""

    def __init__(self, keys: list[str], seconds: int) -> None:
        self._keys, self._seconds = keys, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rings = handle.getValueState("rings", "last bigint, rings binary")

    def _end(self, epoch: int) -> int:
        return (epoch + self._seconds) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pa.Table.from_pandas(
            pd.concat([pdf[[*self._keys, "epoch", "n"]] for pdf in rows]), self._schema(), preserve_index=False)
        n_old, together = 0, fresh
        if self._rings.exists():
            last, kept = self._rings.get()
            self._handle.deleteTimer(self._end(last))
            old = pa.ipc.open_stream(bytes(kept)).read_all()
            n_old, together = old.num_rows, pa.concat_tables([old, fresh])
        who = pd.MultiIndex.from_arrays([pd.factorize(together[k].to_pandas(), use_na_sentinel=False)[0] for k in self._keys])
        owner = pd.factorize(who)[0].astype("int64")
        epoch, n = together["epoch"].to_numpy(), together["n"].to_numpy()
        # owners lie further apart than the window is long, so that one search finds every window's start
        low = epoch.min()
        place = owner * (epoch.max() - low + self._seconds + 1) + (epoch - low)
        order = np.argsort(place, kind="stable")
        place, before = place[order], np.concatenate([[0], np.cumsum(n[order])])
        rolling = np.empty(len(order), dtype="int64")
        rolling[order] = before[1:] - before[np.searchsorted(place, place - self._seconds, side="right")]
        # seconds to come are not before the watermark
        clock = timerValues.getCurrentWatermarkInMs() // 1000
        left = together.filter(pa.array(epoch > clock - 1 - self._seconds))
        last = int(epoch.max())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, left.schema) as stream:
            stream.write_table(left)
        self._rings.update((last, sink.getvalue().to_pybytes()))
        self._handle.registerTimer(self._end(last))
        yield fresh.append_column("rolling", pa.array(rolling[n_old:])).to_pandas()

    def _schema(self) -> pa.Schema:
        return pa.schema([*((k, pa.string()) for k in self._keys), ("epoch", pa.int64()), ("n", pa.int64())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._rings.clear()
        yield pd.DataFrame([], columns=[*self._keys, "epoch", "n", "rolling"]).astype(
            {"epoch": "int64", "n": "int64", "rolling": "int64"})

    def close(self) -> None:
        pass


def stream_rolling(
    rows: DataFrame, keys: Sequence[str], seconds: int = 300, delay: str = "10 minutes", buckets: int = 512
) -> DataFrame:
    """Stream twin of ``operators.activity.rolling_counts``: (keys, epoch, n, rolling), for append mode.

    Rows are first counted per (keys, second), which merges a hot actor's rows on many tasks and puts rows that
    come out of order, within ``delay``, into their place. A second is passed on once, when the watermark has left it,
    so seconds reach the state in order, and the state holds no more than those of the trailing window.
    Rows later than ``delay`` are counted by Spark (``numRowsDroppedByWatermark``) and not used.

    A call of the state store costs milliseconds, so actors share it: they are dealt to ``buckets`` by a hash, and a
    bucket's seconds are one value that is worked on as columns. A checkpoint goes with its number of buckets.
    ``keys`` are of plain types (what a cast to text and back keeps).
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in rows.schema}
    counted = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 second"), *keys).agg(
        F.count(F.lit(1)).alias("n"))
    timed = counted.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *[F.col(k).cast("string").alias(k) for k in keys],
        F.unix_seconds("window.start").alias("epoch"), "n", F.window_time("window").alias("at"))
    rolled = timed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_RollingState(keys, seconds),
        outputStructType=", ".join([*(f"`{k}` string" for k in keys), "epoch bigint, n bigint, rolling bigint"]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return rolled.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], "epoch", "n", "rolling")


# --- approvals --------------------------------------------------------------------


class _ApprovalState(StatefulProcessor):
    def __init__(self, timeout_seconds: int) -> None:
        self._timeout_ms = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getValueState("pending", "created_ms bigint")

    def _row(self, alert_id: str, status: str, at_ms: int) -> pd.DataFrame:
        return pd.DataFrame([(alert_id, status, at_ms)],
                            columns=["alert_id", "status", "at_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [r for pdf in rows for r in pdf[["at_ms", "kind"]].itertuples(index=False)]
        # the alert comes before the decisions of its own millisecond
        for at_ms, kind in sorted(events, key=lambda e: (e.at_ms, e.kind != "alert")):
            if kind == "alert":
                if not self._pending.exists():
                    self._pending.update((int(at_ms),))
                    self._handle.registerTimer(int(at_ms) + self._timeout_ms)
                    yield self._row(key[0], "pending", at_ms)
                continue
            if not self._pending.exists():
                continue  # unknown or already settled
            created = self._pending.get()[0]
            if at_ms - created > self._timeout_ms:
                continue  # the timer settles it
            self._handle.deleteTimer(created + self._timeout_ms)
            self._pending.clear()
            yield self._row(key[0], "approved" if kind == "approve" else "rejected", at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._pending.exists():
            self._pending.clear()
            yield self._row(key[0], "expired", expiredTimerInfo.getExpiryTimeInMs())
        else:
            yield pd.DataFrame({"alert_id": [], "status": [], "at_ms": []}).astype(
                {"alert_id": "object", "status": "object", "at_ms": "int64"})

    def close(self) -> None:
        pass


def stream_approvals(events: DataFrame, timeout_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Status changes of alerts: (alert_id, status, at_ms).

    ``events``: alert_id, kind (alert, approve, reject), at TIMESTAMP. An alert that
    no one settles expires by an event-time timer.
    """
    keyed = events.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return keyed.groupBy("alert_id").transformWithStateInPandas(
        statefulProcessor=_ApprovalState(timeout_seconds),
        outputStructType="alert_id string, status string, at_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


# --- rolling context with consumption ----------------------------------------------


class _ContextState(StatefulProcessor):
    """Last ``rows`` unconsumed rows; reaching a threshold consumes an actor's rows."""

    def __init__(self, rows: int, threshold: int) -> None:
        self._rows, self._threshold = rows, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._recent = handle.getListState("recent", "seq bigint, actor string, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(self._recent.get(), maxlen=self._rows)
        found = []
        # the operator's input is shuffled by key and a micro-batch is bounded by the
        # source's admission limit; rows enter in arrival order
        batch = pd.concat([pdf[["seq", "actor", "failed"]] for pdf in rows]).sort_values("seq")
        for seq, actor, failed in batch.itertuples(index=False):
            recent.append((int(seq), actor, bool(failed)))
            if not failed:
                continue
            mine = [r for r in recent if r[2] and r[1] == actor]
            if len(mine) >= self._threshold:
                found.append((key[0], int(key[1]), actor, mine[0][0], int(seq), len(mine)))
                recent = deque((r for r in recent if r not in mine), maxlen=self._rows)
        self._recent.put(list(recent))
        yield pd.DataFrame(
            found, columns=["source_label", "shard", "actor", "first_seq", "last_seq", "n"]
        )

    def close(self) -> None:
        pass


def context_consume(
    rows: DataFrame, context_rows: int = 30, threshold: int = 5, shards: int = 16
) -> DataFrame:
    """Brute force over the last unconsumed rows of a source, consuming what it reports.

    Consumption makes each step depend on the one before, so it is keyed state.
    ``shards`` splits a source by actor, so that one hot source is not one task; a
    context then holds the last rows of the shard. ``shards=1`` is one context per
    source. ``rows``: seq, source_label, actor, failed BOOLEAN.
    """
    digits = F.substring(F.md5(F.coalesce("actor", F.lit("")).cast("binary")), 1, 8)
    shard = (F.conv(digits, 16, 10).cast("bigint") % shards).cast("int")
    return rows.withColumn("shard", shard).groupBy(
        "source_label", "shard"
    ).transformWithStateInPandas(
        statefulProcessor=_ContextState(context_rows, threshold),
        outputStructType=(
            "source_label string, shard int, actor string, first_seq bigint, "
            "last_seq bigint, n int"
        ),
        outputMode="Append",
        timeMode="None",
    )
