"""Event-time activity of actors: fixed, sliding and session windows, rolling counts.

Each function first merges rows to one per (actor, second) or (actor, pane), so a
hot actor costs as much as the seconds it was active, and then works in slices of
time, so that no task holds an actor's whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import slice_of, with_halo

DAY = 86_400


def per_second(rows: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return rows.groupBy(*keys, F.unix_seconds(ts).alias("epoch")).agg(
        F.count(F.lit(1)).alias("n")
    )


def tumbling(rows: DataFrame, keys: Sequence[str], seconds: int, least: int = 1) -> DataFrame:
    """(keys, window_start, n) with at least ``least`` rows."""
    at = F.unix_seconds("ts")
    return (
        rows.groupBy(*keys, (at - F.pmod(at, F.lit(seconds))).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def sliding(
    rows: DataFrame, keys: Sequence[str], seconds: int, slide: int, least: int = 1
) -> DataFrame:
    """Windows of ``seconds`` every ``slide``: panes are counted once, then spread."""
    if seconds % slide:
        raise ValueError("the window must be a multiple of the slide")
    panes = tumbling(rows, keys, slide).withColumnRenamed("window_start", "pane")
    starts = F.sequence(F.col("pane") - (seconds - slide), F.col("pane"), F.lit(slide))
    return (
        panes.withColumn("window_start", F.explode(starts))
        .groupBy(*keys, "window_start")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
    )


def sessions(
    rows: DataFrame, keys: Sequence[str], gap: int, least: int = 1, chunk: int = DAY
) -> DataFrame:
    """Runs of activity with pauses shorter than ``gap``: (keys, start, last, n).

    Sessions are built per chunk of time, and then sessions that touch over a
    chunk border are merged; the second step sees sessions, not rows.
    """
    keys = list(keys)
    seconds = per_second(rows, keys).withColumn("_chunk", slice_of(F.col("epoch"), chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("epoch")
    pieces = _merge(
        seconds.select(*keys, "_chunk", F.col("epoch").alias("start"),
                       F.col("epoch").alias("last"), "n"),
        [*keys, "_chunk"], inside.orderBy("start"), gap,
    )
    whole = _merge(pieces, keys, Window.partitionBy(*keys).orderBy("start"), gap)
    return whole.where(F.col("n") >= least)


def _merge(pieces: DataFrame, keys: list[str], order: Window, gap: int) -> DataFrame:
    """Merge pieces (start, last, n) whose pause to the one before is under ``gap``."""
    pause = F.col("start") - F.lag("last").over(order)
    run = F.sum(F.when(pause < gap, 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        pieces.withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .drop("_run")
    )


def rolling_counts(
    rows: DataFrame, keys: Sequence[str], seconds: int = 300, chunk: int = DAY
) -> DataFrame:
    """(keys, epoch, n, rolling): rows in the trailing ``seconds`` at each active second."""
    active = per_second(rows, keys)
    spread = with_halo(active, "epoch", seconds - 1, chunk)
    frame = (
        Window.partitionBy(*keys, "_slice").orderBy("epoch").rangeBetween(-(seconds - 1), 0)
    )
    return (
        spread.withColumn("rolling", F.sum("n").over(frame))
        .where("_home")
        .drop("_slice", "_home")
    )


def rolling_peaks(
    rows: DataFrame, keys: Sequence[str], threshold: int, seconds: int = 300, chunk: int = DAY
) -> DataFrame:
    """Actors whose rolling count reached the threshold: when first, and the peak."""
    return (
        rolling_counts(rows, keys, seconds, chunk)
        .where(F.col("rolling") >= threshold)
        .groupBy(*keys)
        .agg(F.min("epoch").alias("reached_at"), F.max("rolling").alias("peak"))
    )


# --- across sources and over time ----------------------------------------------


def source_correlation(rows: DataFrame, seconds: int, web_least: int = 1,
                       auth_least: int = 1) -> DataFrame:
    """Actors seen on several sources in one window, with the coordinated patterns.

    ``rows``: ts, actor, source_label, format, status, method.
    """
    at = F.unix_seconds("ts")
    fine = rows.groupBy(
        (at - F.pmod(at, F.lit(seconds))).alias("window_start"), "actor", "source_label"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("format") != "syslog") & (F.col("status") == 404)).alias("web_404"),
        F.count_if((F.col("format") == "syslog")
                   & F.col("method").isin("FAILED", "AUTH_FAILED")).alias("auth_failed"),
        F.count_if((F.col("format") == "apache") & (F.col("status") == 500)).alias("apache_500"),
        F.count_if((F.col("format") == "nginx") & (F.col("status") == 200)).alias("nginx_200"),
    )
    merged = fine.groupBy("window_start", "actor").agg(
        F.count(F.lit(1)).alias("n_sources"),
        *[F.sum(c).alias(c) for c in ("n", "web_404", "auth_failed", "apache_500", "nginx_200")],
    )
    return merged.where(F.col("n_sources") >= 2).withColumns({
        "coordinated": (F.col("web_404") >= web_least) & (F.col("auth_failed") >= auth_least),
        "app_layer": (F.col("apache_500") > 0) & (F.col("nginx_200") > 0),
    })


def feedback_metrics(alerts: DataFrame) -> DataFrame:
    """Human verdicts by category over settled alerts (approved, executed or rejected)."""
    settled = alerts.where(F.col("status").isin("approved", "executed", "rejected"))
    rejected = (F.col("status") == "rejected").cast("int")
    return settled.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_settled"),
        F.sum(rejected).alias("n_rejected"),
        F.avg(rejected).alias("false_positive_rate"),
        F.avg(1 - rejected).alias("accuracy"),
    )


def autonomy_gate(rules: DataFrame, policy: DataFrame, level: Column) -> DataFrame:
    """What may happen to each proposed rule under a policy table.

    ``policy`` (a few rows: name, mode) names actions or rule types with mode
    auto, approval or never; a rule type's entry goes before its action's.
    ``level`` is observe_only, suggest, auto_mitigate_low or
    full_auto_with_hitl_critical and decides where the policy says nothing.
    """
    by_type = policy.select(F.col("name").alias("rule_type"), F.col("mode").alias("_type_mode"))
    by_action = policy.select(
        F.col("name").alias("effective_action"), F.col("mode").alias("_action_mode")
    )
    joined = rules.join(by_type, "rule_type", "left").join(by_action, "effective_action", "left")
    minor = F.col("severity").isin("low", "medium")
    default = (
        F.when(level == "observe_only", "never")
        .when((level == "auto_mitigate_low") & minor, "auto")
        .when((level == "full_auto_with_hitl_critical") & ~F.col("critical"), "auto")
        .otherwise("approval")
    )
    return joined.withColumn("mode", F.coalesce("_type_mode", "_action_mode", default)).drop(
        "_type_mode", "_action_mode"
    )


def mitigation_verdict(
    rows: DataFrame, actions: DataFrame, seconds: int, chunk: int | None = None
) -> DataFrame:
    """Did an action help? Rows of the actor before and after it.

    ``actions``: alert_id, actor, executed_at. Rows are merged to one per (actor,
    second); an action asks only the time slices its two spans touch, so the range
    join is an equi-join on (actor, slice).
    """
    width = chunk or seconds
    active = per_second(rows, ["actor"]).withColumn("_slice", slice_of(F.col("epoch"), width))
    asked = actions.select(
        "alert_id", "actor", F.unix_seconds("executed_at").alias("at")
    ).withColumn(
        "_slice",
        F.explode(F.sequence(slice_of(F.col("at") - seconds, width),
                             slice_of(F.col("at") + seconds, width))),
    )
    near = asked.join(active, ["actor", "_slice"], "left")
    past = (F.col("epoch") >= F.col("at") - seconds) & (F.col("epoch") < F.col("at"))
    next_ = (F.col("epoch") >= F.col("at")) & (F.col("epoch") < F.col("at") + seconds)
    zero = F.lit(0).cast("bigint")
    counted = near.groupBy("alert_id", "actor").agg(
        F.coalesce(F.sum(F.when(past, F.col("n"))), zero).alias("n_before"),
        F.coalesce(F.sum(F.when(next_, F.col("n"))), zero).alias("n_after"),
    )
    verdict = (
        F.when(F.col("n_after") == 0, "resolved")
        .when(F.col("n_after") > F.col("n_before"), "escalated")
        .otherwise("ongoing")
    )
    return counted.withColumn("verdict", verdict)
