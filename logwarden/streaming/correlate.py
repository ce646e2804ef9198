"""Actors that several sources see at once, from two streams joined by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_correlation(
    rows: DataFrame, seconds: int, delay: str = "10 minutes", web_least: int = 1, auth_least: int = 1
) -> DataFrame:
    """(window_start, actor, web_404, auth_failed) of windows that closed with enough of both: append mode.

    Stream twin of the coordinated rows of ``operators.activity.source_correlation``. ``rows``: ts, actor, format,
    status, method. Each side is counted per (window, actor) before the join, so the join's state has one row per
    actor and open window on either side, however many lines there are; the watermark drops it.
    """
    timed = rows.withWatermark("ts", delay)
    span = F.window("ts", f"{seconds} seconds")
    web = timed.where((F.col("format") != "syslog") & (F.col("status") == 404)).groupBy(span, "actor").agg(
        F.count(F.lit(1)).alias("web_404")).where(F.col("web_404") >= web_least)
    auth = timed.where(
        (F.col("format") == "syslog") & F.col("method").isin("FAILED", "AUTH_FAILED")
    ).groupBy(span, "actor").agg(F.count(F.lit(1)).alias("auth_failed")).where(F.col("auth_failed") >= auth_least)
    return web.join(auth, ["window", "actor"]).select(
        F.unix_seconds("window.start").alias("window_start"), "actor", "web_404", "auth_failed")
