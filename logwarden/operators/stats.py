"""Per-actor and per-path statistics over flagged entries.

Every function takes entries with ``actor``, ``is_noise`` and the scope columns
named by ``by``; noise rows count only in the overview. Histograms are long
tables: the number of paths or agents of one actor is not bounded, so nothing is
collected into a map or list. Each aggregate first groups by the finest key, so
a hot actor's or path's rows are merged before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Scope = Sequence[str]


def signal(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_noise"))


def overview(entries: DataFrame, by: Scope) -> DataFrame:
    """All rows counted, first and last time over signal rows only."""
    when_signal = F.when(~F.col("is_noise"), F.col("ts"))
    clock = "HH:mm:ss"
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(~F.col("is_noise")).alias("signal_entries"),
        F.coalesce(F.date_format(F.min(when_signal), clock), F.lit("")).alias("time_start"),
        F.coalesce(F.date_format(F.max(when_signal), clock), F.lit("")).alias("time_end"),
    )


def _histogram(entries: DataFrame, by: Scope, *keys: str) -> DataFrame:
    return signal(entries).groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


def ip_status(entries: DataFrame, by: Scope) -> DataFrame:
    return _histogram(entries, by, "actor", "status")


def ip_paths(entries: DataFrame, by: Scope) -> DataFrame:
    return _histogram(entries, by, "actor", "path")


def ip_methods(entries: DataFrame, by: Scope) -> DataFrame:
    return _histogram(entries, by, "actor", "method")


def ip_agents(entries: DataFrame, by: Scope) -> DataFrame:
    return _histogram(entries.where(F.col("user_agent") != ""), by, "actor", "user_agent")


def ip_stats(entries: DataFrame, by: Scope) -> DataFrame:
    """Requests, distinct paths, methods and agents per actor, busiest first.

    All three distinct counts come from one pass over the distinct
    (actor, path, method, agent) rows.
    """
    fine = _histogram(entries, by, "actor", "path", "method", "user_agent")
    return (
        fine.groupBy(*by, "actor")
        .agg(
            F.sum("n").alias("request_count"),
            F.count_distinct("path").alias("n_paths"),
            F.count_distinct("method").alias("n_methods"),
            F.count_distinct(F.nullif("user_agent", F.lit(""))).alias("n_user_agents"),
            F.min("first_seq").alias("first_seq"),
        )
        .orderBy(*by, F.desc("request_count"), "first_seq")
    )


def _leading(df: DataFrame, group: Sequence[str], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows per group; Spark prunes to ``k`` per task before the shuffle."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def ip_top_paths(entries: DataFrame, by: Scope, k: int = 5) -> DataFrame:
    return _leading(
        ip_paths(entries, by), [*by, "actor"], k, F.desc("n"), F.asc("first_seq")
    )


def ip_top_method(entries: DataFrame, by: Scope) -> DataFrame:
    best = F.max_by("method", F.struct("n", -F.col("first_seq")))
    return ip_methods(entries, by).groupBy(*by, "actor").agg(best.alias("method"))


def ip_status_ranked(entries: DataFrame, by: Scope) -> DataFrame:
    """Status list of each actor, most frequent first (a few dozen codes at most)."""
    pair = F.struct(
        (-F.col("n")).alias("o"), F.col("first_seq").alias("s"), F.col("status").alias("c")
    )
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(pair)),
            lambda p: F.concat_ws(":", p["c"].cast("string"), (-p["o"]).cast("string")),
        ),
        ", ",
    )
    return ip_status(entries, by).groupBy(*by, "actor").agg(
        text.alias("statuses"), F.count(F.lit(1)).alias("n_statuses")
    )


def ip_sample_agents(entries: DataFrame, by: Scope, k: int = 3) -> DataFrame:
    """Number of agents per actor and the first ``k`` of them in text order."""
    agents = ip_agents(entries, by)
    totals = agents.groupBy(*by, "actor").agg(F.count(F.lit(1)).alias("n_user_agents"))
    first = _leading(agents, [*by, "actor"], k, F.asc("user_agent"))
    sample = first.groupBy(*by, "actor").agg(
        F.array_join(F.array_sort(F.collect_list("user_agent")), ", ").alias("sample")
    )
    return totals.join(sample, [*by, "actor"])


def path_stats(entries: DataFrame, by: Scope, *, approximate: bool = False) -> DataFrame:
    """Requests and distinct actors per non-empty path."""
    busy = entries.where(F.col("path") != "")
    if approximate:
        return signal(busy).groupBy(*by, "path").agg(
            F.count(F.lit(1)).alias("request_count"),
            F.approx_count_distinct("actor").alias("n_ips"),
            F.min("seq").alias("first_seq"),
        )
    # distinct (path, actor) rows first: counting them again needs no distinct
    return _histogram(busy, by, "path", "actor").groupBy(*by, "path").agg(
        F.sum("n").alias("request_count"),
        F.count(F.lit(1)).alias("n_ips"),
        F.min("first_seq").alias("first_seq"),
    )


def path_sketches(entries: DataFrame, by: Scope, lg_k: int = 15) -> DataFrame:
    """Requests and a sketch of the actors per non-empty path: one pass, no shuffle of actors.

    Sketches are small (2^lg_k bytes at most, a few bytes for rare paths), can be stored, and merge by
    ``merged_sketches``. The relative standard error is 1.04 / sqrt(2^lg_k), 0.6 % by default.
    """
    return signal(entries.where(F.col("path") != "")).groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.hll_sketch_agg("actor", lg_k).alias("actors"),
        F.min("seq").alias("first_seq"),
    )


def merged_sketches(sketches: DataFrame, by: Scope) -> DataFrame:
    """Sketches of finer scopes merged to ``by``, as if they had been made from all rows at once."""
    return sketches.groupBy(*by, "path").agg(
        F.sum("request_count").alias("request_count"),
        F.hll_union_agg("actors").alias("actors"),
        F.min("first_seq").alias("first_seq"),
    )


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``path_stats`` with estimated numbers of actors."""
    return sketches.withColumn("n_ips", F.hll_sketch_estimate("actors")).drop("actors")


def path_status(entries: DataFrame, by: Scope) -> DataFrame:
    return _histogram(entries.where(F.col("path") != ""), by, "path", "status")


def frequent_paths(
    entries: DataFrame, by: Scope, min_requests: int = 3, min_ips: int = 2
) -> DataFrame:
    return (
        path_stats(entries, by)
        .where((F.col("request_count") >= min_requests) | (F.col("n_ips") >= min_ips))
        .orderBy(*by, F.desc("request_count"), "first_seq")
    )
