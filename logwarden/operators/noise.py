"""Noise flags. Rows are flagged, never dropped; consumers filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..options import NoiseOptions


def any_of(words: tuple[str, ...]) -> str:
    """Regex that finds any of the literal words."""
    return "|".join(re.escape(w) for w in words)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "?", 1), fixed.EXTENSION, 1))


def is_suspicious(path: Column, status: Column) -> Column:
    return status.isin(*fixed.SUSPICIOUS_STATUSES) & F.lower(path).rlike(
        any_of(fixed.SUSPICIOUS_PATH_PARTS)
    )


def noise_reason(options: NoiseOptions = NoiseOptions()) -> Column:
    if not options.enabled:
        return F.lit(None).cast("string")
    path, status, agent = F.col("path"), F.col("status"), F.col("user_agent")
    chain = F.when(is_suspicious(path, status), F.lit(None).cast("string"))
    if options.static_extensions:
        known = [e.lower() for e in options.static_extensions]
        chain = chain.when(file_extension(path).isin(*known), "static_asset")
    if options.health_paths:
        chain = chain.when(path.isin(*options.health_paths), "health_check")
    if options.known_bots:
        chain = chain.when(agent.rlike(any_of(options.known_bots)), "known_bot")
    if options.ignore_status_codes:
        chain = chain.when(status.isin(*options.ignore_status_codes), "ignored_status")
    if options.small_get_below is not None:
        small = (
            (F.col("method") == "GET")
            & (status == 200)
            & (F.col("response_size") < options.small_get_below)
        )
        chain = chain.when(small, "small_get")
    return chain.otherwise(F.lit(None).cast("string"))


def with_noise(entries: DataFrame, options: NoiseOptions = NoiseOptions()) -> DataFrame:
    return entries.withColumn("noise_reason", noise_reason(options)).withColumn(
        "is_noise", F.col("noise_reason").isNotNull()
    )


def noise_summary(flagged: DataFrame) -> DataFrame:
    """Noise rate by source, plus one total per source and reason."""
    return flagged.groupBy("source_label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_noise").alias("n_noise"),
        F.count_if(F.col("noise_reason") == "static_asset").alias("n_static_asset"),
        F.count_if(F.col("noise_reason") == "health_check").alias("n_health_check"),
        F.count_if(F.col("noise_reason") == "known_bot").alias("n_known_bot"),
        F.avg(F.col("is_noise").cast("int")).alias("noise_rate"),
    )


def noise_reasons(flagged: DataFrame) -> DataFrame:
    """Rows per source and reason, whatever reasons the options switch on; kept rows have none."""
    return flagged.groupBy("source_label", "noise_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def health_rows(entries: DataFrame, health_paths: DataFrame) -> DataFrame:
    """Rows whose full path is in a table of health paths (column ``path``)."""
    return entries.join(health_paths.select("path").distinct(), "path", "left_semi")
