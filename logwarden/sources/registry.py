"""The configured log sources as a small table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import SOURCES

# the registry is broadcast in joins, so its size is checked where it is built
MAX_SOURCES = 10_000


def load_sources(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """``sources`` of the config, else ``pipeline.log_sources``; neither gives no rows."""
    listed = config.get("sources") or config.get("pipeline", {}).get("log_sources") or []
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"{len(listed)} sources; at most {MAX_SOURCES} can be registered")
    names = [s["name"] for s in listed]
    if len(set(names)) < len(names):
        raise ValueError(f"sources named twice: {sorted({n for n in names if names.count(n) > 1})}")
    rows = [
        (s["name"], str(s["path"]), s["format"], bool(s.get("enabled", True)),
         [str(t) for t in s.get("tags", [])])
        for s in listed
    ]
    return spark.createDataFrame(rows, SOURCES)


def check_sources(sources: DataFrame) -> None:
    """Raise if a registry is too large for a broadcast or names a source twice."""
    rows, names = sources.agg(F.count("name"), F.countDistinct("name")).first()
    if rows > MAX_SOURCES:
        raise ValueError(f"{rows} sources; at most {MAX_SOURCES} can be registered")
    if names < rows:
        raise ValueError(f"{rows - names} sources share a name with another")


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def lines_per_source(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled sources with the number of lines they delivered, silent ones with 0."""
    counted = lines.groupBy(F.col("source_label").alias("name")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )
    return enabled(sources).join(counted, "name", "left").select(
        "name", "format", F.array_join("tags", ",").alias("tags"),
        F.coalesce("n_lines", F.lit(0).cast("bigint")).alias("n_lines"),
    )
