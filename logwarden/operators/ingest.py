"""Lines -> typed log entries, with everything that does not parse kept aside.

Input of every function: ``source_label STRING, raw_line STRING`` and ``seq BIGINT``,
a total order, which ``sources.files.read_lines`` gives to text files. Lines without a ``seq``
(those of a stream, or a null) are put in time order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lines as L
from ..functions.once import computed_once
from ..options import IngestOptions
from ..sources.registry import check_sources

PARSED = "_entry"


class LineFormat(NamedTuple):
    """How one source format is read: line -> groups, groups -> entry struct."""

    groups: Callable[[Column], Column]
    entry: Callable[[Column], Column]


def line_formats(options: IngestOptions = IngestOptions()) -> dict[str, LineFormat]:
    """Format name -> expressions. Callers may add their own entries."""
    access = LineFormat(L.access_groups, L.access_entry)
    syslog = LineFormat(
        L.syslog_groups, lambda parts: L.syslog_entry(parts, options.syslog_year)
    )
    if options.accept_rfc5424:
        syslog = either(syslog, LineFormat(L.syslog_5424_groups, L.syslog_5424_entry))
    return {"nginx": access, "apache": access, "syslog": syslog}


def either(first: LineFormat, second: LineFormat) -> LineFormat:
    """A format whose lines may be of two kinds: the first that matches counts."""

    def entry(parts: Column) -> Column:
        own, other = first.entry(parts["first"]), second.entry(parts["second"])
        return F.when(own["matched"] | ~other["matched"], own).otherwise(other)

    return LineFormat(
        lambda line: F.struct(
            first.groups(line).alias("first"), second.groups(line).alias("second")
        ),
        entry,
    )


def _tagged(lines: DataFrame, fmt: LineFormat) -> DataFrame:
    if "seq" not in lines.columns:
        lines = lines.withColumn("seq", F.lit(None).cast("bigint"))
    grouped = lines.withColumn("_parts", fmt.groups(F.col("raw_line")))
    return computed_once(grouped, PARSED, fmt.entry(F.col("_parts")))


def _flatten(tagged: DataFrame, *extra: str) -> DataFrame:
    return tagged.select(
        "seq",
        *[F.col(f"{PARSED}.{name}").alias(name) for name in L.FIELDS],
        "raw_line",
        "source_label",
        *extra,
    )


def _reason() -> Column:
    return F.when(~F.col(f"{PARSED}.matched"), "no_match").when(
        F.col(f"{PARSED}.ts").isNull(), "bad_time"
    )


def in_time_order(entries: DataFrame) -> DataFrame:
    """Fill a null ``seq``: time first, then a hash of the line.

    For streams, whose lines cannot be counted. Seconds take the high bits and 28 bits of
    hash the low ones, so the order is the same in every run, without a sort; it has
    gaps, and equal lines of one second share a number. Times beyond the year 2242 (or as
    far before 1970) are kept in the row and share their end's numbers.
    """
    low = F.pmod(F.xxhash64("source_label", "raw_line"), F.lit(1 << 28))
    end = F.lit(1 << 33)
    seconds = F.greatest(F.least(F.unix_seconds("ts"), end), -end)
    return entries.withColumn("seq", F.coalesce("seq", seconds * F.lit(1 << 28) + low))


def parse_access(lines: DataFrame) -> DataFrame:
    """Combined access log (nginx and apache share it)."""
    return _parsed(lines, line_formats()["nginx"])


def parse_syslog(lines: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    return _parsed(lines, line_formats(options)["syslog"])


def _parsed(lines: DataFrame, fmt: LineFormat) -> DataFrame:
    return in_time_order(_flatten(_tagged(lines, fmt).where(_reason().isNull())))


def quarantine(lines: DataFrame, fmt: str, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Lines of one format that do not become entries, with the reason."""
    return (
        _tagged(lines, line_formats(options)[fmt])
        .withColumn("reason", _reason())
        .where(F.col("reason").isNotNull())
        .select("seq", "source_label", "raw_line", "reason")
    )


def format_coverage(
    lines: DataFrame, fmt: str, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Share of lines per source that match the format, whatever their time says."""
    matched = _tagged(lines, line_formats(options)[fmt]).select(
        "source_label", F.col(f"{PARSED}.matched").cast("int").alias("m")
    )
    return matched.groupBy("source_label").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("m").alias("matched"),
        F.avg("m").alias("coverage"),
    )


def route(
    lines: DataFrame,
    sources: DataFrame,
    options: IngestOptions = IngestOptions(),
    formats: dict[str, LineFormat] | None = None,
) -> DataFrame:
    """Parse a mix of sources in one pass, each row by its source's format.

    ``sources`` is the configured registry; it is broadcast, so its size is checked, and
    a name that is there twice is an error: it would double its lines. Rows that yield no
    entry come back with ``reason`` set: no_match, bad_time, unknown_format,
    unknown_source. Disabled sources are dropped, as they would not be read at all.
    """
    check_sources(sources)
    formats = formats or line_formats(options)
    if "seq" not in lines.columns:
        lines = lines.withColumn("seq", F.lit(None).cast("bigint"))
    dims = sources.select(
        F.col("name").alias("source_label"), "format", "enabled", "tags"
    )
    joined = lines.join(F.broadcast(dims), "source_label", "left").where(
        F.coalesce("enabled", F.lit(True))
    )
    grouped, entry = joined, None
    for name, fmt in formats.items():
        mine = F.col("format") == name
        grouped = grouped.withColumn(f"_parts_{name}", F.when(mine, fmt.groups(F.col("raw_line"))))
        struct = fmt.entry(F.col(f"_parts_{name}"))
        entry = F.when(mine, struct) if entry is None else entry.when(mine, struct)
    reason = (
        F.when(F.col("format").isNull(), "unknown_source")
        .when(~F.col("format").isin(*formats), "unknown_format")
        .otherwise(_reason())
    )
    # lines without a number get one in time order, as nothing may be lost or unordered later on
    return in_time_order(_flatten(
        computed_once(grouped, PARSED, entry).withColumn("reason", reason),
        "format", "tags", "reason",
    ))
