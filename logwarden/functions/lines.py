"""Expressions that turn one log line into a typed struct.

Each line runs through one regex only: the wanted groups are rewritten into a
newline-separated record (a log line holds no newline) and split.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

FIELDS = (
    "ts", "source_ip", "method", "path", "status", "response_size", "user_agent", "referer",
)


def _groups(line: Column, pattern: str, numbers: list[int]) -> Column:
    record = F.regexp_replace(line, pattern, "\n".join(f"${n}" for n in numbers))
    return F.split(record, "\n", -1)


def _entry(matched: Column, **values: Column) -> Column:
    ordered = [values[name].alias(name) for name in FIELDS]
    return F.struct(matched.alias("matched"), *ordered)


def access_groups(line: Column) -> Column:
    return _groups(line, fixed.ACCESS_LINE, [1, 3, 4, 5, 7, 8, 9, 10])


def access_entry(parts: Column) -> Column:
    when = F.get(parts, F.lit(1))
    ts = F.coalesce(
        F.try_to_timestamp(when, F.lit("d/MMM/yyyy:H:m:s Z")),
        F.try_to_timestamp(when, F.lit("d/MMM/yyyy:H:m:s XXX")),
    )
    return _entry(
        F.size(parts) == 8,
        ts=ts,
        source_ip=F.get(parts, F.lit(0)),
        method=F.get(parts, F.lit(2)),
        path=F.get(parts, F.lit(3)),
        status=F.get(parts, F.lit(4)).try_cast("int"),
        response_size=F.get(parts, F.lit(5)).try_cast("bigint"),
        referer=F.get(parts, F.lit(6)),
        user_agent=F.get(parts, F.lit(7)),
    )


def syslog_groups(line: Column) -> Column:
    return _groups(line, fixed.SYSLOG_LINE, [1, 3, 5])


def syslog_action(message: Column) -> Column:
    low = F.lower(message)
    chain = None
    for phrase, action in fixed.SYSLOG_ACTIONS:
        hit = low.contains(phrase)
        chain = F.when(hit, action) if chain is None else chain.when(hit, action)
    first_word = F.upper(F.regexp_extract(message, r"^\s*(\S+)", 1))
    return chain.when(message == "", "UNKNOWN").otherwise(first_word)


def _syslog_struct(matched: Column, ts: Column, app: Column, message: Column) -> Column:
    return _entry(
        matched,
        ts=ts,
        source_ip=F.regexp_extract(message, fixed.IPV4_IN_TEXT, 0),
        method=syslog_action(message),
        path=app,
        status=F.lit(0),
        response_size=F.lit(0).cast("bigint"),
        user_agent=F.lit(""),
        referer=F.lit(""),
    )


def syslog_entry(parts: Column, year: int) -> Column:
    clock = F.regexp_replace(F.get(parts, F.lit(0)), r"\s+", " ")
    ts = F.try_to_timestamp(
        F.concat(F.lit(f"{year} "), clock), F.lit("yyyy MMM d HH:mm:ss")
    )
    return _syslog_struct(F.size(parts) == 3, ts, F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))


def syslog_5424_groups(line: Column) -> Column:
    return _groups(line, fixed.SYSLOG_5424_LINE, [1, 3, 5])


def syslog_5424_entry(parts: Column) -> Column:
    ts = F.try_to_timestamp(F.get(parts, F.lit(0)))
    return _syslog_struct(F.size(parts) == 3, ts, F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
