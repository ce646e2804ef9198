"""Expressions that find personal data in text and swap it for tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

# 128 bits of the digest: with a billion distinct values the chance of two
# values sharing a token is still about 1e-21
TOKEN_HEX = 32

_NO_MATCH = "cast(array() as array<string>)"


def _worth_scanning(name: str, text: Column) -> Column:
    """Cheap necessary condition for a pattern to occur at all."""
    if name == "ipv6":
        colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
        return text.contains("::") | (colons >= 7)
    needle = {"ipv4": ".", "email": "@", "url_sensitive": "://", "path_ids": "/"}[name]
    return text.contains(needle)


def pii_matches(name: str, pattern: str, text: Column) -> Column:
    """Distinct matches in text order."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(_worth_scanning(name, text), found).otherwise(F.expr(_NO_MATCH))


def hash_token(prefix: str, value: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), value), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, TOKEN_HEX), F.lit("]"))


def longest_first(values: Column) -> Column:
    ordered = F.array_sort(
        values,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )
    return F.when(F.size(values) < 2, values).otherwise(ordered)


def token_entries(values: Column, prefix: str, salt: str) -> Column:
    """One pattern's part of a line's token list, in the order of replacement.

    ``pos`` is the value's place among the pattern's matches in the text.
    """
    return F.transform(
        longest_first(values),
        lambda v: F.struct(
            F.lit(prefix).alias("prefix"),
            (F.array_position(values, v) - 1).cast("int").alias("pos"),
            hash_token(prefix, v, salt).alias("token"),
            v.alias("original"),
        ),
    )


def named(pattern: str, values: Column) -> Column:
    return F.transform(
        values, lambda v: F.struct(F.lit(pattern).alias("pattern"), v.alias("value"))
    )


def replace_all(text: Column, pairs: Column, find: str = "find", put: str = "put") -> Column:
    """Apply an array of structs as literal replacements ``find`` -> ``put``, in order."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p[find], p[put]))


def enabled_patterns(switches: dict[str, bool]) -> list[tuple[str, str, str]]:
    return [p for p in fixed.PII_PATTERNS if switches.get(p[0], True)]
