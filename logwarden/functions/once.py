"""Keep costly expressions from being copied by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` (a struct) such that filters on it do not recompute it.

    Catalyst pushes a filter below the projection it reads, and so copies the
    projection's expressions into the filter, once per mention. A line would run
    through its regex many times. A filter cannot move below a generator, so the
    struct goes through one that yields exactly one row.
    """
    return df.withColumn(name, F.explode(F.array(value)))
