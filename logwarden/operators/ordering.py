"""Scale-safe building blocks for order-dependent work.

A window over one hot group, or over no group at all, ends in one task. These
helpers cut such a group into ranges or slices of its order column, so that no task
sees all of it, and put the exact result back together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.landing import land


def slice_of(order: Column, width: int) -> Column:
    """Floor division that also holds for negative numbers."""
    return F.call_function("div", order - F.pmod(order, F.lit(width)), F.lit(width))


def running_rank(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    *,
    ties: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Exact ``row_number() over (partition by *by order by order, *ties)``.

    Rows are dealt to tasks by ranges of (by, order, ties), which Spark takes from a
    sample: outliers, bursts and gaps in the order do not make a large range, and a hot
    group is many ranges. Rows equal in all of these are told apart by a hash of the row, so
    that they too can be split; only rows equal in every column stay together. Rows are
    numbered within their range and landed, so the ranges stay as they are; the sizes
    of the ranges, summed up in order, give each its start. No row is left out: nulls in ``by`` are
    a group, and rows with a null in ``order`` come last in theirs. ``df`` is read twice (sample, then rows): land it first when
    it is costly.
    """
    by = list(by)
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    keys = [*by, "_last", order, *ties, "_tie"]
    ranged = (
        df.withColumns({"_tie": F.xxhash64(*hashed), "_last": F.col(order).isNull()})
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({
            "_part": F.spark_partition_id(),
            "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        })
    )
    placed = land(ranged.drop("_tie", "_last"), "ranked")
    sizes = placed.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low")
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # landed, so that its size is known before the rows are read: rows are not shuffled to meet a small table
    starts = land(sizes.select(
        *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_of"), "_low",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    ), "starts")
    same = F.col("_part") == F.col("_of")
    for k, c in enumerate(by):
        same = same & placed[c].eqNullSafe(starts[f"_by{k}"])
    return (
        placed.join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_i") - F.col("_low") + 1)
        .drop("_part", "_i", "_low", "_start", "_of", *[f"_by{k}" for k in range(len(by))])
    )


def with_halo(df: DataFrame, position: str, reach: int, width: int) -> DataFrame:
    """Copy rows that lie within ``reach`` of a slice's end into the next slice too.

    A trailing frame of up to ``reach`` positions can then run per ``_slice``;
    keep the rows with ``_home`` afterwards. ``reach`` must not exceed ``width``.
    """
    if reach > width:
        raise ValueError("reach must not exceed width")
    here = slice_of(F.col(position), width)
    near_end = F.pmod(F.col(position), F.lit(width)) >= width - reach
    spread = df.withColumn("_own", here).withColumn(
        "_slice",
        F.explode(
            F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(
                F.array(F.col("_own"))
            )
        ),
    )
    return spread.withColumn("_home", F.col("_slice") == F.col("_own")).drop("_own")
