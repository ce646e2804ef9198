"""Log files as tables and streams of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .landing import land


def _labelled(raw: DataFrame, labels: dict[str, str] | None, *extra: str) -> DataFrame:
    """Label from the file's path: a listed path part, else the file name."""
    path = F.col("_metadata.file_path")
    name = F.col("_metadata.file_name")
    label = None
    for part, text in (labels or {}).items():
        hit = path.contains(part)
        label = F.when(hit, text) if label is None else label.when(hit, text)
    chosen = name if label is None else label.otherwise(name)
    return raw.where(F.col("value") != "").select(
        chosen.alias("source_label"), F.col("value").alias("raw_line"),
        path.alias("file_path"),
        *extra,
    )


def read_lines(
    spark: SparkSession, paths: Sequence[str], labels: dict[str, str] | None = None
) -> DataFrame:
    """Non-empty lines of all files: seq, source_label, raw_line, file_path.

    ``seq`` is a total order: file by file in order of their paths, and as the lines stand in
    a file. It has gaps only where empty lines were. Spark reads a file in splits: lines are counted per split,
    the counts (landed, a row per split) are summed up in order, and a line's number is its
    split's start and its place there. Files that change between the two reads are an
    error of the caller; ship or rotate them first.
    """
    raw = spark.read.text(list(paths)).withColumns({
        "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id(),
    })
    lines = _labelled(raw, labels, "_block", "_row")
    sizes = land(lines.groupBy("file_path", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"), F.max("_row").alias("_high")
    ), "splits")
    before = Window.orderBy("file_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    # empty lines are left out but have a place: a split's places are counted with them
    starts = sizes.select("file_path", "_block", "_low", F.coalesce(
        F.sum(F.col("_high") - F.col("_low") + 1).over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, ["file_path", "_block"]).select(
        (F.col("_start") + F.col("_row") - F.col("_low")).alias("seq"),
        "source_label", "raw_line", "file_path",
    )


def stream_lines(
    spark: SparkSession,
    folder: str,
    labels: dict[str, str] | None = None,
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """Lines of files as they are shipped into a folder.

    The file source reads each file once: use it for rotated or shipped files,
    and ``sources.tail`` for files that grow in place. The limits are the
    back-pressure: what one micro-batch may take in.
    """
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _labelled(reader.text(folder), labels)
