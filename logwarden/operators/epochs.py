"""Fresh tokens after a time to live: every row gets the token of the epoch it falls in.

``mask.token_epochs`` says when a value's epochs begin. An epoch lasts ``ttl`` seconds, so it touches two
slices of time at most, and a row is in one: rows meet epochs by (value, slice), an equality join in
which a hot value is as many keys as it has slices. Nothing is searched within a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import masking as M
from ..options import MaskOptions
from ..sources.landing import land
from . import mask
from .ordering import slice_of


def with_epochs(
    rows: DataFrame, epochs: DataFrame, ttl_seconds: int, value: str = "value", at: str = "epoch"
) -> DataFrame:
    """Rows with ``epoch_no`` and ``epoch_start``, the epoch of their value that their second falls in.

    ``epochs``: value, epoch_no, epoch_start. Rows of no epoch get nulls.
    """
    width = ttl_seconds + 1
    spans = epochs.select(
        F.col("value").alias("_value"), "epoch_no", "epoch_start",
        F.explode(F.array_distinct(F.array(
            slice_of(F.col("epoch_start"), width), slice_of(F.col("epoch_start") + ttl_seconds, width)
        ))).alias("_slice"),
    )
    second = F.col(at)
    meets = (
        (F.col(value) == F.col("_value")) & (slice_of(second, width) == F.col("_slice"))
        & (second >= F.col("epoch_start")) & (second <= F.col("epoch_start") + ttl_seconds)
    )
    return rows.join(spans, meets, "left").drop("_value", "_slice")


def fresh_token(prefix: Column, original: Column, epoch_start: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), original, F.lit("|"), epoch_start.cast("string")), 256)
    return F.concat(prefix, F.substring(digest, 1, M.TOKEN_HEX), F.lit("]"))


def epoch_occurrences(masked: DataFrame, options: MaskOptions) -> DataFrame:
    """One row per (line, value): seq, epoch, prefix, original, hashed, epoch_no, epoch_start, token.

    ``masked``: seq, ts, token_list. ``token`` is new in every epoch of its value.
    """
    found = mask._unfold(masked.select("seq", "ts", "token_list"), F.col("token_list"), "t").select(
        "seq", F.unix_seconds("ts").alias("epoch"), "t.prefix", "t.original", F.col("t.token").alias("hashed"))
    found = land(found, "sightings")
    epochs = mask.token_epochs(found.select(F.col("hashed").alias("value"), "epoch"), options.token_ttl)
    return with_epochs(found, land(epochs, "epochs"), options.token_ttl, "hashed").withColumn(
        "token", fresh_token(F.col("prefix"), F.col("original"), F.col("epoch_start"), options.salt))


def epoch_dictionary(occurrences: DataFrame) -> DataFrame:
    """(token, original, created_at): what a token stood for, and since when. Resolves with ``mask.resolve_tokens``."""
    return occurrences.groupBy("token", "original", "epoch_start").agg(F.count(F.lit(1)).alias("_n")).select(
        "token", "original", F.timestamp_seconds("epoch_start").alias("created_at"))


def mask_epochs(masked: DataFrame, occurrences: DataFrame, out: str = "sanitized_line") -> DataFrame:
    """Swap the hashed tokens in ``out`` for those of their epochs; names come back per line as a set."""
    names = occurrences.groupBy("seq").agg(
        F.collect_set(F.struct(F.col("hashed").alias("find"), F.col("token").alias("put"))).alias("_names"))
    return masked.join(names, "seq", "left").withColumn(
        out, F.when(F.col("_names").isNull(), F.col(out)).otherwise(M.replace_all(F.col(out), F.col("_names")))
    ).drop("_names")
