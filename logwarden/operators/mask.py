"""Masking of personal data with reversible tokens.

Hashed tokens (the default) are a function of salt and value: no shuffle, the
same in every batch and stream. Numbered tokens are hashed masking followed by
a rename through a dictionary ordered by first appearance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions import masking as M
from ..options import MaskOptions
from ..sources.landing import land
from .ordering import running_rank

TOKEN_LIST = "array<struct<prefix:string,pos:int,token:string,original:string>>"


def mask_hashed(
    df: DataFrame, options: MaskOptions, text: str = "raw_line", out: str = "sanitized_line",
    address: str | None = None,
) -> DataFrame:
    """Add ``out`` (masked text) and ``token_list`` (what was swapped, in that order).

    ``address`` adds the first address's entry of that list under this name, which needs no more than the
    first pattern: a plan that reads neither text nor list runs no other.

    Patterns run one after the other on the text the previous one left. Within
    a pattern the longest match goes first, so a value that is part of another
    cannot damage it.
    """
    if not options.enabled:
        none = F.expr(f"cast(array() as {TOKEN_LIST})")
        extra = {address: F.get(none, F.lit(0))} if address else {}
        return df.withColumn(out, F.col(text)).withColumns({**extra, "token_list": none})
    if not options.salt:
        raise ValueError("hashed tokens need a salt")
    work = df.withColumn(out, F.col(text))
    lists = []
    for name, pattern, prefix in M.enabled_patterns(options.patterns):
        found, tokens = f"_found_{name}", f"_tokens_{name}"
        work = work.withColumn(found, M.pii_matches(name, pattern, F.col(out)))
        work = work.withColumn(tokens, M.token_entries(F.col(found), prefix, options.salt))
        if address and prefix == "[IP_":
            work = work.withColumn(address, F.get(tokens, F.lit(0)))
        masked = mask_with(F.col(out), F.col(tokens))
        work = work.withColumn(
            out, F.when(F.size(tokens) == 0, F.col(out)).otherwise(masked)
        ).drop(found)
        lists.append(tokens)
    token_list = F.concat(*lists) if lists else F.expr(f"cast(array() as {TOKEN_LIST})")
    if address and address not in work.columns:  # the pattern is switched off
        work = work.withColumn(address, F.get(F.expr(f"cast(array() as {TOKEN_LIST})"), F.lit(0)))
    return work.withColumn("token_list", token_list).drop(*lists)


def _unfold(df: DataFrame, values: Column, name: str) -> DataFrame:
    """Explode without the emptiness filter Catalyst would add below the masking.

    That filter would copy the masking expressions and run them twice.
    """
    return df.withColumn(name, F.explode_outer(values)).where(F.col(name).isNotNull())


def mask_with(text: Column, token_list: Column) -> Column:
    """Mask another field of a line with the tokens of the line."""
    return M.replace_all(text, token_list, "original", "token")


def unmask(text: Column, token_list: Column) -> Column:
    """Exact inverse: the swaps are undone in reverse order."""
    return M.replace_all(text, F.reverse(token_list), "token", "original")


def pii_hits(df: DataFrame, text: str, switches: dict[str, bool] | None = None) -> DataFrame:
    """Rows of (pattern, value) found in the untouched text, one per row and value."""
    found = F.concat(
        *[
            M.named(name, M.pii_matches(name, pattern, F.col(text)))
            for name, pattern, _ in M.enabled_patterns(switches or {})
        ]
    )
    kept = [c for c in df.columns if c != text]
    return _unfold(df, found, "_hit").select(*kept, "_hit.pattern", "_hit.value")


def actor_key(source_ip: str = "source_ip", text: str = "raw_line") -> Column:
    """Who sent the request: IP token or IPv4 of the line, else the parsed address.

    On a masked row pass the sanitized text and no address column outside of it,
    so that no unmasked address can come out.
    """

    line = F.col(text)
    token = F.when(line.contains("[IP_"), F.regexp_extract(line, fixed.IP_TOKEN, 0))
    known = F.filter(
        F.array(token, F.regexp_extract(line, fixed.IPV4_IN_TEXT, 0), F.col(source_ip)),
        lambda v: v != "",
    )
    return F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))


def _own_address(masked: DataFrame, address: str | None) -> Column:
    if address:
        return F.col(address)
    return F.get(F.filter("token_list", lambda t: t["prefix"] == "[IP_"), F.lit(0))


def masked_actor(masked: DataFrame, options: MaskOptions, address: str | None = None) -> DataFrame:
    """Actor of masked rows: first IP token, else the parsed address hashed.

    Behind a one-row generator: a filter on it must not copy the masking into itself.
    ``address`` is the column that ``mask_hashed`` added, if it was asked to.
    """
    hidden = F.when(
        F.col("source_ip") != "", M.hash_token("[IP_", F.col("source_ip"), options.salt)
    )
    actor = F.coalesce(_own_address(masked, address)["token"], hidden, F.lit("unknown"))
    return masked.withColumn("actor", F.explode(F.array(actor)))


def actor_dictionary(masked: DataFrame, address: str | None = None) -> DataFrame:
    """(token, original) of every masked actor. Sensitive: keep it apart from the rows."""
    original = F.coalesce(_own_address(masked, address)["original"], F.nullif("source_ip", F.lit("")))
    return masked.groupBy(F.col("actor").alias("token")).agg(F.min(original).alias("original"))


def token_occurrences(masked: DataFrame) -> DataFrame:
    """One row per (seq, token), with its place among the line's matches."""
    return _unfold(masked.select("seq", "token_list"), F.col("token_list"), "t").select(
        "seq", "t.prefix", "t.pos", "t.token", "t.original"
    )


def token_dictionary(occurrences: DataFrame) -> DataFrame:
    """Number the tokens of each prefix by first appearance.

    Columns: prefix, hashed (the hashed token), original, first_seq, number,
    token. First appearances are found with a partial aggregate; the numbering
    never sorts a prefix in one task.
    """
    first = occurrences.groupBy("prefix", F.col("token").alias("hashed")).agg(
        F.min(F.struct("seq", "pos", "original")).alias("f")
    )
    # distinct tokens are few next to the lines; without landing them, the numbering
    # would mask every line a second time
    flat = land(first.select(
        "prefix",
        "hashed",
        F.col("f.original").alias("original"),
        F.col("f.seq").alias("first_seq"),
        F.col("f.pos").alias("first_pos"),
    ), "tokens")
    ranked = running_rank(
        flat, "first_seq", ["prefix"], ties=["first_pos"], name="number",
    )
    digits = F.col("number").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))
    return ranked.withColumn("token", F.concat("prefix", padded, F.lit("]"))).drop("first_pos")


def mask_numbered(
    masked: DataFrame, dictionary: DataFrame, out: str = "sanitized_line"
) -> DataFrame:
    """Rename hashed tokens in ``out`` to numbered ones.

    A hot value may occur in a third of the lines: adaptive execution splits its key in
    the dictionary join. The names come back per ``seq`` as a set (equal numbers must not
    multiply them) and meet the text there.
    """
    # only the line's last text counts: a token swallowed by a later pattern is gone
    tokens = F.array_distinct(F.regexp_extract_all(out, F.lit(f"({fixed.ANY_TOKEN})"), F.lit(1)))
    present = _unfold(masked.select("seq", out), tokens, "hashed").drop(out)
    names = present.join(dictionary.select("hashed", "token"), "hashed")
    per_line = names.groupBy("seq").agg(
        F.collect_set(F.struct(F.col("hashed").alias("find"), F.col("token").alias("put"))).alias(
            "_names"
        )
    )
    joined = masked.join(per_line, "seq", "left")
    return joined.withColumn(
        out,
        F.when(F.col("_names").isNull(), F.col(out)).otherwise(
            M.replace_all(F.col(out), F.col("_names"))
        ),
    ).drop("_names")


# --- token lookups with a time to live ---------------------------------------


def resolve_tokens(requests: DataFrame, dictionary: DataFrame, ttl_seconds: int) -> DataFrame:
    """Token -> original at ``asked_at``; unknown or expired tokens give null.

    ``dictionary``: token, original, created_at (one row per token).
    """
    live = F.unix_seconds("asked_at") - F.unix_seconds("created_at") <= ttl_seconds
    joined = requests.join(dictionary.select("token", "original", "created_at"), "token", "left")
    return joined.withColumn("original", F.when(live, F.col("original"))).drop("created_at")


def purge_expired(dictionary: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Flag the dictionary rows that are older than the time to live."""
    age = F.unix_seconds(as_of) - F.unix_seconds("created_at")
    return dictionary.withColumn("expired", age > ttl_seconds)


def token_epochs(occurrences: DataFrame, ttl_seconds: int) -> DataFrame:
    """When a value got a fresh token: (value, epoch_no, epoch_start, n_seen).

    The first sight opens an epoch, and it is never refreshed; the first sight
    more than ``ttl`` after an epoch's start opens the next one. Each step
    depends on the one before, so the fold runs along sorted rows. Its input is
    one row per value and second, however often a value occurs, and a task keeps
    one anchor in memory.

    ``occurrences``: value STRING, epoch BIGINT (seconds).
    """
    import numpy as np
    import pandas as pd

    seconds = (
        occurrences.groupBy("value", "epoch")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition("value")
        .sortWithinPartitions("value", "epoch")
    )

    def fold(batches):
        value, anchor, number, seen = None, 0, 0, 0
        for pdf in batches:
            rows = []
            names = pdf["value"].to_numpy()
            times, counts = pdf["epoch"].to_numpy(), pdf["n"].to_numpy()
            totals = np.concatenate([[0], np.cumsum(counts)])
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                at = lo
                if lo == hi:
                    continue
                if names[lo] != value:
                    if value is not None:
                        rows.append((value, number, anchor, seen))
                    value, anchor, number, seen = names[lo], times[lo], 1, 0
                while at < hi:
                    # jump straight to the first time past this epoch
                    end = lo + int(np.searchsorted(times[lo:hi], anchor + ttl_seconds, "right"))
                    seen += int(totals[end] - totals[at])
                    at = end
                    if at < hi:
                        rows.append((value, number, anchor, seen))
                        anchor, number, seen = times[at], number + 1, 0
            yield pd.DataFrame(rows, columns=["value", "epoch_no", "epoch_start", "n_seen"])
        if value is not None:
            yield pd.DataFrame(
                [(value, number, anchor, seen)],
                columns=["value", "epoch_no", "epoch_start", "n_seen"],
            )

    return seconds.mapInPandas(
        fold, "value string, epoch_no bigint, epoch_start bigint, n_seen bigint"
    )
