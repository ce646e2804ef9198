"""The whole path as one plan: lines -> findings -> alerts -> rules -> ledger."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import batches as B
from ..operators import ingest, mask, noise, respond, rules, scoring
from ..options import Options
from ..sources.landing import land

SCOPE = ("source_label",)


def entries(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Parsed access entries with noise flag and actor."""
    parsed = ingest.parse_access(lines)
    return noise.with_noise(parsed, options.noise).withColumn("actor", mask.actor_key())


def masked_entries(lines: DataFrame, options: Options) -> DataFrame:
    """Entries whose actor is a token: nothing downstream sees an address."""
    parsed = noise.with_noise(ingest.parse_access(lines), options.noise)
    address = "_address"
    masked = mask.masked_actor(mask.mask_hashed(parsed, options.mask, address=address), options.mask, address)
    return masked.drop(address)


def masked_facts(lines: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """What the rules read of masked entries, and the dictionary (token, original) of their actors.

    For responses that quote no text: of the patterns only the first runs, and the parsed lines are landed
    without text, with the dictionary's side apart.
    """
    parsed = noise.with_noise(ingest.parse_access(lines), options.noise)
    masked = mask.masked_actor(
        mask.mask_hashed(parsed, options.mask, address="_address"), options.mask, "_address")
    facts = land(masked.select(
        "seq", "ts", "source_label", "source_ip", "actor", "method", "path", "status", "response_size", "user_agent",
        "is_noise", "_address"), "masked")
    return facts.drop("source_ip", "_address"), mask.actor_dictionary(facts, "_address")


class Ingested(NamedTuple):
    entries: DataFrame
    rejected: DataFrame


def ingest_all(lines: DataFrame, sources: DataFrame, options: Options = Options()) -> Ingested:
    """Lines of all registered sources and formats: entries, and what is kept aside with its reason.

    Entries are masked if masking has a salt, and have a noise flag and an actor. The lines are
    parsed once into a landed table that both results read.
    """
    routed = land(ingest.route(lines, sources, options.ingest), "routed")
    rejected = routed.where(F.col("reason").isNotNull()).select(
        "seq", "source_label", "raw_line", "reason")
    parsed = noise.with_noise(
        routed.where(F.col("reason").isNull()).drop("format", "tags", "reason"), options.noise)
    if not options.mask.salt:
        return Ingested(parsed.withColumn("actor", mask.actor_key()), rejected)
    masked = mask.mask_hashed(parsed, options.mask)
    return Ingested(mask.masked_actor(masked, options.mask), rejected)


def in_windows(entries_: DataFrame, width: str) -> DataFrame:
    """Add ``window_start``, for detection per window: scope=("source_label", "window_start")."""
    return entries_.withColumn("window_start", F.window("ts", width)["start"])


class Response(NamedTuple):
    alerts: DataFrame
    targets: DataFrame
    rules: DataFrame


def second_level(assessments: DataFrame, scope: Sequence[str]) -> DataFrame:
    """A scorer's assessments in the shape of findings: one per batch, named by it.

    The addresses and paths that the scorer names are bounded by its reply. ``ips`` and
    ``paths`` carry them on, as do ``zone_name`` and ``rate``.
    """
    one = lambda some, alone: F.when(
        F.coalesce(F.size(some), F.lit(0)) > 0, F.array_distinct(some)
    ).otherwise(F.array_compact(F.array(alone)))
    ips = one(F.col("details.ips"), F.nullif(F.col("details.ip"), F.lit("")))
    paths = one(F.col("details.paths"), F.nullif(F.col("details.path"), F.lit("")))
    # a batch is of one source; what else the scope has, it does not know
    extra = [F.lit(None).alias(c) for c in scope if c not in assessments.columns]
    return assessments.select(
        F.concat(F.lit("batch "), "batch_id").alias("rule"),
        *[c for c in scope if c in assessments.columns], *extra,
        F.lit(None).cast("string").alias("actor"), "category", "severity", "confidence", "summary",
        "indicators", "recommended_action", F.get(ips, F.lit(0)).alias("ip"),
        F.size(ips).cast("bigint").alias("n_ips"), F.get(paths, F.lit(0)).alias("path"),
        F.col("n_rows").cast("bigint").alias("n"), F.col("n_rows").cast("bigint").alias("n_rows"),
        "first_seq", "analyzed_by", F.col("details.zone_name").alias("zone_name"),
        F.col("details.rate").alias("rate"), ips.alias("ips"), paths.alias("paths"),
    )


def respond_to(
    entries_: DataFrame,
    created_at: Column,
    options: Options = Options(),
    dictionary: DataFrame | None = None,
    *,
    scope: Sequence[str] = SCOPE,
    assessments: DataFrame | None = None,
) -> Response:
    """Findings of the rules, and a scorer's ``assessments``, as gated alerts with proposed rules.

    Runs the detection once and lands its (scope, actor) table. ``assessments`` come from
    ``score_open``; they and the findings are one table from here on.
    """
    # the one pass over the input; what follows reads its small result several times
    actors = land(rules.profile(entries_, tuple(scope), options.rules), "actors")
    return respond_from(actors, created_at, options, dictionary, scope=scope,
                        assessments=assessments, entries_=entries_)


def respond_from(
    actors: DataFrame,
    created_at: Column,
    options: Options = Options(),
    dictionary: DataFrame | None = None,
    *,
    scope: Sequence[str] = SCOPE,
    assessments: DataFrame | None = None,
    entries_: DataFrame | None = None,
    raised: DataFrame | None = None,
) -> Response:
    """The response out of the (scope, actor) table of ``rules.profile``, which is read several times.

    Alerts whose ids are in ``raised`` are left out. Only ``actor_scope="scope"`` needs the entries.
    """
    scope = tuple(scope)
    found = rules.findings_of(actors, scope, options.rules).withColumn(
        "indicators", F.array("indicator")).drop("indicator")
    key = ("rule", *scope, "actor")
    everything = found
    if assessments is not None:
        judged = second_level(assessments, scope)
        judged = judged.withColumns({
            c: F.col(c).cast(found.schema[c].dataType) for c in scope if c not in assessments.columns})
        everything = found.unionByName(judged, allowMissingColumns=True)
    fresh = respond.raise_alerts(everything, key, created_at, options.alerts)
    if raised is not None:
        fresh = fresh.join(raised.select("alert_id"), "alert_id", "left_anti")
    alerts = land(fresh, "alerts")
    if options.rules.actor_scope == "scope":
        if entries_ is None:
            raise ValueError("lists of all actors of a scope need its entries")
        named = rules.finding_actors(actors, scope, options.rules).where(
            F.col("actor").isNotNull()
        ).unionByName(rules.scope_actors(entries_, found, scope))
    else:
        named = rules.finding_actors(actors, scope, options.rules)
    targets = named.select(
        respond.alert_id(*key).alias("alert_id"), "ip", F.col("ip_seq").alias("ord")
    )
    path_targets = None
    if assessments is not None:
        place = lambda name, alone: alerts.select(
            "alert_id", F.posexplode(name).alias("k", alone)
        ).select("alert_id", alone, F.col("k").cast("bigint").alias("ord"))
        targets = targets.unionByName(place("ips", "ip"))
        own = alerts.where("paths is null and coalesce(path, '') <> ''").select(
            "alert_id", "path", F.lit(0).cast("bigint").alias("ord"))
        path_targets = own.unionByName(place("paths", "path"))
        alerts = alerts.drop("ips", "paths")
    proposed = land(
        respond.mitigation_rules(alerts, targets, options.response, dictionary, path_targets),
        "rules",
    )
    gated = respond.gate(alerts, proposed, created_at, options.response)
    return Response(gated, targets, proposed)


#: What batches, rules, texts and contexts read of an entry, besides its text and its scope.
READ = ("seq", "ts", "source_label", "actor", "method", "path", "status", "user_agent", "is_noise")
#: Fields that contexts quote: a masked line's own are masked like the line, where that changes them.
QUOTED = ("path", "user_agent")


def for_scoring(
    entries_: DataFrame, text: str = "sanitized_line", *, scope: Sequence[str] = SCOPE
) -> DataFrame:
    """The columns that ``open_batches`` reads; contexts' masked fields are put beside the clear ones.

    A table of these serves the rules too, and is a fraction of the entries.
    """
    keep = list(dict.fromkeys([*READ, *scope, text]))
    if "token_list" not in entries_.columns:
        return entries_.select(*keep, *[f"_shown_{name}" for name in QUOTED if f"_shown_{name}" in entries_.columns])
    shown = [
        F.nullif(mask.mask_with(F.col(name), F.col("token_list")), F.col(name)).alias(f"_shown_{name}")
        for name in QUOTED
    ]
    return entries_.select(*keep, *shown)


def open_batches(
    entries_: DataFrame,
    options: Options,
    text: str = "sanitized_line",
    *,
    scope: Sequence[str] = SCOPE,
    landed: bool = False,
) -> DataFrame:
    """Batches no rule caught, with the texts a scorer gets.

    Needs ``entries`` with ``text``; adds batch_text, source_label, context_text.
    What is read of the entries is landed, as the ranking reads it twice (``landed``: they are a landed table of
    ``for_scoring``); rules, texts and contexts read the ranked rows. With ``options.batch.consume`` the rows that a
    rule took are in no context: a scorer sees the last rows that are still unexplained.
    """
    rows = entries_ if landed else land(for_scoring(entries_, text, scope=scope), "entries")
    # noise counts in a batch's rows, and is in no text and no context
    batched = B.assign_batches(rows, options.batch).where(~F.col("is_noise"))
    labelled = rules.label_rows(batched, tuple(scope), options.rules)
    if options.batch.consume:
        # contexts leave out single rows: these are landed with their labels, and need no join to tell which
        batched = land(labelled, "labelled")
        taken = batched.where(F.col("label").isNotNull())
    else:
        taken = land(labelled.where(F.col("label").isNotNull()).select("seq", "batch_id"), "taken")
    caught = taken.select("batch_id").distinct()
    texts = B.batch_texts(batched, text).join(caught, "batch_id", "left_anti")
    shown = batched.withColumns({
        name: F.coalesce(f"_shown_{name}", name) for name in QUOTED if f"_shown_{name}" in batched.columns})
    if options.batch.consume:
        shown = shown.where(F.col("label").isNull()).select(*READ, "batch_id")
    contexts = B.batch_contexts(shown, options.batch, without=caught)
    # the text is shorter than the rows it sums up
    summed = contexts.select("batch_id", B.context_text(F.col("context")).alias("context_text"))
    return texts.join(summed, "batch_id", "left")


def score_open(
    entries_: DataFrame,
    fast: scoring.Scorer,
    deep: scoring.Scorer | None,
    options: Options,
    text: str = "sanitized_line",
    *,
    scope: Sequence[str] = SCOPE,
    landed: bool = False,
) -> DataFrame:
    """Second-level assessments of the batches the rules left open.

    Landed: each batch is scored once, however often the result is read.
    """
    texts = open_batches(entries_, options, text, scope=scope, landed=landed)
    return land(scoring.cascade(texts, fast, deep, options.score), "assessments")
