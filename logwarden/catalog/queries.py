"""One query per operator, over whole tables. Times leave as epoch seconds or text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import verdict as V
from ..operators import activity, batches as B, epochs, ingest, mask, noise, respond, rules
from ..operators import scoring, stats
from ..options import BatchOptions, MaskOptions, Options, ResponseOptions
from ..plans import detection as P
from ..sources import files, registry, tail
from ..sources.landing import fresh_folder, land
from ..streaming import correlate, detect, live, stateful
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]

SALT = "fixture-salt"
AS_OF = 1_706_745_600  # 2024-02-01 00:00:00 UTC, just after the last event
OPTIONS = Options(
    mask=MaskOptions(salt=SALT),
    # the events are spread thinly over a month, so batches fill up over a day
    batch=BatchOptions(interval_seconds=86_400),
    response=ResponseOptions(auto_approve_severity=("low", "medium")),
)
DAY = ("day",)
TOKEN_TTL = 10 * 86_400

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entries(D.access_lines(spark, sf_dir), OPTIONS)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where(~F.col("is_noise"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.masked_entries(D.access_lines(spark, sf_dir), OPTIONS)


def _created() -> Column:
    """Alert times spread over the ten minutes before ``AS_OF``."""
    return F.timestamp_seconds(F.lit(AS_OF) - F.pmod("first_seq", F.lit(600)))


def _response(spark: SparkSession, sf_dir: str) -> P.Response:
    return P.respond_to(_entries(spark, sf_dir), _created(), OPTIONS)


def _as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


# --- sources and parsing --------------------------------------------------------


@query
def source_registry(spark, sf_dir):
    sources = registry.load_sources(spark, D.SITES)
    return registry.lines_per_source(D.all_lines(spark, sf_dir), sources)


@query
def log_lines(spark, sf_dir):
    """Lines written out as text files per source, and read back as such."""
    folder = fresh_folder(spark, "lines")
    lines = D.all_lines(spark, sf_dir).select("source_label", "raw_line")
    lines.write.partitionBy("source_label").text(folder)
    labels = {f"source_label={s['name']}/": s["name"] for s in D.SITES["sources"]}
    return files.read_lines(spark, [folder], labels).select("source_label", "raw_line")


@query
def parse_access_logs(spark, sf_dir):
    return ingest.parse_access(D.access_lines(spark, sf_dir)).select(
        "seq", F.unix_seconds("ts").alias("ts_epoch"), "source_ip", "method", "path", "status",
        "response_size", "user_agent", "referer", "source_label",
    )


@query
def parse_syslog(spark, sf_dir):
    return ingest.parse_syslog(D.auth_lines(spark, sf_dir), OPTIONS.ingest).select(
        "seq", F.unix_seconds("ts").alias("ts_epoch"), "source_ip", "method", "path", "status"
    )


def _routed(spark, sf_dir):
    sources = registry.load_sources(spark, D.SITES)
    return ingest.route(D.all_lines(spark, sf_dir), sources, OPTIONS.ingest)


@query
def format_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        "seq", "source_label", "format", F.array_join("tags", ",").alias("tags"), "reason",
        "method", "path", "status",
    )


@query
def format_coverage(spark, sf_dir):
    return ingest.format_coverage(D.access_lines(spark, sf_dir), "nginx").withColumn(
        "coverage", F.round("coverage", 6)
    )


@query
def malformed_lines(spark, sf_dir):
    """Lines that do not parse: damaged ones, and auth lines taken for access lines."""
    return ingest.quarantine(D.all_lines(spark, sf_dir), "nginx")


# --- noise ------------------------------------------------------------------------


@query
def noise_classification(spark, sf_dir):
    return _entries(spark, sf_dir).select("seq", "path", "is_noise", "noise_reason")


@query
def noise_summary(spark, sf_dir):
    return noise.noise_summary(_entries(spark, sf_dir)).withColumn(
        "noise_rate", F.round("noise_rate", 6)
    )


@query
def noise_reasons(spark, sf_dir):
    options = OPTIONS.overlay({"noise": {"ignore_status_codes": [404], "small_get_below": 500}})
    parsed = ingest.parse_access(D.access_lines(spark, sf_dir))
    return noise.noise_reasons(noise.with_noise(parsed, options.noise))


@query
def health_semi_join(spark, sf_dir):
    paths = spark.createDataFrame([(p,) for p in OPTIONS.noise.health_paths], "path string")
    return noise.health_rows(_entries(spark, sf_dir), paths).select("seq", "path", "actor")


# --- masking ----------------------------------------------------------------------


@query
def pii_scan(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("text"))
    hits = mask.pii_hits(documents.unionByName(pages), "text")
    return hits.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n_texts"))


@query
def anonymize_hashed(spark, sf_dir):
    return _masked(spark, sf_dir).select(
        "seq", "sanitized_line", F.size("token_list").alias("n_tokens")
    )


@query
def token_dictionary(spark, sf_dir):
    found = mask.token_occurrences(_masked(spark, sf_dir))
    return mask.token_dictionary(found).select(
        "prefix", "token", "hashed", "original", "first_seq"
    )


@query
def anonymize_numbered(spark, sf_dir):
    masked = land(_masked(spark, sf_dir), "masked")
    dictionary = mask.token_dictionary(mask.token_occurrences(masked))
    return mask.mask_numbered(masked, dictionary).select("seq", "sanitized_line")


@query
def deanonymize_roundtrip(spark, sf_dir):
    return _masked(spark, sf_dir).select(
        "seq",
        mask.unmask(F.col("sanitized_line"), F.col("token_list")).alias("restored"),
        F.expr("sanitized_line <> raw_line").alias("was_masked"),
    )


@query
def actor_key(spark, sf_dir):
    return _entries(spark, sf_dir).select("seq", "actor")


def _ip_occurrences(spark, sf_dir):
    masked = _masked(spark, sf_dir)
    return masked.select("ts", "seq", F.explode_outer("token_list").alias("t")).where(
        F.col("t.prefix") == "[IP_"
    ).select("seq", "ts", "t.token", "t.original")


def _ip_dictionary(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("token", "original").agg(F.min("ts").alias("created_at"))


@query
def resolve_tokens(spark, sf_dir):
    seen = land(_ip_occurrences(spark, sf_dir), "ip-tokens")
    asked = seen.select("seq", "token", F.col("ts").alias("asked_at"))
    return mask.resolve_tokens(asked, _ip_dictionary(seen), TOKEN_TTL).select(
        "seq", "token", "original"
    )


@query
def token_purge(spark, sf_dir):
    dictionary = _ip_dictionary(_ip_occurrences(spark, sf_dir))
    flagged = mask.purge_expired(dictionary, _as_of(), 30 * 86_400)
    return flagged.select("token", F.unix_seconds("created_at").alias("created"), "expired")


def _sightings(spark, sf_dir):
    return _entries(spark, sf_dir).select(
        F.col("actor").alias("value"), F.unix_seconds("ts").alias("epoch"), "ts"
    )


@query
def token_epochs_ttl(spark, sf_dir):
    return mask.token_epochs(_sightings(spark, sf_dir).drop("ts"), OPTIONS.mask.token_ttl)


# --- statistics --------------------------------------------------------------------


@query
def batch_overview(spark, sf_dir):
    return stats.overview(_daily(spark, sf_dir), DAY)


@query
def ip_stats(spark, sf_dir):
    return stats.ip_stats(_daily(spark, sf_dir), DAY)


@query
def ip_status_hist(spark, sf_dir):
    return stats.ip_status_ranked(_daily(spark, sf_dir), DAY)


@query
def ip_path_topk(spark, sf_dir):
    return stats.ip_top_paths(_daily(spark, sf_dir), DAY)


@query
def ip_top_method(spark, sf_dir):
    return stats.ip_top_method(_daily(spark, sf_dir), DAY)


@query
def ip_user_agents(spark, sf_dir):
    return stats.ip_sample_agents(_daily(spark, sf_dir), DAY)


@query
def path_stats(spark, sf_dir):
    return stats.path_stats(_daily(spark, sf_dir), DAY)


@query
def path_status_hist(spark, sf_dir):
    return stats.path_status(_daily(spark, sf_dir), DAY)


@query
def path_stats_sketched(spark, sf_dir):
    """Sketches of the actors per (day, path), stored, merged over the days; is the estimate within 2 % of the count?"""
    entries = _daily(spark, sf_dir)
    daily = land(stats.path_sketches(entries, DAY), "sketches")
    estimated = stats.sketched_counts(stats.merged_sketches(daily, ()))
    exact = stats.path_stats(entries, ()).select("path", F.col("n_ips").alias("exact"))
    return estimated.join(exact, "path").select(
        "path", "request_count", "first_seq", F.col("exact").alias("n_ips"),
        (F.abs(F.col("n_ips") - F.col("exact")) <= F.col("exact") * 0.02).alias("within"))


@query
def frequent_paths(spark, sf_dir):
    return stats.frequent_paths(_daily(spark, sf_dir), DAY)


# --- rules -------------------------------------------------------------------------


def _matching(spark, sf_dir, predicate: Column) -> DataFrame:
    return _signal(spark, sf_dir).where(predicate).select("seq", "source_label", "actor", "path")


@query
def l1_sqli(spark, sf_dir):
    return _matching(spark, sf_dir, rules.is_sqli(OPTIONS.rules))


@query
def l1_traversal(spark, sf_dir):
    return _matching(spark, sf_dir, rules.is_traversal(OPTIONS.rules))


@query
def l1_scanner(spark, sf_dir):
    return _matching(spark, sf_dir, rules.is_scanner(OPTIONS.rules))


def _findings(spark, sf_dir):
    return rules.findings(_entries(spark, sf_dir), P.SCOPE, OPTIONS.rules)


@query
def l1_bruteforce(spark, sf_dir):
    return _findings(spark, sf_dir).where("rule = 'bruteforce'").select(
        "source_label", "actor", "n", "first_seq", "path", "summary"
    )


@query
def l1_path_fuzz(spark, sf_dir):
    return _findings(spark, sf_dir).where("rule = 'path_fuzz'").select(
        "source_label", "actor", "n", "n_rows", "first_seq", "summary"
    )


@query
def l1_assessments(spark, sf_dir):
    return _findings(spark, sf_dir)


@query
def l1_finding_paths(spark, sf_dir):
    labelled = rules.label_rows(_entries(spark, sf_dir), P.SCOPE, OPTIONS.rules)
    return rules.finding_paths(labelled, P.SCOPE, OPTIONS.rules)


@query
def l1_finding_actors(spark, sf_dir):
    actors = rules.profile(_entries(spark, sf_dir), P.SCOPE, OPTIONS.rules)
    return rules.finding_actors(actors, P.SCOPE, OPTIONS.rules)


def _labelled(spark, sf_dir):
    entries = _landed_entries(spark, sf_dir, "seq", "source_label", "actor", "method", "path",
                              "status", "user_agent", "is_noise")
    return rules.label_rows(entries, P.SCOPE, OPTIONS.rules)


@query
def l1_remaining(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("label").isNull()).select("seq", "actor")


def _custom_rules() -> list[rules.Rule]:
    """The rules of ``derived.CUSTOM_RULES``: twelve judge actors, one judges rows."""
    return [
        rules.Rule(name, kind, lambda p=predicate: F.expr(p), "custom", "medium", "rate_limit", threshold,
                   summary=lambda: F.format_string("%d of %s", F.col("n"), F.col("ip")),
                   indicator=lambda: F.col("path"))
        for name, kind, predicate, threshold in D.CUSTOM_RULES
    ]


@query
def custom_rules(spark, sf_dir):
    """Findings of a registry of thirteen rules of one's own, per source."""
    found = rules.findings(_entries(spark, sf_dir), P.SCOPE, OPTIONS.rules, _custom_rules())
    return found.select("rule", "source_label", "actor", "n", "n_rows", "n_ips", "ip", "path", "first_seq", "summary")


@query
def custom_labels(spark, sf_dir):
    """How many rows each of the thirteen rules took from each actor, and how many are left."""
    entries = _landed_entries(spark, sf_dir, "seq", "source_label", "actor", "method", "path", "status",
                              "response_size", "user_agent", "is_noise")
    labelled = rules.label_rows(entries, P.SCOPE, OPTIONS.rules, _custom_rules())
    return labelled.groupBy("source_label", "actor", F.coalesce("label", F.lit("none")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def assessment_entries(spark, sf_dir):
    by_actor = F.col("label").isin("bruteforce", "path_fuzz")
    return _labelled(spark, sf_dir).where(F.col("label").isNotNull()).select(
        F.col("label").alias("rule"), "source_label",
        F.when(by_actor, F.col("actor")).alias("actor"), "seq",
    )


@query
def brute_force_rolling(spark, sf_dir):
    tries = _signal(spark, sf_dir).where(rules.is_failed_login(OPTIONS.rules))
    return activity.rolling_peaks(tries, ["source_label", "actor"], 3, seconds=2 * 86_400,
                                  chunk=4 * 86_400)


@query
def detect_tumbling(spark, sf_dir):
    tries = _signal(spark, sf_dir).where(rules.is_failed_login(OPTIONS.rules))
    return activity.tumbling(tries, ["source_label", "actor"], 86_400, least=2)


@query
def detect_sliding(spark, sf_dir):
    tries = _signal(spark, sf_dir).where(rules.is_failed_login(OPTIONS.rules))
    return activity.sliding(tries, ["source_label", "actor"], 86_400, 6 * 3600, least=2)


@query
def detect_session(spark, sf_dir):
    return activity.sessions(_signal(spark, sf_dir), ["source_label", "actor"], 6 * 3600, least=2)


# --- batches, context, scoring --------------------------------------------------------


def _batched(spark, sf_dir):
    """Masked entries with their batch; landed first, as the ranking reads them twice."""
    return B.assign_batches(land(_masked(spark, sf_dir), "masked"), OPTIONS.batch)


def _landed_entries(spark, sf_dir, *columns: str) -> DataFrame:
    return land(_entries(spark, sf_dir).select(*columns), "entries")


@query
def batch_assign(spark, sf_dir):
    entries = _landed_entries(spark, sf_dir, "seq", "ts")
    return B.assign_batches(entries, OPTIONS.batch).select("seq", "batch_id", "batch_no")


@query
def batch_source_label(spark, sf_dir):
    return B.batch_texts(_batched(spark, sf_dir)).select(
        "batch_id", "source_label", "n_rows", "first_seq", "last_seq"
    )


@query
def batch_prompts(spark, sf_dir):
    texts = B.batch_texts(_batched(spark, sf_dir)).withColumn("context_text", F.lit(""))
    return texts.select("batch_id", B.fast_prompt().alias("prompt"))


@query
def rolling_context(spark, sf_dir):
    entries = _landed_entries(spark, sf_dir, "seq", "source_label", "status", "is_noise")
    rolled = B.rolling_context(entries, ["source_label"], OPTIONS.batch.context_rows, ("status",))
    return rolled.select(
        "seq",
        F.size("context").alias("n_rows"),
        F.element_at("context", 1)["seq"].alias("first_seq"),
        F.size(F.filter("context", lambda r: r["status"] == 401)).alias("n_failed"),
    )


@query
def batch_context_text(spark, sf_dir):
    entries = _landed_entries(spark, sf_dir, "seq", "ts", "actor", "method", "path", "status",
                              "user_agent", "is_noise")
    batched = land(B.assign_batches(entries, OPTIONS.batch), "batched")
    contexts = B.batch_contexts(batched, OPTIONS.batch)
    return contexts.select("batch_id", B.context_text(F.col("context")).alias("context_text"))


@query
def extract_from_batch(spark, sf_dir):
    texts = B.batch_texts(_batched(spark, sf_dir))
    found = texts.withColumn("f", B.extract_from_batch(F.col("batch_text")))
    return found.select(
        "batch_id", "f.ip", F.array_join("f.ips", " ").alias("ips"), "f.path",
        F.array_join("f.paths", " ").alias("paths"),
    )


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "category", "severity", F.round("confidence", 6).alias("confidence"), "summary",
        "recommended_action", "details_kind", "details.ip",
        F.array_join("details.ips", " ").alias("ips"), "details.path", "analyzed_by",
    )


@query
def responses_parse(spark, sf_dir):
    fast = scoring.assess_fast(D.replies(spark, sf_dir), options=OPTIONS.score)
    return _flat(fast, "batch_id", "parse_error").drop("ip", "ips", "path", "details_kind")


@query
def severity_rank(spark, sf_dir):
    fast = scoring.assess_fast(D.replies(spark, sf_dir))
    rank = V.severity_rank(F.col("severity"))
    return fast.select("batch_id", "severity", rank.alias("rank"),
                       (rank >= 1).alias("at_least_medium"))


@query
def escalation(spark, sf_dir):
    return scoring.assess_fast(D.replies(spark, sf_dir), options=OPTIONS.score).select(
        "batch_id", "category", F.round("confidence", 6).alias("confidence"), "escalate"
    )


@query
def deep_merge(spark, sf_dir):
    fast = scoring.assess_fast(D.replies(spark, sf_dir), options=OPTIONS.score)
    merged = scoring.merge_deep(fast, D.deep_replies(spark, sf_dir))
    return _flat(merged, "batch_id", "escalate")


def _reply_with_line(spark, sf_dir):
    """Every reply next to the (one-line) batch it answers."""
    fast = scoring.assess_fast(D.replies(spark, sf_dir), options=OPTIONS.score)
    merged = scoring.merge_deep(fast, D.deep_replies(spark, sf_dir))
    lines = D.access_lines(spark, sf_dir).select(
        F.col("seq").alias("batch_id"), F.col("raw_line").alias("batch_text"), "source_label"
    )
    return scoring.enrich(merged.join(lines, "batch_id"))


@query
def enrich_actions(spark, sf_dir):
    return _flat(_reply_with_line(spark, sf_dir), "batch_id").drop("details_kind")


@query
def infer_action(spark, sf_dir):
    fast = scoring.assess_fast(D.replies(spark, sf_dir), options=OPTIONS.score)
    merged = scoring.merge_deep(fast, D.deep_replies(spark, sf_dir))
    return merged.select(
        "batch_id", "category", "severity", "recommended_action",
        V.inferred_action(F.col("recommended_action"), F.col("category"),
                          F.col("severity")).alias("effective_action"),
    )


@query
def score_cascade(spark, sf_dir):
    """Batches the rules left open, through the stand-in scorers."""
    judged = P.score_open(
        _masked(spark, sf_dir), scoring.keyword_scorer, scoring.keyword_deep_scorer, OPTIONS
    )
    return judged.select("batch_id", "source_label", "category", "severity",
                         F.round("confidence", 6).alias("confidence"), "escalate",
                         "recommended_action", "analyzed_by")


# --- response -------------------------------------------------------------------------


@query
def alerts(spark, sf_dir):
    found = _findings(spark, sf_dir)
    raised = respond.raise_alerts(found, ("rule", "source_label", "actor"), _created(),
                                  OPTIONS.alerts)
    return raised.select(
        "alert_id", "rule", "source_label", "actor", "category", "severity", "effective_action",
        F.unix_seconds("created_at").alias("created"),
    )


@query
def mitigation_rules(spark, sf_dir):
    """Findings over masked rows; IP tokens are resolved only in the rules."""
    facts, dictionary = P.masked_facts(D.access_lines(spark, sf_dir), OPTIONS)
    return P.respond_to(facts, _created(), OPTIONS, dictionary).rules.drop("alert_id")


@query
def hitl_gate(spark, sf_dir):
    return _response(spark, sf_dir).alerts.select(
        "alert_id", "severity", "n_rules", "critical", "auto_action", "status",
        F.unix_seconds("resolved_at").alias("resolved"),
    )


@query
def expire_pending(spark, sf_dir):
    gated = _response(spark, sf_dir).alerts
    return respond.expire_pending(gated, _as_of(), OPTIONS.response).select(
        "alert_id", "status", F.unix_seconds("resolved_at").alias("resolved")
    )


def _decided(spark, sf_dir):
    response = _response(spark, sf_dir)
    settled = respond.apply_decisions(
        response.alerts, D.decisions(response.alerts),
        F.timestamp_seconds(F.lit(AS_OF + 3600)), OPTIONS.response,
    )
    return response._replace(alerts=settled)


@query
def apply_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).alerts.select(
        "alert_id", "status", F.unix_seconds("resolved_at").alias("resolved")
    )


@query
def ignored_decisions(spark, sf_dir):
    gated = _response(spark, sf_dir).alerts
    return respond.ignored_decisions(gated, D.decisions(gated)).select("alert_id", "decision")


def _ledger(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    return respond.execute_dry(
        decided.alerts, decided.rules, F.timestamp_seconds(F.lit(AS_OF + 7200))
    )


@query
def execution_dry_run(spark, sf_dir):
    return _ledger(spark, sf_dir).drop("executed_at")


@query
def execution_status(spark, sf_dir):
    """Final status of alerts after a runner reported results: every fifth number failed."""
    decided = _decided(spark, sf_dir)
    ledger = land(respond.execute_dry(
        decided.alerts, decided.rules, F.timestamp_seconds(F.lit(AS_OF + 7200))), "ledger")
    results = ledger.where("step is not null").select(
        "alert_id", "step", (F.pmod("step", F.lit(5)) != 0).alias("success"), "output")
    told = respond.report_results(ledger, results)
    return respond.executed_status(decided.alerts, told).select("alert_id", "status")


@query
def rules_report(spark, sf_dir):
    return respond.rules_report(_ledger(spark, sf_dir)).drop("executed_at")


@query
def rollback_plan(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    asked = ledger.select("alert_id").distinct()
    return respond.rollback_plan(ledger, asked, _as_of()).select(
        "alert_id", "step", "rule_type", "command", "output", "manual"
    )


@query
def alert_messages(spark, sf_dir):
    response = _response(spark, sf_dir)
    chat, plain = (
        respond.message_lines(response.alerts, response.rules, channel)
        .withColumn("channel", F.lit(channel))
        for channel in ("chat", "plain")
    )
    return respond.messages(chat.unionByName(plain))


# --- the whole path: all formats, both levels -----------------------------------------------


@query
def pipeline_rejected(spark, sf_dir):
    """Lines of all formats that no entry came out of, per source and reason."""
    sources = registry.load_sources(spark, D.SITES)
    rejected = P.ingest_all(D.all_lines(spark, sf_dir), sources, OPTIONS).rejected
    return rejected.groupBy("source_label", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _both_levels(spark, sf_dir):
    masked = land(P.for_scoring(_masked(spark, sf_dir)), "masked")
    judged = P.score_open(masked, scoring.keyword_scorer, scoring.keyword_deep_scorer, OPTIONS, landed=True)
    return P.respond_to(masked, _created(), OPTIONS, assessments=judged)


@query
def pipeline_alerts(spark, sf_dir):
    """Alerts of the rules and of the scorer, from one table of findings."""
    return _both_levels(spark, sf_dir).alerts.select(
        "rule", "source_label", "category", "severity", "effective_action", "analyzed_by")


@query
def windowed_findings(spark, sf_dir):
    """The cascade per day: batch twin of ``stream_detect`` with other thresholds."""
    options = OPTIONS.overlay({"rules": {"brute_force_threshold": 2, "path_fuzz_threshold": 2}})
    days = P.in_windows(_entries(spark, sf_dir), "1 day")
    actors = rules.profile(days, ("source_label", "window_start"), options.rules)
    registered = rules.default_rules(options.rules)
    hits = F.array_compact(F.array(*[
        F.when(F.col(f"q_{r.name}"), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
            F.col(f"n_{r.name}").alias("n"))) for r in registered]))
    return actors.select(
        F.unix_seconds("window_start").alias("window_start"), "source_label", "actor",
        F.inline(hits))


# --- across sources and over time --------------------------------------------------------


@query
def source_correlation(spark, sf_dir):
    parsed = _routed(spark, sf_dir).where(F.col("reason").isNull())
    rows = parsed.withColumn("actor", F.col("source_ip"))
    return activity.source_correlation(rows, 86_400)


@query
def feedback_metrics(spark, sf_dir):
    settled = activity.feedback_metrics(_decided(spark, sf_dir).alerts)
    return settled.withColumns({
        "false_positive_rate": F.round("false_positive_rate", 6),
        "accuracy": F.round("accuracy", 6),
    })


POLICY = [("rate_limit", "auto"), ("block_ip", "approval"), ("block_path", "approval"),
          ("ufw", "never")]


@query
def autonomy_gate(spark, sf_dir):
    response = _response(spark, sf_dir)
    # rate_limit names both an action and a rule type; the policy treats them alike
    policy = spark.createDataFrame(POLICY, "name string, mode string")
    about = response.alerts.select("alert_id", "severity", "effective_action")
    proposed = response.rules.join(about, "alert_id")
    return activity.autonomy_gate(proposed, policy, F.lit("suggest")).select(
        "alert_id", "rule_ord", "rule_type", "effective_action", "mode"
    )


@query
def mitigation_verdict(spark, sf_dir):
    response = _response(spark, sf_dir)
    acted = response.alerts.where(F.col("actor").isNotNull()).select(
        "alert_id", "actor",
        # halfway through the month, so that there are rows before and after
        F.timestamp_seconds(F.lit(AS_OF - 16 * 86_400) - F.pmod("first_seq", F.lit(600))).alias(
            "executed_at"),
    )
    return activity.mitigation_verdict(_signal(spark, sf_dir), acted, 5 * 86_400)


# --- streams over the same table -----------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        sf_dir)
    return D.access_lines_of(spark, events)


@query
def stream_detect(spark, sf_dir):
    """Windowed findings from the state of a stream run over the table."""
    rows = detect.signal_rows(_event_stream(spark, sf_dir), OPTIONS)
    options = OPTIONS.overlay({"rules": {"brute_force_threshold": 2, "path_fuzz_threshold": 2}})
    stream = detect.path_counts(rows, options, window="1 day", delay="2 days")
    paths = detect.run_once(spark, stream, detect.PATH_KEYS, "detect")
    found = detect.window_findings(detect.window_counts(paths, options), options)
    return found.select(
        F.unix_seconds("window_start").alias("window_start"), "source_label", "actor", "rule",
        "severity", "n",
    )


@query
def stream_tail(spark, sf_dir):
    """Lines written out as files that grow in place, tailed and parsed.

    The tail reads files where all workers mount them, so the shared folder must be such a place.
    """
    folder = fresh_folder(spark, "grown")
    D.access_lines(spark, sf_dir).select("raw_line").write.text(folder)
    tail.register(spark)
    lines = spark.readStream.format("growing_log").option(
        "paths", f"{folder.removeprefix('file://')}/part-*").load()
    table, checkpoint = fresh_folder(spark, "tailed"), fresh_folder(spark, "tailed-state")
    entries = ingest.parse_access(lines).select(
        F.unix_seconds("ts").alias("ts_epoch"), "source_ip", "method", "path", "status")
    detect.write_keyed(entries, table, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(table).drop("batch_no")


@query
def stream_token_epochs(spark, sf_dir):
    stateful.use_rocksdb(spark)
    rows = detect.signal_rows(_event_stream(spark, sf_dir), OPTIONS)
    sightings = rows.select(
        F.col("actor").alias("value"), F.unix_seconds("ts").alias("epoch"), "ts"
    )
    opened = stateful.stream_token_epochs(sightings, OPTIONS.mask.token_ttl)
    return detect.run_once(spark, opened, ["value", "epoch_no"], "epochs")


@query
def context_consume(spark, sf_dir):
    stateful.use_rocksdb(spark)
    rows = detect.signal_rows(_event_stream(spark, sf_dir), OPTIONS)
    tries = rows.select(
        "seq", "source_label", "actor", rules.is_failed_login(OPTIONS.rules).alias("failed")
    )
    found = stateful.context_consume(tries, context_rows=30, threshold=3)
    return detect.run_once(spark, found, ["source_label", "shard", "actor", "last_seq"],
                           "context")


@query
def stream_alerts(spark, sf_dir):
    """Alerts raised and delivered live, in several micro-batches with a restart, one channel failing at first
    and one for good: how often each channel got each alert."""
    stateful.use_rocksdb(spark)
    events, folder = fresh_folder(spark, "events"), fresh_folder(spark, "live")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").write.parquet(events)
    source = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", 2)
    options = OPTIONS.overlay({"rules": {"brute_force_threshold": 2, "path_fuzz_threshold": 2}})
    calls = {"flaky": 0}

    def into(name: str, fails: Callable[[], bool] = lambda: False):
        def send(texts: DataFrame) -> None:
            if fails():
                raise ConnectionError(name)
            texts.write.mode("append").parquet(f"{folder}/got/{name}")

        return live.Channel(send)

    def at_first() -> bool:
        calls["flaky"] += 1
        return calls["flaky"] < 3

    channels = {"chat": into("chat"), "flaky": into("flaky", at_first), "dead": into("dead", lambda: True)}
    for _ in range(2):  # the second run is a restart from what the first one left
        pipeline = live.LiveAlerts(spark, folder, channels, options, lambda: F.col("window.end"), horizon="90 days")
        lines = D.access_lines_of(spark, source.parquet(events))
        pipeline.start(lines, "1 day", "60 days", once=True).awaitTermination()
    pipeline.drain()
    got = spark.read.parquet(*[f"{folder}/got/{name}" for name in ("chat", "flaky")])
    sent = got.groupBy("alert_id", "channel").agg(F.count_if(F.col("part") == 0).alias("n_sent"))
    return pipeline.alerts().join(pipeline.outbox.read().select("alert_id", "channel", "state"), "alert_id").join(
        sent, ["alert_id", "channel"], "left").select(
        F.unix_seconds("window.start").alias("window_start"), "source_label", "rule", "actor", "severity", "status",
        "channel", "state", F.coalesce("n_sent", F.lit(0).cast("bigint")).alias("n_sent"))


@query
def stream_approvals(spark, sf_dir):
    """Status of the alerts a person must judge, from keyed state with timers: as ``apply_decisions``."""
    stateful.use_rocksdb(spark)
    alerts = land(_response(spark, sf_dir).alerts.where("status = 'pending'"), "asked")
    asked = alerts.select("alert_id", F.lit("alert").alias("kind"), F.col("created_at").alias("at"))
    said = D.decisions(alerts).select("alert_id", F.col("decision").alias("kind"), F.col("decided_at").alias("at"))
    # the clock goes on after the last decision: timers fire
    tick = spark.range(1).select(F.lit("").alias("alert_id"), F.lit("tick").alias("kind"),
                                 F.timestamp_seconds(F.lit(AS_OF + 3600)).alias("at"))
    folder = fresh_folder(spark, "events")
    asked.unionByName(said).unionByName(tick).write.parquet(folder)
    events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    states = stateful.stream_approvals(events, OPTIONS.response.timeout_seconds)
    seen = detect.run_once(spark, states, ["alert_id", "status"], "approvals")
    last = seen.groupBy("alert_id").agg(F.max_by("status", F.struct("at_ms", F.col("status") != "pending")).alias("status"))
    return last.select("alert_id", "status")


@query
def stream_rolling(spark, sf_dir):
    """As ``brute_force_rolling``, from a stream fed in four parts whose times overlap, with a restart after each."""
    stateful.use_rocksdb(spark)
    events = D.events(spark, sf_dir)
    day = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(AS_OF - 31 * 86_400)) / 86_400)
    part = F.least(F.lit(3), F.greatest(F.lit(0), F.floor((day + F.pmod("event_id", F.lit(3))) / 8)))
    # the clock goes on after the last try: all seconds are passed on
    tick = events.limit(1).withColumns({
        "ts": F.timestamp_seconds(F.lit(AS_OF + 90 * 86_400)).cast(events.schema["ts"].dataType),
        "event_type": F.lit("error"), "event_id": F.lit(1).cast(events.schema["event_id"].dataType)})
    folder, table, state = (fresh_folder(spark, f"rolling-{name}") for name in ("events", "table", "state"))
    for k in range(4):
        mine = events.where(part == k)
        (mine.unionByName(tick) if k == 3 else mine).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        rows = detect.signal_rows(D.access_lines_of(spark, stream), OPTIONS)
        tries = rows.where(rules.is_failed_login(OPTIONS.rules)).select("ts", "source_label", "actor")
        rolling = stateful.stream_rolling(tries, ["source_label", "actor"], 2 * 86_400, "3 days")
        rolling.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
    seen = spark.read.schema(rolling.schema).parquet(table)
    return seen.where("rolling >= 3").groupBy("source_label", "actor").agg(
        F.min("epoch").alias("reached_at"), F.max("rolling").alias("peak"))


# --- epochs of tokens, and contexts of what no rule took ---------------------------------------


@query
def epoch_tokens(spark, sf_dir):
    """Every masked value of every line with the token of its epoch: a fresh one after the time to live."""
    masked = _masked(spark, sf_dir)
    return epochs.epoch_occurrences(masked, OPTIONS.mask).select(
        "seq", "prefix", "original", "epoch_no", "epoch_start", "token")


@query
def token_state_purge(spark, sf_dir):
    """Each value's last epoch, and whether the stream has dropped its state at the end of the table."""
    stateful.use_rocksdb(spark)
    rows = detect.signal_rows(_event_stream(spark, sf_dir), OPTIONS)
    sightings = rows.select(F.col("actor").alias("value"), F.unix_seconds("ts").alias("epoch"), "ts")
    seen = detect.run_once(
        spark, stateful.stream_living_epochs(sightings, 86_400, "1 hour"), ["value", "epoch_start", "event"], "purge")
    last = seen.groupBy("value").agg(F.max("epoch_start").alias("epoch_start"))
    gone = seen.where("event = 'purged'").select("value", "epoch_start", F.lit(True).alias("purged"))
    return last.join(gone, ["value", "epoch_start"], "left").fillna(False, ["purged"])


def _unexplained(spark, sf_dir) -> DataFrame:
    options = OPTIONS.overlay({"batch": {"consume": True}})
    return P.open_batches(_entries(spark, sf_dir), options, "raw_line")


@query
def scored_context(spark, sf_dir):
    """Open batches with contexts of rows that no rule took: the whole prompt, and what a scorer that reads the context says."""
    texts = land(_unexplained(spark, sf_dir), "texts")
    judged = scoring.cascade(texts, scoring.context_scorer, None, OPTIONS.score)
    prompts = texts.select("batch_id", B.fast_prompt().alias("prompt"))
    return judged.select("batch_id", "category", "severity", "escalate").join(prompts, "batch_id")


@query
def deep_prompts(spark, sf_dir):
    """What the deeper scorer is asked about the batches that the first one doubts."""
    texts = _unexplained(spark, sf_dir)
    prompts = texts.withColumn("prompt", B.fast_prompt())
    judged = scoring.assess_fast(
        scoring.score(prompts, scoring.context_scorer, "prompt", "reply"), options=OPTIONS.score)
    return judged.where("escalate").select("batch_id", B.deep_prompt("category", "confidence").alias("prompt"))


@query
def cached_replies(spark, sf_dir):
    """A scorer's reply for every line, asked once per distinct request, and not again in a second run."""
    folder = fresh_folder(spark, "replies")
    lines = _entries(spark, sf_dir).select(
        "seq", F.format_string('Lines:\n%s %s" %d ', "method", "path", "status").alias("prompt"))
    first = scoring.score_once(lines, scoring.keyword_scorer, "prompt", "reply", scoring.reply_cache(spark, folder), 4)
    first.select("seq", "reply").write.format("noop").mode("overwrite").save()

    def no_one(prompts: list[str]) -> list[str]:
        raise RuntimeError("the cache knows all prompts")

    again = scoring.score_once(lines, no_one, "prompt", "reply", scoring.reply_cache(spark, folder))
    return again.select("seq", "reply")


@query
def stream_correlation(spark, sf_dir):
    """Coordinated actors of closed windows, from web and auth streams joined by window."""
    parsed = _routed(spark, sf_dir).where(F.col("reason").isNull())
    rows = parsed.select("ts", F.col("source_ip").alias("actor"), "format", "status", "method")
    # the clock goes on after the last line, on both sides: all other windows close
    tick = spark.range(1).select(
        F.timestamp_seconds(F.lit(AS_OF + 90 * 86_400)).alias("ts"), F.lit("tick").alias("actor"),
        F.explode(F.array(F.lit("nginx"), F.lit("syslog"))).alias("format"), F.lit(404).alias("status"),
        F.lit("FAILED").alias("method"))
    folder, table = fresh_folder(spark, "rows"), fresh_folder(spark, "together")
    rows.unionByName(tick).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    found = correlate.stream_correlation(stream, 86_400, "1 day")
    found.writeStream.format("parquet").option("path", table).option(
        "checkpointLocation", fresh_folder(spark, "together-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(table)


# --- all formats to rules and status ------------------------------------------------------------


def _all_formats(spark, sf_dir) -> P.Response:
    """Lines of all sources through both levels; the scorer sees every signal line by itself and names what to block."""
    options = Options(ingest=OPTIONS.ingest, response=OPTIONS.response)
    sources = registry.load_sources(spark, D.SITES)
    entries = P.ingest_all(D.all_lines(spark, sf_dir), sources, options).entries
    texts = entries.where(~F.col("is_noise")).select(
        F.concat_ws("-", "source_label", "seq").alias("batch_id"), F.col("raw_line").alias("batch_text"),
        "source_label", F.lit("").alias("context_text"), F.lit(1).alias("n_rows"), F.col("seq").alias("first_seq"))
    judged = land(scoring.cascade(texts, scoring.naming_scorer, None, options.score), "judged")
    return P.respond_to(entries, _created(), options, assessments=judged)


@query
def pipeline_rules(spark, sf_dir):
    """Proposed rules of all formats and both levels: addresses, several paths, given zones and rates."""
    response = _all_formats(spark, sf_dir)
    about = response.alerts.select("alert_id", F.col("rule").alias("alert_rule"), "source_label")
    return response.rules.join(about, "alert_id").drop("alert_id")


@query
def pipeline_status(spark, sf_dir):
    """Where the alerts of all formats and both levels stand after the gate, and after an hour without decisions."""
    gated = _all_formats(spark, sf_dir).alerts
    later = respond.expire_pending(gated, F.timestamp_seconds(F.lit(AS_OF + 3600)), OPTIONS.response)
    return later.select("alert_id", "rule", "source_label", "severity", "effective_action", "n_rules", "critical", "status")
