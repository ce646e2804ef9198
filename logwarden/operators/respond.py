"""Findings -> alerts, proposed rules, approval status and ledgers.

Nothing here runs a command: rules are proposed, and executions are recorded as
dry runs. The rules of one alert are not bounded (a finding may name every
address of an attack), so rules, results and message lines are rows keyed by
``alert_id`` and ordered by a number, never arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions import verdict as V
from ..options import AlertOptions, ResponseOptions
from ..schemas import LEDGER
from .ordering import running_rank

# Fixed texts of the rules: type, command, description, critical, rollback.
DENY_IP = ("nginx_deny", "deny %s;", "Deny IP %s in Nginx", True, "# remove: deny %s;")
FIREWALL_IP = ("ufw", "%s deny from %s", "Block IP %s via UFW firewall", True,
               "%s delete deny from %s")
DENY_PATH = ("nginx_deny", "location %s { deny all; }", "Deny all access to path %s", True,
             "# remove: location %s { deny all; }")
RATE_ZONE = ("rate_limit", "limit_req_zone $binary_remote_addr zone=%s:10m rate=%s;",
             "Rate limit zone '%s' at %s", False, "# remove: limit_req_zone ... zone=%s:10m ...")
RATE_APPLY = ("rate_limit", "limit_req zone=%s;", "Apply rate limit zone '%s' to %s", False,
              "# remove: limit_req zone=%s; from %s")
DEFAULT_ZONE = "threat_limit"
DEFAULT_RATE = "10r/m"
DRY_RUN = "[DRY RUN] %s"
HEAD, BODY, FOOT = 0, 1, 2  # sections of a message

RULE_COLUMNS = ("rule_type", "command", "description", "critical", "rollback_command")


# --- alerts -------------------------------------------------------------------


def alert_id(*parts: str) -> Column:
    """The same finding always gets the same id, so sinks can be idempotent."""
    cells = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def alertable(assessments: DataFrame, options: AlertOptions = AlertOptions()) -> DataFrame:
    least = fixed.SEVERITIES.index(options.min_severity)
    if not options.enabled:
        return assessments.where(F.lit(False))
    return assessments.where(
        (F.col("category") != "normal") & (V.severity_rank(F.col("severity")) >= least)
    )


def raise_alerts(
    findings: DataFrame,
    key: tuple[str, ...],
    created_at: Column,
    options: AlertOptions = AlertOptions(),
) -> DataFrame:
    """One alert per alertable finding; ``key`` names the columns of its identity."""
    return alertable(findings, options).withColumns({
        "alert_id": alert_id(*key),
        "created_at": created_at,
        "effective_action": V.inferred_action(
            F.col("recommended_action"), F.col("category"), F.col("severity")
        ),
    })


# --- rules --------------------------------------------------------------------


def _rule(
    spec: tuple, site: Column, run: list[Column], tell: list[Column], undo: list[Column]
) -> Column:
    """Rule struct of ``spec`` with the arguments of its three texts."""
    kind, command, description, critical, rollback = spec
    return F.struct(
        F.lit(kind).alias("rule_type"),
        F.format_string(command, *run).alias("command"),
        F.concat(F.format_string(description, *tell), site).alias("description"),
        F.lit(critical).alias("critical"),
        F.format_string(rollback, *undo).alias("rollback_command"),
    )


def _site(label: str = "source_label") -> Column:
    column = F.col(label)
    named = F.concat(F.lit(" (detected on "), column, F.lit(")"))
    return F.when(F.coalesce(column, F.lit("")) != "", named).otherwise("")


def ip_rules(targets: DataFrame, options: ResponseOptions = ResponseOptions()) -> DataFrame:
    """``targets``: alert_id, source_label, ip, ord -> two rules per address."""
    ip, site = F.col("ip"), _site()
    tool = F.lit(options.ufw_command)
    pair = F.array(
        _rule(DENY_IP, site, [ip], [ip], [ip]),
        _rule(FIREWALL_IP, site, [tool, ip], [ip], [tool, ip]),
    )
    return targets.select("alert_id", "ord", F.posexplode(pair).alias("k", "r")).select(
        "alert_id", (F.col("ord") * 2 + F.col("k")).alias("rule_ord"), "r.*"
    )


def path_rules(targets: DataFrame) -> DataFrame:
    """``targets``: alert_id, source_label, path, ord -> one rule per path."""
    path = F.col("path")
    return targets.withColumn("r", _rule(DENY_PATH, _site(), [path], [path], [path])).select(
        "alert_id", (F.col("ord") * 2).alias("rule_ord"), "r.*"
    )


def rate_rules(alerts: DataFrame) -> DataFrame:
    """``alerts``: alert_id, source_label, path, zone_name, rate -> zone, and apply if a path."""
    def given(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    zone, rate = given("zone_name", DEFAULT_ZONE), given("rate", DEFAULT_RATE)
    path, site = F.col("path"), _site()
    first = _rule(RATE_ZONE, site, [zone, rate], [zone, rate], [zone])
    second = _rule(RATE_APPLY, site, [zone], [zone, path], [zone, path])
    both = F.array_compact(
        F.array(first, F.when(F.coalesce(path, F.lit("")) != "", second))
    )
    return alerts.select("alert_id", F.posexplode(both).alias("k", "r")).select(
        "alert_id", F.col("k").cast("bigint").alias("rule_ord"), "r.*"
    )


def resolve_ips(targets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """IP tokens back to addresses; unknown tokens and plain addresses stay.

    ``dictionary``: token, original. Not every target is a token.
    """
    names = dictionary.select(F.col("token").alias("ip"), "original")
    return targets.join(names, "ip", "left").withColumn(
        "ip", F.coalesce("original", "ip")
    ).drop("original")


def mitigation_rules(
    alerts: DataFrame,
    targets: DataFrame,
    options: ResponseOptions = ResponseOptions(),
    dictionary: DataFrame | None = None,
    path_targets: DataFrame | None = None,
) -> DataFrame:
    """Proposed rules of all alerts: alert_id, rule_ord and the rule.

    ``alerts``: alert_id, effective_action, source_label, path[, zone_name, rate].
    ``targets``: alert_id, ip, ord (order of first sight). ``path_targets``:
    alert_id, path, ord; without it an alert's own path is its only one.
    """
    for name in ("zone_name", "rate"):
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast("string"))
    if not options.enabled:
        alerts = alerts.where(F.lit(False))
    acts = F.col("effective_action")
    # the target rows know their alert; AQE splits or broadcasts this join by size
    blocked = alerts.where(acts == "block_ip").select("alert_id", "source_label")
    ips = targets.select("alert_id", "ip", "ord").join(blocked, "alert_id")
    if dictionary is not None:
        ips = resolve_ips(ips, dictionary)
    closed = alerts.where(acts == "block_path")
    if path_targets is None:
        paths = closed.where(F.coalesce("path", F.lit("")) != "").select(
            "alert_id", "source_label", "path", F.lit(0).cast("bigint").alias("ord"))
    else:
        paths = path_targets.select("alert_id", "path", "ord").join(
            closed.select("alert_id", "source_label"), "alert_id")
    return (
        ip_rules(ips, options)
        .unionByName(path_rules(paths))
        .unionByName(rate_rules(alerts.where(acts == "rate_limit")))
    )


# --- approval -----------------------------------------------------------------


def gate(
    alerts: DataFrame,
    rules: DataFrame,
    submitted_at: Column,
    options: ResponseOptions = ResponseOptions(),
) -> DataFrame:
    """Add n_rules, critical, status, auto_action, resolved_at."""
    drastic = F.col("rule_type").isin(*fixed.CRITICAL_RULE_TYPES)
    per_alert = rules.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("n_rules"), F.bool_or(drastic).alias("_drastic")
    )
    joined = alerts.join(per_alert, "alert_id", "left").withColumn(
        "n_rules", F.coalesce("n_rules", F.lit(0).cast("bigint"))
    )
    critical = F.col("severity").isin(*fixed.CRITICAL_SEVERITIES) | F.coalesce(
        "_drastic", F.lit(False)
    )
    auto = F.col("severity").isin(*options.auto_approve_severity) if (
        options.auto_approve_severity) else F.lit(False)
    return (
        joined.withColumn("critical", critical)
        .withColumn("auto_action", auto & ~F.col("critical"))
        .withColumn("status", F.when(F.col("auto_action"), "approved").otherwise("pending"))
        .withColumn("resolved_at", F.when(F.col("auto_action"), submitted_at))
        .drop("_drastic")
    )


def expire_pending(
    alerts: DataFrame, as_of: Column, options: ResponseOptions = ResponseOptions()
) -> DataFrame:
    """Pending alerts older than the timeout become expired."""
    age = F.unix_seconds(as_of) - F.unix_seconds("created_at")
    late = (F.col("status") == "pending") & (age > options.timeout_seconds)
    return alerts.withColumns({
        "status": F.when(late, "expired").otherwise(F.col("status")),
        "resolved_at": F.when(late, as_of).otherwise(F.col("resolved_at")),
    })


def apply_decisions(
    alerts: DataFrame,
    decisions: DataFrame,
    as_of: Column,
    options: ResponseOptions = ResponseOptions(),
) -> DataFrame:
    """Status after human decisions: the first one in time settles a pending alert.

    ``decisions``: alert_id, decision (approve or reject), decided_at. A decision
    past the timeout finds the alert expired and changes nothing.
    """
    first = decisions.where(F.col("decided_at") <= as_of).groupBy("alert_id").agg(
        F.min(F.struct("decided_at", "decision")).alias("_d")
    )
    joined = alerts.join(first, "alert_id", "left")
    took = F.unix_seconds("_d.decided_at") - F.unix_seconds("created_at")
    counts = (F.col("status") == "pending") & (took <= options.timeout_seconds)
    settled = joined.withColumns({
        "resolved_at": F.when(counts, F.col("_d.decided_at")).otherwise(F.col("resolved_at")),
        "status": F.when(
            counts, F.when(F.col("_d.decision") == "approve", "approved").otherwise("rejected")
        ).otherwise(F.col("status")),
    }).drop("_d")
    return expire_pending(settled, as_of, options)


def ignored_decisions(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions about alerts that do not exist."""
    return decisions.join(alerts.select("alert_id"), "alert_id", "left_anti")


# --- ledgers ------------------------------------------------------------------


def execute_dry(
    alerts: DataFrame,
    rules: DataFrame,
    executed_at: Column,
    options: ResponseOptions = ResponseOptions(),
) -> DataFrame:
    """Dry-run ledger of all alerts (from ``gate``), one row per command.

    An alert that is not approved gets a failed record without commands, an
    approved one without rules a successful record without commands. Live runs are
    not built: ``dry_run=False`` is an error, not a silent dry run.
    """
    if not options.dry_run:
        raise ValueError("commands are proposed and recorded here, never run")
    approved = F.col("status") == "approved"
    head = alerts.select(
        "alert_id",
        F.lit("execute").alias("kind"),
        approved.alias("record_success"),
        F.lit(True).alias("dry_run"),
        executed_at.alias("executed_at"),
        "n_rules",
    )
    results = rules.select(
        "alert_id",
        F.col("rule_ord").alias("step"),
        "rule_type",
        "command",
        F.lit(True).alias("success"),
        F.format_string(DRY_RUN, "command").alias("output"),
        "rollback_command",
    )
    commands = results.join(head.where("record_success"), "alert_id")
    bare = head.where(~F.col("record_success") | (F.col("n_rules") == 0))
    ledger = commands.unionByName(bare, allowMissingColumns=True)
    return ledger.select(*LEDGER.names)


def report_results(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger with what a runner reported: ``results`` has alert_id, step, success, output.

    A record succeeds if all of its commands did; commands without a result keep theirs.
    """
    said = results.select(
        "alert_id", "step", F.col("success").alias("_ok"), F.col("output").alias("_out"))
    told = ledger.join(said, ["alert_id", "step"], "left").withColumns({
        "success": F.coalesce("_ok", "success"), "output": F.coalesce("_out", "output"),
    }).drop("_ok", "_out")
    whole = told.groupBy("alert_id", "executed_at").agg(
        F.bool_and(F.coalesce("success", F.lit(True))).alias("_all"))
    return told.join(whole, ["alert_id", "executed_at"]).withColumn(
        "record_success", F.col("record_success") & F.col("_all")).select(*LEDGER.names)


def executed_status(alerts: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Approved alerts are executed, or failed if a record of theirs on the ledger failed."""
    approved = F.col("status") == "approved"
    if ledger is None:
        return alerts.withColumn("status", F.when(approved, "executed").otherwise(F.col("status")))
    runs = ledger.where(F.col("kind") == "execute").groupBy("alert_id").agg(
        F.bool_and("record_success").alias("_all"))
    after = F.when(F.col("_all"), "executed").when(~F.col("_all"), "failed")
    return alerts.join(runs, "alert_id", "left").withColumn(
        "status", F.when(approved, F.coalesce(after, "status")).otherwise(F.col("status"))
    ).drop("_all")


def rollback_plan(ledger: DataFrame, requests: DataFrame, executed_at: Column) -> DataFrame:
    """Dry-run rollback of each requested alert's latest execution, last command first.

    ``manual`` marks undo texts that are notes to a person, not commands.
    """
    runs = ledger.where(F.col("kind") == "execute")
    asked = requests.select("alert_id").distinct()
    latest = (
        runs.join(asked, "alert_id", "left_semi")
        .groupBy("alert_id")
        .agg(F.max("executed_at").alias("executed_at"))
    )
    steps = runs.join(latest, ["alert_id", "executed_at"])
    wanted = steps.where(F.coalesce("rollback_command", F.lit("")) != "")
    return wanted.select(
        "alert_id",
        F.lit("rollback").alias("kind"),
        F.lit(True).alias("record_success"),
        F.lit(True).alias("dry_run"),
        executed_at.alias("executed_at"),
        (-F.col("step")).alias("step"),
        "rule_type",
        F.col("rollback_command").alias("command"),
        F.lit(True).alias("success"),
        F.format_string(DRY_RUN, "rollback_command").alias("output"),
        F.lit("").alias("rollback_command"),
        F.col("rollback_command").startswith("#").alias("manual"),
    )


def unknown_rollbacks(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    runs = ledger.where(F.col("kind") == "execute").select("alert_id")
    return requests.join(runs, "alert_id", "left_anti")


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    ledger.write.mode("append").json(path)


def read_ledger(spark, path: str) -> DataFrame:
    """Ledger records; lines that are no JSON are skipped."""
    rows = spark.read.schema(LEDGER).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("alert_id").isNotNull())


def rules_report(ledger: DataFrame) -> DataFrame:
    """Text report: a head line per record and a line per command.

    Columns: alert_id, executed_at, line_ord, line; sort by them to print.
    """
    icon = lambda flag: F.when(F.coalesce(flag, F.lit(False)), "✓").otherwise("✗")
    mode = F.when(F.col("dry_run"), "DRY-RUN").otherwise("LIVE")
    when = F.date_format("executed_at", "yyyy-MM-dd'T'HH:mm:ss")
    heads = ledger.groupBy("alert_id", "kind", "executed_at", "dry_run").agg(
        F.bool_and("record_success").alias("record_success")
    ).select(
        "alert_id", "executed_at",
        F.lit(None).cast("bigint").alias("line_ord"),
        F.concat(icon(F.col("record_success")), F.lit(" Alert "),
                 F.left("alert_id", F.lit(8)), F.lit("... ["), mode, F.lit("] at "),
                 when).alias("line"),
    )
    steps = ledger.where(F.col("step").isNotNull()).select(
        "alert_id", "executed_at", F.col("step").alias("line_ord"),
        F.concat(F.lit("  "), icon(F.col("success")), F.lit(" ["), "rule_type", F.lit("] "),
                 "command").alias("line"),
    )
    return heads.unionByName(steps)


# --- messages -----------------------------------------------------------------


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, fixed.MARKDOWN_SPECIAL, r"\\$1")


def _stamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("N/A"))


def chat_head() -> Column:
    """Lines of the chat message before its rules."""
    bold = lambda name, value: F.concat(F.lit(f"*{name}:* "), escape_markdown(value))
    icon = F.lit("\U0001f6a8 *THREAT DETECTED*")
    label = F.coalesce("source_label", F.lit(""))
    summary = F.coalesce("summary", F.lit(""))
    items = F.transform(
        "indicators", lambda i: F.concat(F.lit("• "), escape_markdown(i))
    )
    top = F.array_compact(F.array(
        icon,
        F.lit(""),
        F.when(label != "", bold("Site", label)),
        bold("Category", V.labelled(F.col("category"), fixed.CATEGORY_LABELS)),
        bold("Severity", F.upper("severity")),
        bold("Confidence", F.format_string("%.2f", "confidence")),
        bold("Time", _stamp(F.col("created_at"))),
        F.when(summary != "", F.lit("")),
        F.when(summary != "", bold("Summary", summary)),
    ))
    return _with_tail(top, "*Indicators:*", items, "*Mitigation suggestion:*")


def plain_head() -> Column:
    """Lines of the plain message before its rules."""
    pair = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    icon = V.labelled(F.col("severity"), fixed.SEVERITY_ICONS)
    label = F.coalesce("source_label", F.lit(""))
    summary = F.coalesce("summary", F.lit(""))
    items = F.transform("indicators", lambda i: F.concat(F.lit("  • "), i))
    top = F.array_compact(F.array(
        F.concat(icon, F.lit("  THREAT DETECTED")),
        F.when(label != "", pair("Site", label)),
        pair("Category", V.labelled(F.col("category"), fixed.CATEGORY_LABELS)),
        pair("Severity", F.concat(icon, F.lit(" "), F.upper("severity"))),
        pair("Confidence", F.format_string("%.2f", "confidence")),
        pair("Source", F.coalesce(F.nullif("ip", F.lit("")), F.lit("N/A"))),
        pair("Time", _stamp(F.col("created_at"))),
        F.when(summary != "", F.lit("")),
        F.when(summary != "", F.lit("Summary:")),
        F.when(summary != "", F.concat(F.lit("  "), summary)),
    ))
    return _with_tail(top, "Indicators:", items, "Suggested Mitigation:")


def _with_tail(top: Column, title: str, items: Column, rules_title: str) -> Column:
    none = F.expr("cast(array() as array<string>)")
    middle = F.when(
        F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(title)), items)
    ).otherwise(none)
    tail = F.when(
        F.col("n_rules") > 0, F.array(F.lit(""), F.lit(rules_title))
    ).otherwise(none)
    return F.concat(top, middle, tail)


def status_line() -> Column:
    label = V.labelled(F.col("status"), fixed.STATUS_LABELS)
    return F.concat(F.lit("Status: "), F.upper("status"), F.lit(" ("), label, F.lit(")"))


def message_lines(alerts: DataFrame, rules: DataFrame, channel: str) -> DataFrame:
    """Message of each alert as rows (alert_id, section, line_ord, line).

    ``channel`` is chat or plain. ``alerts`` need n_rules, status and
    ``indicators ARRAY<STRING>``. Lines are ordered by section (head, rules, foot),
    then by number within it.
    """
    head = (chat_head if channel == "chat" else plain_head)()
    tops = alerts.select("alert_id", F.posexplode(head).alias("k", "line")).select(
        "alert_id", F.lit(HEAD).alias("section"), F.col("k").cast("bigint").alias("line_ord"), "line"
    )
    command = (
        F.concat(F.lit("`"), escape_markdown(F.col("command")), F.lit("`"))
        if channel == "chat" else F.concat(F.lit("  "), F.col("command"))
    )
    # rules of alerts that are not sent are left out
    bodies = rules.select(
        "alert_id", F.lit(BODY).alias("section"), F.col("rule_ord").alias("line_ord"), command.alias("line")
    ).join(alerts.select("alert_id"), "alert_id", "left_semi")
    out = tops.unionByName(bodies)
    if channel == "chat":
        return out
    ends = alerts.select(
        "alert_id", F.posexplode(F.array(F.lit(""), status_line())).alias("k", "line")
    ).select("alert_id", F.lit(FOOT).alias("section"), F.col("k").cast("bigint").alias("line_ord"), "line")
    return out.unionByName(ends)


def messages(lines: DataFrame, max_lines: int = 100) -> DataFrame:
    """Join message lines into texts of at most ``max_lines`` lines each.

    Nothing is cut: an alert with more lines gets several numbered parts. Columns
    other than section, line_ord and line (alert_id, and a channel if there is one)
    tell the messages apart.
    """
    keys = [c for c in lines.columns if c not in ("section", "line_ord", "line")]
    placed = running_rank(lines, "section", keys, ties=["line_ord"], name="_place")
    part = F.call_function("div", F.col("_place") - 1, F.lit(max_lines))
    return (
        placed.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "line"))).alias("_l"))
        .select(
            *keys, "part",
            F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("message"),
        )
    )


def dispatch(
    batch: DataFrame,
    channels: dict[str, Callable[[DataFrame], None]],
    options: AlertOptions | None = None,
) -> dict[str, str]:
    """Hand a batch of messages to every channel; one failure does not stop the others.

    With ``options``, to the channels they name; one that is named but not there has failed.
    Returns channel -> error text for the channels that failed.
    """
    failed = {}
    if options is not None:
        failed = {n: "no such channel" for n in options.channels if n not in channels}
        channels = {n: channels[n] for n in options.channels if n in channels}
    for name, send in channels.items():
        try:
            send(batch)
        except Exception as error:  # a channel may fail in any way
            failed[name] = str(error)
    return failed
