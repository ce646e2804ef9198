from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from logwarden.functions import fixed
from logwarden.functions import verdict as V
from logwarden.operators import respond
from logwarden.options import AlertOptions, ResponseOptions

NOW = datetime.datetime(2024, 1, 1, 12, 0, 0)
ALERT = ("alert_id string, effective_action string, source_label string, path string, "
         "zone_name string, rate string, category string, severity string, confidence double, "
         "summary string, indicators array<string>, ip string, created_at timestamp")


def alert(id="a", action="block_ip", severity="low", **more):
    row = dict(alert_id=id, effective_action=action, source_label="", path=None, zone_name=None,
               rate=None, category="scan", severity=severity, confidence=0.5, summary="sum",
               indicators=["i_1"], ip="1.2.3.4", created_at=NOW)
    row.update(more)
    return tuple(row.values())


def alerts_of(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT)


def targets_of(spark, *rows):
    return spark.createDataFrame(list(rows), "alert_id string, ip string, ord bigint")


def test_block_ip_rules(spark):
    rules = respond.mitigation_rules(
        alerts_of(spark, alert(source_label="shop")),
        targets_of(spark, ("a", "1.2.3.4", 7), ("a", "5.6.7.8", 9)),
    ).orderBy("rule_ord").collect()
    assert [(r.rule_type, r.command) for r in rules] == [
        ("nginx_deny", "deny 1.2.3.4;"), ("ufw", "sudo ufw deny from 1.2.3.4"),
        ("nginx_deny", "deny 5.6.7.8;"), ("ufw", "sudo ufw deny from 5.6.7.8")]
    assert rules[1].description == "Block IP 1.2.3.4 via UFW firewall (detected on shop)"
    assert rules[1].rollback_command == "sudo ufw delete deny from 1.2.3.4" and rules[0].critical


def test_path_and_rate_rules(spark):
    rules = respond.mitigation_rules(
        alerts_of(spark, alert("p", "block_path", path="/x"), alert("q", "block_path"),
                  alert("r", "rate_limit", path="/y", zone_name="z", rate="5r/s"),
                  alert("s", "rate_limit"), alert("t", "alert_only")),
        targets_of(spark),
    ).orderBy("alert_id", "rule_ord").collect()
    assert [(r.alert_id, r.command) for r in rules] == [
        ("p", "location /x { deny all; }"),
        ("r", "limit_req_zone $binary_remote_addr zone=z:10m rate=5r/s;"),
        ("r", "limit_req zone=z;"),
        ("s", "limit_req_zone $binary_remote_addr zone=threat_limit:10m rate=10r/m;")]
    assert not rules[1].critical
    assert rules[2].description == "Apply rate limit zone 'z' to /y"


def test_several_paths(spark):
    paths = spark.createDataFrame([("p", "/a", 1), ("p", "/b", 2)], "alert_id string, path string, ord bigint")
    rules = respond.mitigation_rules(alerts_of(spark, alert("p", "block_path")), targets_of(spark),
                                     path_targets=paths).orderBy("rule_ord").collect()
    assert [r.command for r in rules] == ["location /a { deny all; }", "location /b { deny all; }"]


def test_tokens_are_resolved(spark):
    dictionary = spark.createDataFrame([("[IP_001]", "9.8.7.6")], "token string, original string")
    rules = respond.mitigation_rules(
        alerts_of(spark, alert()), targets_of(spark, ("a", "[IP_001]", 1), ("a", "[IP_999]", 2)),
        dictionary=dictionary).where("rule_type = 'nginx_deny'").orderBy("rule_ord").collect()
    assert [r.command for r in rules] == ["deny 9.8.7.6;", "deny [IP_999];"]


def test_inferred_actions(spark):
    cases = [("alert_only", "bruteforce", "high", "block_ip"), ("investigate", "scan", "critical", "rate_limit"),
             ("alert_only", "malicious", "medium", "alert_only"), ("alert_only", "normal", "high", "alert_only"),
             ("investigate", "suspicious", "high", "rate_limit"), ("block_path", "scan", "low", "block_path")]
    df = spark.createDataFrame(cases, "a string, c string, s string, want string")
    got = df.select(V.inferred_action(F.col("a"), F.col("c"), F.col("s")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_alertable(spark):
    df = spark.createDataFrame([("scan", s) for s in fixed.SEVERITIES] + [("normal", "high")],
                               "category string, severity string")
    assert [r.severity for r in respond.alertable(df).collect()] == ["medium", "high", "critical"]
    assert respond.alertable(df, AlertOptions(min_severity="critical")).count() == 1
    assert respond.alertable(df, AlertOptions(enabled=False)).count() == 0


def gated(spark, rows, rules=(), **options):
    table = spark.createDataFrame(
        list(rules), "alert_id string, rule_ord bigint, rule_type string, command string, "
                     "rollback_command string")
    return respond.gate(alerts_of(spark, *rows), table, F.lit(NOW).cast("timestamp"),
                        ResponseOptions(**options)), table


def test_gate(spark):
    rules = [("b", 0, "ufw", "c", "u"), ("d", 0, "rate_limit", "c", "u")]
    rows = [alert("a"), alert("b"), alert("c", severity="high"), alert("d"), alert("e", severity="medium")]
    out, _ = gated(spark, rows, rules, auto_approve_severity=("low", "high"))
    got = {r.alert_id: (r.status, r.auto_action, r.critical, r.n_rules) for r in out.collect()}
    assert got == {"a": ("approved", True, False, 0), "b": ("pending", False, True, 1),
                   "c": ("pending", False, True, 0), "d": ("approved", True, False, 1),
                   "e": ("pending", False, False, 0)}
    out, _ = gated(spark, rows, rules)
    assert {r.status for r in out.collect()} == {"pending"}


def at(seconds):
    return NOW + datetime.timedelta(seconds=seconds)


def test_decisions(spark):
    out, _ = gated(spark, [alert(i) for i in "abcdef"])
    decisions = spark.createDataFrame(
        [("a", "approve", at(10)), ("a", "reject", at(20)), ("b", "reject", at(300)),
         ("c", "approve", at(301)), ("e", "approve", at(900)), ("x", "approve", at(1))],
        "alert_id string, decision string, decided_at timestamp")
    as_of = F.lit(at(301)).cast("timestamp")
    rows = respond.apply_decisions(out, decisions, as_of).collect()
    assert {r.alert_id: r.status for r in rows} == {
        "a": "approved", "b": "rejected", "c": "expired", "d": "expired", "e": "expired",
        "f": "expired"}
    early = respond.apply_decisions(out, decisions, F.lit(at(5)).cast("timestamp")).collect()
    assert {r.status for r in early} == {"pending"}
    assert [r.alert_id for r in respond.ignored_decisions(out, decisions).collect()] == ["x"]


def test_dry_run_ledger_and_rollback(spark, tmp_path):
    rules = [("a", 2, "ufw", "c2", "u2"), ("a", 1, "nginx_deny", "c1", "# remove: c1"),
             ("a", 3, "x", "c3", ""), ("b", 1, "ufw", "c", "u")]
    out, table = gated(spark, [alert("a"), alert("b"), alert("c")], rules)
    settled = out.withColumn("status", F.expr("IF(alert_id = 'b', 'pending', 'approved')"))
    ledger = respond.execute_dry(settled, table, F.lit(NOW).cast("timestamp"))
    path = str(tmp_path / "ledger")
    respond.write_ledger(ledger, path)
    (tmp_path / "ledger" / "bad.json").write_text("{not json\n")
    back = respond.read_ledger(spark, path)
    rows = back.orderBy("alert_id", "step").collect()
    assert [(r.alert_id, r.step, r.record_success, r.output) for r in rows] == [
        ("a", 1, True, "[DRY RUN] c1"), ("a", 2, True, "[DRY RUN] c2"),
        ("a", 3, True, "[DRY RUN] c3"), ("b", None, False, None), ("c", None, True, None)]
    later = back.withColumn("executed_at", F.lit(at(60)).cast("timestamp")).where("step = 1")
    asked = spark.createDataFrame([("a",), ("zz",)], "alert_id string")
    plan = respond.rollback_plan(back, asked, F.lit(at(99)).cast("timestamp"))
    assert [(r.command, r.manual) for r in plan.orderBy("step").collect()] == [
        ("u2", False), ("# remove: c1", True)]
    newest = respond.rollback_plan(back.unionByName(later), asked, F.lit(at(99)).cast("timestamp"))
    assert [r.command for r in newest.collect()] == ["# remove: c1"]
    assert [r.alert_id for r in respond.unknown_rollbacks(back, asked).collect()] == ["zz"]
    # a rollback on the ledger is no execution to roll back
    again = respond.rollback_plan(
        back.unionByName(plan.drop("manual")), asked, F.lit(at(99)).cast("timestamp"))
    assert again.count() == 2
    report = [r.line for r in respond.rules_report(back).orderBy(
        "alert_id", F.asc_nulls_first("line_ord")).collect()]
    assert report[0] == "✓ Alert a... [DRY-RUN] at 2024-01-01T12:00:00"
    assert report[1] == "  ✓ [nginx_deny] c1" and report[4].startswith("✗ Alert b...")


def test_status_after_execution(spark):
    out, _ = gated(spark, [alert("a"), alert("b", severity="high")], auto_approve_severity=("low",))
    got = {r.alert_id: r.status for r in respond.executed_status(out).collect()}
    assert got == {"a": "executed", "b": "pending"}


def test_messages(spark):
    out, table = gated(spark, [alert("a", source_label="my-site", severity="high"),
                               alert("b", summary="", indicators=[], ip=None)],
                       [("a", 1, "nginx_deny", "deny 1.2.3.4;", "u")])
    texts = {}
    for channel in ("chat", "plain"):
        lines = respond.message_lines(out, table, channel)
        for r in respond.messages(lines).collect():
            texts[(channel, r.alert_id)] = r.message
    chat = texts[("chat", "a")]
    assert "*Site:* my\\-site" in chat and "*Category:* Scan" in chat
    assert "*Time:* 2024\\-01\\-01 12:00:00 UTC" in chat and "`deny 1\\.2\\.3\\.4;`" in chat
    plain = texts[("plain", "a")]
    assert "Severity: 🟠 HIGH" in plain and plain.endswith("Status: PENDING (awaiting approval)")
    assert "  • i_1" in plain and "Source: 1.2.3.4" in plain
    assert "Summary" not in texts[("plain", "b")] and "Source: N/A" in texts[("plain", "b")]
    assert "Suggested" not in texts[("plain", "b")]


def test_every_special_character_is_escaped(spark):
    text = "".join(chr(c) for c in range(32, 127)) + "é"
    got = spark.createDataFrame([(text,)], "t string").select(
        respond.escape_markdown(F.col("t"))).first()[0]
    assert got == "".join("\\" + c if c in "_*[]()~`>#+-=|{}.!" else c for c in text)
    assert re.sub(r"\\(.)", r"\1", got.replace("\\\\", "\\")) is not None


def test_long_messages_are_parted_not_cut(spark):
    rules = [("a", i, "x", f"c{i}", "u") for i in range(250)]
    out, table = gated(spark, [alert("a")], rules)
    parts = respond.messages(respond.message_lines(out, table, "plain"), 100).orderBy(
        "part").collect()
    lines = "\n".join(p.message for p in parts).split("\n")
    assert [p.part for p in parts] == [0, 1, 2]
    assert [l.strip() for l in lines if l.startswith("  c")] == [f"c{i}" for i in range(250)]


def test_one_channel_failing_does_not_stop_the_others(spark):
    sent = []

    def broken(df):
        raise RuntimeError("down")

    chosen = respond.dispatch(spark.range(2), {"bad": broken, "good": lambda d: None},
                              AlertOptions(channels=("good", "pager")))
    assert chosen == {"pager": "no such channel"}
    failed = respond.dispatch(spark.range(3), {"bad": broken, "good": lambda d: sent.append(d.count())})
    assert sent == [3] and failed == {"bad": "down"}


def test_results_of_a_runner_decide_the_final_status(spark):
    out, table = gated(spark, [alert("a"), alert("b"), alert("c", severity="high")],
                       [("a", 1, "x", "c1", "u"), ("a", 2, "x", "c2", "u"), ("b", 1, "x", "c3", "u")],
                       auto_approve_severity=("low", "medium"))
    out = out.withColumn("status", F.when(F.col("alert_id") == "c", "pending").otherwise("approved"))
    when = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ledger = respond.execute_dry(out, table, when)
    results = spark.createDataFrame([("a", 2, False, "exit 1"), ("b", 1, True, "done")],
                                    "alert_id string, step bigint, success boolean, output string")
    told = respond.report_results(ledger, results)
    assert {(r.alert_id, r.step, r.success, r.record_success) for r in told.collect()} == {
        ("a", 1, True, False), ("a", 2, False, False), ("b", 1, True, True), ("c", None, None, False)}
    got = {r.alert_id: r.status for r in respond.executed_status(out, told).collect()}
    assert got == {"a": "failed", "b": "executed", "c": "pending"}
    with pytest.raises(ValueError):
        respond.execute_dry(out, table, when, ResponseOptions(dry_run=False))
