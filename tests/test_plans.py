"""Whole plans: formats in, both levels of assessment, alerts and rules out."""

from __future__ import annotations

import json

import pytest
from conftest import entries_of, lines_of
from pyspark.sql import functions as F

from logwarden.operators import respond
from logwarden.options import MaskOptions, Options
from logwarden.plans import detection
from logwarden.sources import registry

WEB = '198.51.100.%d - - [21/Sep/2025:04:%02d:06 +0000] "%s %s HTTP/1.1" %d 7 "-" "Lynx/2.9"'
def now():
    return F.timestamp_seconds(F.lit(1_758_430_000))


def reply(**fields):
    return lambda prompts: [json.dumps({"category": "malicious", "severity": "critical", "confidence": 0.9} | fields)] * len(prompts)


def test_all_formats_reach_the_detection_and_the_rest_is_kept_aside(spark):
    config = {"sources": [{"name": "web", "path": "/w", "format": "nginx"}, {"name": "auth", "path": "/a", "format": "syslog"}]}
    web = lines_of(spark, *[WEB % (k, k, "GET", "/x?id=%27", 200) for k in range(3)], "no line", label="web")
    auth = lines_of(spark, *["Sep 21 04:05:06 box sshd[1]: Failed password for eve from 203.0.113.5"] * 2, "odd", label="auth")
    auth = auth.withColumn("seq", F.col("seq") + 100)
    other = lines_of(spark, "x", label="stray").withColumn("seq", F.lit(900).cast("bigint"))
    lines = web.unionByName(auth).unionByName(other)
    for options in (Options(), Options(mask=MaskOptions(salt="s"))):
        out = detection.ingest_all(lines, registry.load_sources(spark, config), options)
        assert {r.source_label: r["count"] for r in out.entries.groupBy("source_label").count().collect()} == {"web": 3, "auth": 2}
        assert {(r.source_label, r.reason) for r in out.rejected.collect()} == {
            ("web", "no_match"), ("auth", "no_match"), ("stray", "unknown_source")}
        assert out.entries.where("actor = 'unknown'").count() == 0
    response = detection.respond_to(out.entries, now())
    assert {r.rule for r in response.alerts.collect()} == {"sqli"}


@pytest.mark.parametrize("numbers", ["none", "some"])
def test_lines_without_numbers_are_scored(spark, numbers):
    """Streams give no ``seq``; every line still reaches a batch, and the scorer."""
    config = {"sources": [{"name": "web", "path": "/w", "format": "nginx"}]}
    lines = lines_of(spark, *[WEB % (k, k, "GET", f"/p{k}", 200) for k in range(20)], label="web")
    seq = F.when(F.col("seq") < 3, F.col("seq")) if numbers == "some" else None
    lines = lines.drop("seq") if seq is None else lines.withColumn("seq", seq)
    options = Options(mask=MaskOptions(salt="s")).overlay({"batch": {"interval_seconds": 3600}})
    taken = detection.ingest_all(lines, registry.load_sources(spark, config), options)
    assert taken.entries.where("seq is null").count() == 0
    judged = detection.score_open(taken.entries, reply(), None, options)
    assert judged.count() == 4 and judged.agg(F.sum("n_rows")).first()[0] == 20


@pytest.mark.parametrize("fields, commands", [
    ({"recommended_action": "block_path", "action_details": {"paths": ["/p1", "/p2", "/p1"]}},
     {"location /p1 { deny all; }", "location /p2 { deny all; }"}),
    ({"recommended_action": "block_path", "action_details": {"path": "/only"}}, {"location /only { deny all; }"}),
    ({"recommended_action": "rate_limit", "action_details": {"zone_name": "z9", "rate": "3r/s", "path": "/slow"}},
     {"limit_req_zone $binary_remote_addr zone=z9:10m rate=3r/s;", "limit_req zone=z9;"}),
    ({"recommended_action": "block_ip", "action_details": {"ips": ["192.0.2.1", "192.0.2.2"]}},
     {"deny 192.0.2.1;", "sudo ufw deny from 192.0.2.1", "deny 192.0.2.2;", "sudo ufw deny from 192.0.2.2"}),
    ({"category": "normal"}, set()),
])
def test_second_level_assessments_become_alerts_and_rules(spark, fields, commands):
    entries = entries_of(spark, [{"at": k, "path": "/quiet", "line": "plain"} for k in range(3)]).withColumn("sanitized_line", F.col("raw_line"))
    options = Options()
    judged = detection.score_open(entries, reply(**fields), None, options)
    response = detection.respond_to(entries, now(), options, assessments=judged)
    alerts = response.alerts.collect()
    assert len(alerts) == (1 if commands else 0)
    assert {r.command for r in response.rules.collect()} == commands
    if commands:
        assert alerts[0].rule.startswith("batch ") and alerts[0].analyzed_by == "l2_fast"
        lines = respond.message_lines(response.alerts, response.rules, "plain")
        text = respond.messages(lines).first().message
        assert all(c in text for c in commands) and text.endswith("Status: PENDING (awaiting approval)")
        ledger = respond.execute_dry(response.alerts.withColumn("status", F.lit("approved")), response.rules, now())
        assert {r.command for r in ledger.collect()} == commands


def test_scope_is_an_argument(spark):
    """Five failures in one window are brute force; five over five days are not."""
    rows = [{"at": 86_400 * k, "path": "/login", "status": 401, "method": "POST"} for k in range(5)]
    spread = entries_of(spark, rows)
    assert detection.respond_to(spread, now()).alerts.count() == 1
    scope = ("source_label", "window_start")
    assert detection.respond_to(detection.in_windows(spread, "1 hour"), now(), scope=scope).alerts.count() == 0
    close = detection.in_windows(entries_of(spark, [r | {"at": k} for k, r in enumerate(rows)]), "1 hour")
    assert detection.respond_to(close, now(), scope=scope).alerts.count() == 1


def test_long_heads_stay_before_the_rules(spark):
    entries = entries_of(spark, [{"at": 0, "line": "plain"}]).withColumn("sanitized_line", F.col("raw_line"))
    many = [f"sign-{k}" for k in range(1500)]
    scorer = reply(recommended_action="block_ip", indicators=many, action_details={"ip": "192.0.2.9"})
    judged = detection.score_open(entries, scorer, None, Options())
    response = detection.respond_to(entries, now(), assessments=judged)
    parts = respond.messages(respond.message_lines(response.alerts, response.rules, "plain")).orderBy("part").collect()
    lines = "\n".join(p.message for p in parts).split("\n")
    assert [x.strip("• ") for x in lines if "sign-" in x] == many
    assert lines.index("  deny 192.0.2.9;") > lines.index("  • sign-1499") and lines[-1].startswith("Status:")
