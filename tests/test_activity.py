from __future__ import annotations

import random

import pytest
from conftest import entries_of
from pyspark.sql import functions as F

from logwarden.operators import activity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [{"at": rng.randint(0, 20_000), "ip": "hot" if rng.random() < 0.6 else rng.choice("ab")}
            for _ in range(1500)]


@pytest.fixture(scope="module")
def entries(spark, rows):
    return entries_of(spark, rows).cache()


BASE = 1704067200


def times(rows, ip):
    return sorted(BASE + r["at"] for r in rows if r["ip"] == ip)


def test_sliding_equals_counting(entries, rows):
    got = {(r.actor, r.window_start): r.n
           for r in activity.sliding(entries, ["actor"], 600, 120).collect()}
    want = {}
    for ip in ("hot", "a", "b"):
        for t in times(rows, ip):
            start = t - t % 120
            for s in range(start - 480, start + 1, 120):
                want[(ip, s)] = want.get((ip, s), 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        activity.sliding(entries, ["actor"], 100, 30)


@pytest.mark.parametrize("chunk", [50, 1000, 86_400])
def test_sessions_do_not_depend_on_the_chunk(entries, rows, chunk):
    got = sorted((r.actor, r.start, r.last, r.n)
                 for r in activity.sessions(entries, ["actor"], 40, chunk=chunk).collect())
    want = []
    for ip in ("hot", "a", "b"):
        run = []
        for t in times(rows, ip):
            if run and t - run[-1] >= 40:
                want.append((ip, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((ip, run[0], run[-1], len(run)))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [300, 5000])
def test_rolling_counts(entries, rows, chunk):
    got = {(r.actor, r.epoch): r.rolling
           for r in activity.rolling_counts(entries, ["actor"], 300, chunk).collect()}
    want = {(ip, t): sum(t - 300 < u <= t for u in times(rows, ip))
            for ip in ("hot", "a", "b") for t in set(times(rows, ip))}
    assert got == want


def test_verdicts(spark):
    entries = entries_of(spark, [{"at": t, "ip": ip} for t, ip in
                                 [(10, "a"), (20, "a"), (110, "b"), (90, "b"), (120, "c"), (99, "d")]])
    actions = spark.createDataFrame([(i, i, BASE + 100) for i in "abcde"],
                                    "alert_id string, actor string, t bigint").select(
        "alert_id", "actor", F.timestamp_seconds("t").alias("executed_at"))
    got = {r.actor: (r.n_before, r.n_after, r.verdict)
           for r in activity.mitigation_verdict(entries, actions, 90, chunk=25).collect()}
    assert got == {"a": (2, 0, "resolved"), "b": (1, 1, "ongoing"), "c": (0, 1, "escalated"),
                   "d": (1, 0, "resolved"), "e": (0, 0, "resolved")}


def test_correlation(spark):
    df = entries_of(spark, [
        {"ip": "x", "source": "web", "status": 404}, {"ip": "x", "source": "auth", "method": "FAILED"},
        {"ip": "y", "source": "web"}, {"ip": "y", "source": "web"},
        {"ip": "z", "source": "ap", "status": 500}, {"ip": "z", "source": "web", "status": 200},
    ]).withColumn("format", F.expr(
        "CASE source_label WHEN 'auth' THEN 'syslog' WHEN 'ap' THEN 'apache' ELSE 'nginx' END"))
    got = {r.actor: (r.n_sources, r.coordinated, r.app_layer)
           for r in activity.source_correlation(df, 3600).collect()}
    assert got == {"x": (2, True, False), "z": (2, False, True)}


def test_autonomy(spark):
    rules = spark.createDataFrame(
        [("ufw", "block_ip", "high", True), ("nginx_deny", "block_ip", "low", True),
         ("rate_limit", "rate_limit", "low", False), ("other", "x", "low", False)],
        "rule_type string, effective_action string, severity string, critical boolean")
    policy = spark.createDataFrame([("ufw", "never"), ("rate_limit", "auto")], "name string, mode string")
    modes = lambda level: {
        r.rule_type: r.mode for r in activity.autonomy_gate(rules, policy, F.lit(level)).collect()}
    assert modes("suggest") == {
        "ufw": "never", "nginx_deny": "approval", "rate_limit": "auto", "other": "approval"}
    assert modes("auto_mitigate_low")["other"] == "auto"
    assert modes("observe_only")["nginx_deny"] == "never"
    assert modes("full_auto_with_hitl_critical")["nginx_deny"] == "approval"
