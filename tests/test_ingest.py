from __future__ import annotations

import pytest
from conftest import lines_of
from pyspark.sql import functions as F

from logwarden.operators import ingest
from logwarden.options import IngestOptions
from logwarden.sources import files, registry

NGINX = '198.51.100.7 - - [21/Sep/2025:04:05:06 +0000] "GET /reports HTTP/1.1" 403 731 "-" "Lynx/2.9"'
LOGIN = ('203.0.113.44 - eve [21/Sep/2025:04:05:07 +0000] "POST /session HTTP/1.1" 200 88 '
         '"https://shop.test/start" "Wget/1.21"')
FAILED = "Sep 21 04:05:06 gate sshd[77]: Failed password for oper from 198.51.100.23 port 2200 ssh2"
ACCEPTED = "Sep 21 04:05:09 gate sshd[78]: Accepted publickey for oper from 203.0.113.44 port 2201 ssh2"


def epoch(df):
    return df.withColumn("ts", F.unix_seconds("ts"))


def test_access_fields(spark):
    a, b = epoch(ingest.parse_access(lines_of(spark, NGINX, LOGIN))).orderBy("seq").collect()
    assert (a.source_ip, a.method, a.path, a.status, a.response_size) == (
        "198.51.100.7", "GET", "/reports", 403, 731)
    assert (a.referer, a.user_agent, a.raw_line) == ("-", "Lynx/2.9", NGINX)
    assert a.ts == 1758427506
    assert (b.method, b.path, b.referer) == ("POST", "/session", "https://shop.test/start")


def test_offsets_and_odd_clocks(spark):
    line = NGINX.replace("+0000", "+0200")
    colon = NGINX.replace("+0000", "+02:00")
    short = NGINX.replace("21/Sep", "5/sep").replace("04:05:06", "1:05:06")
    rows = epoch(ingest.parse_access(lines_of(spark, line, colon, short))).orderBy("seq").collect()
    # 5 September 2025 01:05:06
    assert [r.ts for r in rows] == [1758427506 - 7200, 1758427506 - 7200, 1757034306]


def test_parsed_plus_quarantined_is_everything(spark):
    texts = [NGINX, "garbage line", "", NGINX.replace("21/Sep", "41/Sep"),
             NGINX.replace(" 731 ", " - "), LOGIN]
    lines = lines_of(spark, *texts)
    kept = {r.seq for r in ingest.parse_access(lines).collect()}
    out = {r.seq: r.reason for r in ingest.quarantine(lines, "nginx").collect()}
    assert kept == {0, 5}
    assert out == {1: "no_match", 2: "no_match", 3: "bad_time", 4: "no_match"}


def test_syslog(spark):
    texts = [FAILED, ACCEPTED, "<34>" + FAILED, "Feb 29 01:02:03 h cron: reload now",
             "Jan  5 01:02:03 h app:  "]
    rows = epoch(
        ingest.parse_syslog(lines_of(spark, *texts), IngestOptions(syslog_year=2024))
    ).orderBy("seq").collect()
    assert [r.method for r in rows] == ["FAILED", "ACCEPTED", "FAILED", "RELOAD", "UNKNOWN"]
    assert [r.source_ip for r in rows] == ["198.51.100.23", "203.0.113.44", "198.51.100.23", "", ""]
    assert rows[0].path == "sshd" and rows[0].status == 0 and rows[0].user_agent == ""
    assert rows[3].ts == 1709168523  # a leap day


def test_syslog_without_leap_day(spark):
    lines = lines_of(spark, "Feb 29 01:02:03 h cron: reload now")
    options = IngestOptions(syslog_year=2025)
    assert ingest.parse_syslog(lines, options).count() == 0
    assert [r.reason for r in ingest.quarantine(lines, "syslog", options).collect()] == ["bad_time"]


def test_rfc5424_is_optional(spark):
    line = "<165>1 2024-05-01T10:00:00Z host sshd 99 ID47 - Failed password from 10.1.1.1"
    lines = lines_of(spark, line, FAILED)
    assert ingest.parse_syslog(lines).count() == 1
    both = ingest.parse_syslog(lines, IngestOptions(accept_rfc5424=True))
    assert {(r.path, r.method, r.source_ip) for r in both.collect()} == {
        ("sshd", "FAILED", "10.1.1.1"), ("sshd", "FAILED", "198.51.100.23")}


def test_registry_defaults_and_fallback(spark):
    config = {"pipeline": {"log_sources": [{"name": "a", "path": "/a", "format": "nginx"}]}}
    (row,) = registry.load_sources(spark, config).collect()
    assert row.enabled and row.tags == []
    assert registry.load_sources(spark, {}).count() == 0


def test_routing_reasons(spark):
    config = {"sources": [
        {"name": "web", "path": "/w", "format": "nginx", "tags": ["x"]},
        {"name": "odd", "path": "/o", "format": "iis"},
        {"name": "off", "path": "/f", "format": "nginx", "enabled": False},
    ]}
    lines = (
        lines_of(spark, NGINX, "junk", label="web")
        .unionByName(lines_of(spark, NGINX, label="odd"))
        .unionByName(lines_of(spark, NGINX, label="off"))
        .unionByName(lines_of(spark, NGINX, label="new"))
    )
    rows = ingest.route(lines, registry.load_sources(spark, config)).collect()
    assert sorted((r.source_label, r.reason or "") for r in rows) == [
        ("new", "unknown_source"), ("odd", "unknown_format"), ("web", ""), ("web", "no_match")]


def test_a_format_of_the_callers_own(spark):
    formats = {**ingest.line_formats(), "shout": ingest.LineFormat(
        lambda line: F.split(F.upper(line), " "),
        lambda parts: ingest.L._entry(
            F.size(parts) == 2, ts=F.timestamp_seconds(F.lit(0)), source_ip=F.get(parts, F.lit(0)),
            method=F.lit("X"), path=F.get(parts, F.lit(1)), status=F.lit(0),
            response_size=F.lit(0).cast("bigint"), user_agent=F.lit(""), referer=F.lit("")),
    )}
    sources = registry.load_sources(
        spark, {"sources": [{"name": "s", "path": "/s", "format": "shout"}]})
    rows = ingest.route(lines_of(spark, "a b", label="s"), sources, formats=formats).collect()
    assert [(r.source_ip, r.path, r.reason) for r in rows] == [("A", "B", None)]


def test_text_files_and_sequence(spark, tmp_path):
    (tmp_path / "one.log").write_text(f"{NGINX}\n\n{LOGIN}\n")
    (tmp_path / "two.log").write_text(f"{LOGIN}\r\n")
    lines = files.read_lines(spark, [str(tmp_path)], {"one.log": "first"})
    assert sorted((r.source_label, r.raw_line) for r in lines.collect()) == sorted(
        [("first", NGINX), ("first", LOGIN), ("two.log", LOGIN)])
    numbered = ingest.parse_access(lines).orderBy("seq").collect()
    assert [r.path for r in numbered] == ["/reports", "/session", "/session"]
    assert len({r.seq for r in numbered}) == 3  # same line, other source


def test_file_lines_have_a_total_order_in_every_format(spark, tmp_path):
    same = '203.0.113.9 - - [02/Mar/2031:07:08:09 +0000] "GET /a HTTP/1.1" 404 12 "-" "probe/1"'
    far = same.replace("2031", "2300")
    old = same.replace("2031", "1970")
    (tmp_path / "b.log").write_text("\n".join([far, same, same, "", old, "no log line"]) + "\n")
    (tmp_path / "a.log").write_text("Mar  2 07:08:09 box sshd[7]: Accepted password for eve from 203.0.113.9\n" * 3)
    lines = files.read_lines(spark, [str(tmp_path)], {"a.log": "auth", "b.log": "web"})
    rows = lines.orderBy("seq").collect()
    assert len({r.seq for r in rows}) == len(rows) == 8
    assert [r.source_label for r in rows] == ["auth"] * 3 + ["web"] * 5 and rows[3].raw_line == far
    assert ingest.parse_syslog(lines.where("source_label = 'auth'")).count() == 3
    assert ingest.parse_access(lines).orderBy("seq").select("raw_line").first()[0] == far
    config = {"sources": [{"name": "auth", "path": "/a", "format": "syslog"}, {"name": "web", "path": "/b", "format": "nginx"}]}
    routed = ingest.route(lines, registry.load_sources(spark, config))
    assert {r.reason: r["count"] for r in routed.groupBy("reason").count().collect()} == {None: 7, "no_match": 1}
    assert ingest.quarantine(lines.where("source_label = 'web'"), "nginx").count() == 1


def test_a_stream_like_table_without_order_survives_any_year(spark):
    lines = lines_of(spark, *[NGINX.replace("2025", y) for y in ("1970", "2025", "2300", "9999")]).drop("seq")
    rows = ingest.parse_access(lines).orderBy("seq").collect()
    assert [r.ts.year for r in rows][:2] == [1970, 2025] and len(rows) == 4


def test_a_line_is_parsed_or_quarantined_not_both(spark):
    options = IngestOptions(accept_rfc5424=True)
    lines = lines_of(spark, "<13>1 2024-07-08T09:10:11Z box app 5 - - session closed", FAILED, "neither kind")
    assert {r.seq for r in ingest.parse_syslog(lines, options).collect()} == {0, 1}
    assert {r.seq for r in ingest.quarantine(lines, "syslog", options).collect()} == {2}
    assert ingest.format_coverage(lines, "syslog", options).first().matched == 2


def test_a_source_named_twice_is_refused(spark):
    twice = {"sources": [{"name": "web", "path": p, "format": "nginx"} for p in ("/a", "/b")]}
    with pytest.raises(ValueError, match="twice"):
        registry.load_sources(spark, twice)
    one = registry.load_sources(spark, {"sources": twice["sources"][:1]})
    with pytest.raises(ValueError, match="share a name"):
        ingest.route(lines_of(spark, NGINX), one.unionByName(one))
