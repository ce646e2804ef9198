from __future__ import annotations

import random
import re

import pytest
from conftest import entries_of
from pyspark.sql import functions as F

from logwarden.functions import fixed
from logwarden.operators import rules
from logwarden.options import RuleOptions

SCOPE = ["source_label"]


def found(spark, rows, options=RuleOptions(), scope=SCOPE):
    return {
        (r.rule, r.actor): r
        for r in rules.findings(entries_of(spark, rows), scope, options).collect()
    }


def login(ip="10.0.0.1", **more):
    return {"ip": ip, "method": "POST", "path": "/login", "status": 401, **more}


def test_brute_force_threshold(spark):
    assert found(spark, [login()] * 4) == {}
    out = found(spark, [login()] * 5)[("bruteforce", "10.0.0.1")]
    assert (out.category, out.severity, out.recommended_action) == (
        "bruteforce", "high", "block_ip")
    assert out.summary == "Brute force: 5 failed logins from 10.0.0.1 to /login"
    assert out.indicator == "5x_401_from_10.0.0.1" and out.confidence == 0.95


def test_brute_force_needs_one_actor_and_failures(spark):
    assert found(spark, [login(f"10.0.0.{i}") for i in range(5)]) == {}
    assert found(spark, [login(status=200)] * 10) == {}
    assert found(spark, [login(method="GET")] * 5) == {}
    assert found(spark, [login(noise=True)] * 5) == {}
    assert list(found(spark, [login(path="/login//", method="put", status=403)] * 5)) == [
        ("bruteforce", "10.0.0.1")]


def test_path_fuzzing_counts_distinct_paths(spark):
    probe = lambda n: [{"path": f"/x{i % n}", "status": 404} for i in range(8)]
    assert found(spark, probe(4)) == {}
    out = found(spark, probe(5))[("path_fuzz", "10.0.0.1")]
    assert (out.category, out.severity, out.recommended_action) == ("scan", "medium", "rate_limit")
    assert (out.n, out.n_rows) == (5, 8)


def test_scanner_and_row_rules(spark):
    out = found(spark, [{"agent": "X Nikto/2.1", "seq": 7}, {"agent": "sqlmap", "seq": 3, "ip": "1.1.1.1"}])
    scan = out[("scanner", None)]
    assert scan.summary == "Known scanner detected from 1.1.1.1: sqlmap"
    assert (scan.n_ips, scan.first_seq) == (2, 3)
    long_path = "/q?x=%27" + "a" * 100
    sqli = found(spark, [{"path": long_path}])[("sqli", None)]
    assert sqli.severity == "critical"
    assert sqli.summary == f"SQL injection attempt detected: {long_path[:80]}"
    assert sqli.indicator == f"sqli_pattern_in_{long_path[:50]}"


@pytest.mark.parametrize("path,rule", [
    ("/?q=UNION SELECT 1", "sqli"), ("/?q=union all select", "sqli"), ("/?a=' --", "sqli"),
    ("/?p1=10", "sqli"), ("/?p=1", None), ("/?a1=1", "sqli"), ("/../x", "traversal"), ("/..%2Fx", "traversal"),
    ("/..\\x", "traversal"), ("/a..b", None), ("/?q=OR+1%3D1", None),
])
def test_patterns(spark, path, rule):
    assert [k[0] for k in found(spark, [{"path": path}])] == ([rule] if rule else [])


def test_decoded_paths_are_an_option(spark):
    rows = [{"path": "/?q=OR+1%3D1"}, {"path": "/%zz"}]
    out = found(spark, rows, RuleOptions(decode_path=True))
    assert [k[0] for k in out] == ["sqli"]


def test_precedence(spark):
    out = found(spark, [login(path="/login?q=UNION SELECT")] + [login()] * 5)
    assert {k[0] for k in out} == {"sqli", "bruteforce"}
    out = found(spark, [{"path": "/../../etc/passwd", "agent": "Nikto"}])
    assert [k[0] for k in out] == ["traversal"]


def test_below_threshold_falls_through_to_later_rules(spark):
    # four failed logins (403) with a scanner's name: no brute force, so the scanner rule's
    rows = [login(agent="nikto", status=403)] * 4
    assert [k[0] for k in found(spark, rows)] == ["scanner"]
    rows = [login(path=p, status=403) for p in ("/login", "/auth", "/signin", "/api/login")]
    rows.append({"path": "/y", "status": 404})
    assert [k[0] for k in found(spark, rows)] == ["path_fuzz"]


def test_parity_options(spark):
    rows = [login("10.0.0.2")] * 5 + [login("10.0.0.1")] * 6
    assert {k[1] for k in found(spark, rows)} == {"10.0.0.1", "10.0.0.2"}
    assert [k[1] for k in found(spark, rows, RuleOptions(first_only=True))] == ["10.0.0.2"]
    rows = [{"path": f"/x{i}", "status": 404} for i in range(5)] + [{"agent": "nmap", "ip": "9.9.9.9"}]
    assert {k[0] for k in found(spark, rows)} == {"scanner", "path_fuzz"}
    quiet = RuleOptions(suppress_fuzz_on_scanner=True)
    assert {k[0] for k in found(spark, rows, quiet)} == {"scanner"}
    assert found(spark, rows, RuleOptions(enabled=False)) == {}


def test_actors_of_a_finding(spark):
    entries = entries_of(spark, [{"path": "/%27", "ip": "1.1.1.1"}, {"ip": "2.2.2.2"}])
    matched = rules.finding_actors(rules.profile(entries, SCOPE), SCOPE).collect()
    assert [(r.rule, r.ip) for r in matched] == [("sqli", "1.1.1.1")]
    wide = rules.scope_actors(entries, rules.findings(entries, SCOPE), SCOPE).collect()
    assert {(r.rule, r.ip) for r in wide} == {("sqli", "1.1.1.1"), ("sqli", "2.2.2.2")}


def by_hand(rows, threshold=5):
    """The cascade, one rule after the other on what is left, per scope."""
    label = {}
    matchers = {
        "sqli": lambda r: any(re.search(p, r["path"], re.I) for p in fixed.SQLI_PATTERNS),
        "traversal": lambda r: any(re.search(p, r["path"], re.I) for p in fixed.TRAVERSAL_PATTERNS),
        "bruteforce": lambda r: r["status"] in (401, 403) and r["method"] == "POST"
        and r["path"].rstrip("/") in fixed.BRUTE_PATHS,
        "scanner": lambda r: "nikto" in r["agent"],
        "path_fuzz": lambda r: r["status"] in (403, 404),
    }
    for rule, matches in matchers.items():
        left = [r for r in rows if r["seq"] not in label and not r["noise"] and matches(r)]
        if rule in ("bruteforce", "path_fuzz"):
            for key in {(r["source"], r["ip"]) for r in left}:
                mine = [r for r in left if (r["source"], r["ip"]) == key]
                size = len(mine) if rule == "bruteforce" else len({r["path"] for r in mine})
                if size >= threshold:
                    label.update({r["seq"]: rule for r in mine})
        else:
            label.update({r["seq"]: rule for r in left})
    return label


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    paths = ["/login", "/auth", "/login/", "/x", "/y", "/z", "/w", "/../a", "/%27", "/login?q=%27"]
    return [
        {
            "seq": i, "ip": f"10.0.0.{rng.choice([1, 1, 1, 2, 3, 4, 5])}",
            "source": rng.choice("ab"), "path": rng.choice(paths),
            "status": rng.choice([200, 401, 403, 404]), "method": rng.choice(["GET", "POST"]),
            "agent": rng.choice(["Mozilla"] * 5 + ["nikto"]), "noise": rng.random() < 0.1,
        }
        for i in range(700)
    ]


@pytest.mark.parametrize("threshold", [2, 4, 6, 9])
def test_labels_and_findings_equal_the_cascade(spark, mixed, threshold):
    options = RuleOptions(brute_force_threshold=threshold, path_fuzz_threshold=threshold)
    want = by_hand(mixed, threshold)
    entries = entries_of(spark, mixed)
    labelled = rules.label_rows(entries, SCOPE, options).collect()
    assert len(labelled) == sum(not r["noise"] for r in mixed)
    assert {r.seq: r.label for r in labelled if r.label} == want
    counts = {}
    for row in mixed:
        rule = want.get(row["seq"])
        if rule:
            actor = row["ip"] if rule in ("bruteforce", "path_fuzz") else None
            counts[(rule, row["source"], actor)] = counts.get((rule, row["source"], actor), 0) + 1
    out = rules.findings(entries, SCOPE, options).collect()
    assert {(r.rule, r.source_label, r.actor): r.n_rows for r in out} == counts


def test_a_rule_of_the_callers_own(spark):
    mine = rules.Rule(
        "uploads", rules.COUNT, lambda: F.col("method") == "PUT", "suspicious", "low",
        "investigate", 2, summary=lambda: F.format_string("%d uploads", "n"),
        indicator=lambda: F.lit("put"))
    book = [mine, *rules.default_rules()]
    rows = entries_of(spark, [{"method": "PUT"}] * 2)
    (out,) = rules.findings(rows, SCOPE, rules=book).collect()
    assert (out.rule, out.summary, out.actor) == ("uploads", "2 uploads", "10.0.0.1")


def test_one_scan_and_no_sort_before_the_shuffle(spark, sf_dir):
    from logwarden.catalog.queries import QUERIES

    plan = QUERIES["l1_assessments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("regexp_replace(raw_line") == 1
    first = plan[plan.rindex("HashAggregate"):]
    assert "partial_count" in first and "BatchEvalPython" not in plan


def many_rules():
    """Twelve actor rules and two row rules over what overlaps: path, status, method and agent."""
    made = []
    for k in range(14):
        kind = rules.ROW if k in (4, 9) else rules.PATHS if k % 3 == 1 else rules.COUNT
        made.append(rules.Rule(
            f"r{k}", kind, lambda k=k: F.pmod(F.xxhash64("path", "status", "method", F.lit(k)), F.lit(5 if k not in (4, 9) else 17)) == 0,
            "custom", "low", "monitor", 2 + k % 3, summary=lambda: F.col("path"), indicator=lambda: F.col("path")))
    return made


def random_entries(n=400, seed=5):
    rng = random.Random(seed)
    return [{"ip": rng.choice(["10.0.0.1"] * 6 + [f"10.0.0.{i}" for i in range(9)] + [None]), "path": f"/p{rng.randrange(25)}",
             "status": rng.choice([200, 401, 404]), "method": rng.choice(["GET", "POST"]), "source": rng.choice("ab"),
             "noise": rng.random() < 0.1} for _ in range(n)]


def test_many_actor_rules_equal_one_after_the_other(spark):
    registry = many_rules()
    entries = entries_of(spark, random_entries()).cache()
    marked = rules.candidates(entries, registry).collect()
    left, want, labels = list(marked), set(), {}
    for rule in registry:
        groups = {}
        for row in left:
            if row[f"_m_{rule.name}"]:
                groups.setdefault((row.source_label, row.actor), []).append(row)
        for (source, actor), mine in groups.items():
            n = len({r.path for r in mine}) if rule.kind == rules.PATHS else len(mine)
            if n >= rule.threshold or rule.kind == rules.ROW:
                first = min(mine, key=lambda r: r.seq)
                want.add((rule.name, source, actor, n, len(mine), first.seq, first.path))
                labels.update({r.seq: rule.name for r in mine})
        left = [r for r in left if r.seq not in labels]
    table = rules.profile(entries, SCOPE, rules=registry)
    got = {(c.rule, c.source_label, c.ip, c.n, c.n_rows, c.first.seq, c.first.path)
           for c in rules._caught(table, registry, SCOPE).collect()}
    assert got == want and len({w[0] for w in want}) > 9
    labelled = {r.seq: r.label for r in rules.label_rows(entries, SCOPE, rules=registry).collect()}
    assert {seq: label for seq, label in labelled.items() if label} == labels
    assert len(labelled) == len(marked)


def test_both_ways_of_counting_agree(spark):
    registry = rules.default_rules(RuleOptions(brute_force_threshold=2, path_fuzz_threshold=3))
    rows = [{**r, "path": "/login" if r["status"] == 401 else r["path"], "agent": "sqlmap" if i % 13 == 0 else "Mozilla"}
            for i, r in enumerate(random_entries(seed=6))]
    marked = rules.candidates(entries_of(spark, rows), registry)
    cases = rules.actor_profile(rules.path_profile(marked, registry, SCOPE), registry, SCOPE)
    masks = rules.residual_profile(marked, registry, SCOPE)
    first, second = (sorted(map(str, rules._caught(t, registry, SCOPE).collect())) for t in (cases, masks))
    assert first == second and first


def test_limits_of_registries(spark):
    marked = rules.candidates(entries_of(spark, [{}]), many_rules())
    with pytest.raises(ValueError, match="residual_profile"):
        rules.path_profile(marked, many_rules(), SCOPE)
    with pytest.raises(ValueError, match="at most"):
        rules.path_masks(marked, many_rules() * 5, SCOPE)
    assert rules.residual_profile(marked.where("false"), many_rules(), SCOPE).count() == 0
