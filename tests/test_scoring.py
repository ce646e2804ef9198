from __future__ import annotations

import json

import pytest
from conftest import entries_of
from pyspark.sql import functions as F

from logwarden.functions import verdict as V
from logwarden.operators import batches as B
from logwarden.operators import scoring
from logwarden.operators.mask import TOKEN_LIST
from logwarden.options import BatchOptions, MaskOptions, Options
from logwarden.plans import detection as P


def replies(spark, *texts):
    rows = [(i, t, '1.1.1.1 "GET /a HTTP/1.1"', "web", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "batch_id bigint, reply string, batch_text string, source_label string, "
              "context_text string")


@pytest.mark.parametrize("category,confidence,want", [
    ("normal", 0.9, False), ("suspicious", 0.3, True), ("exploit_attempt", 0.9, False),
    ("bruteforce", 0.9, False), ("suspicious", 0.9, False), ("suspicious", 0.5, True),
    ("scan", 0.7, True), ("normal", 0.8, False), ("normal", 0.59, True), ("scan", 0.8, False),
    ("normal", None, False), (None, 0.7, False),
])
def test_escalation(spark, category, confidence, want):
    df = spark.createDataFrame([(category, confidence)], "c string, p double")
    assert df.select(V.should_escalate(F.col("c"), F.col("p"))).first()[0] is want


def test_reply_shapes(spark):
    good = {"category": "scan", "severity": "high", "confidence": "0.7", "summary": "s",
            "indicators": ["a", "b"], "recommended_action": "block_path",
            "action_details": {"paths": ["/x"], "rate": "5r/m"}, "mitre_ttps": ["T1190"]}
    texts = [json.dumps(good), json.dumps([good]), "[]", "not json", "```json\n" + json.dumps(good)
             + "\n```", "3", '{"category": 5, "severity": "huge", "confidence": "x"}',
             '{"category": "scan", "action_details": "do it"}', "", '{"action_details": {}}']
    rows = scoring.assess_fast(replies(spark, *texts)).orderBy("batch_id").collect()
    for i in (0, 1, 4):
        r = rows[i]
        assert (r.category, r.severity, r.confidence, r.recommended_action) == (
            "scan", "high", 0.7, "block_path")
        assert (r.indicators, r.mitre_ttps, r.details.paths, r.details.rate) == (
            ["a", "b"], ["T1190"], ["/x"], "5r/m")
    for i in (2, 5, 6, 9):
        r = rows[i]
        assert (r.category, r.severity, r.confidence, r.summary, r.details_kind) == (
            "normal", "low", 0.0, "", "none")
    for i in (3, 8):
        assert rows[i].parse_error and rows[i].summary == "parse error" and not rows[i].escalate
    assert rows[7].details_kind == "text" and rows[7].details.details == "do it"


def test_deep_overlay(spark):
    fast = scoring.assess_fast(replies(spark, *['{"category":"suspicious","severity":"low",'
                                                '"confidence":0.4,"summary":"f"}'] * 4))
    deep = spark.createDataFrame(
        [(0, "garbage{"), (1, '{"threat_type":"worm","severity":"critical"}'),
         (2, '{"summary":"d","confidence":0.9,"recommended_action":"block_ip","category":"normal"}')],
        "batch_id bigint, deep_reply string")
    rows = scoring.merge_deep(fast, deep).orderBy("batch_id").collect()
    assert [(r.analyzed_by, r.summary, r.severity) for r in rows] == [
        ("l2_fast", "f", "low"), ("l2_deep", "worm", "critical"), ("l2_deep", "d", "low"),
        ("l2_fast", "f", "low")]
    assert rows[2].confidence == 0.9 and rows[2].recommended_action == "block_ip"
    assert rows[2].category == "suspicious" and rows[1].confidence == 0.4


def test_enrichment(spark):
    texts = ['{"category":"bruteforce"}', '{"category":"scan"}', '{"category":"normal"}',
             '{"category":"scan","action_details":"note"}',
             '{"category":"malicious","recommended_action":"rate_limit"}']
    rows = scoring.enrich(scoring.assess_fast(replies(spark, *texts))).orderBy("batch_id").collect()
    assert [r.recommended_action for r in rows] == [
        "block_ip", "rate_limit", "alert_only", "alert_only", "rate_limit"]
    assert rows[0].details.ips == ["1.1.1.1"] and rows[0].details.path == "/a"


def test_extract_prefers_tokens_and_keeps_order(spark):
    text = '[IP_b1] "GET /x HTTP/1.1"\n1.2.3.4 "POST /y HTTP/1.1"\n[IP_a0] [IP_b1] "GET /x HTTP/1.0"'
    found = spark.createDataFrame([(text,), ("9.9.9.9 8.8.8.8 9.9.9.9",)], "t string").select(
        B.extract_from_batch(F.col("t")).alias("f")).collect()
    assert found[0].f.ips == ["[IP_b1]", "[IP_a0]"] and found[0].f.paths == ["/x", "/y"]
    assert found[1].f.ips == ["9.9.9.9", "8.8.8.8"] and found[1].f.path is None


def test_each_scorer_sees_a_row_once(spark, tmp_path):
    log = str(tmp_path)

    def fast(prompts, log=log):
        import os, uuid
        open(os.path.join(log, "fast-" + uuid.uuid4().hex), "w").write(str(len(prompts)))
        return ['{"category":"suspicious","confidence":0.5}' if "BAD" in p else
                '{"category":"normal","confidence":0.9}' for p in prompts]

    def deep(prompts, log=log):
        import os, uuid
        open(os.path.join(log, "deep-" + uuid.uuid4().hex), "w").write(str(len(prompts)))
        return ['{"severity":"high"}' for _ in prompts]

    texts = spark.createDataFrame(
        [(i, "BAD line" if i % 4 == 0 else "fine", "web", "") for i in range(40)],
        "batch_id bigint, batch_text string, source_label string, context_text string")
    rows = scoring.cascade(texts, fast, deep).collect()
    calls = lambda kind: sum(int(p.read_text()) for p in tmp_path.glob(f"{kind}-*"))
    assert (calls("fast"), calls("deep")) == (40, 10)
    assert {(r.batch_id % 4 == 0, r.analyzed_by, r.severity) for r in rows} == {
        (True, "l2_deep", "high"), (False, "l2_fast", "low")}


def test_without_a_deep_scorer(spark):
    texts = replies(spark, "x").drop("reply")
    (row,) = scoring.cascade(texts, lambda ps: ['{"category":"scan","confidence":0.1}'] * len(ps)
                             ).collect()
    assert row.escalate and row.analyzed_by == "l2_fast"


def test_batches(spark):
    entries = entries_of(spark, [{"at": 0}] * 5 + [{"at": 31}] * 3)
    rows = B.assign_batches(entries, BatchOptions(size=2, interval_seconds=30)).orderBy(
        "seq").collect()
    assert [r.batch_no for r in rows] == [0, 0, 1, 1, 2, 0, 0, 1]
    assert len({r.batch_id for r in rows}) == 5


def test_main_source_of_a_batch(spark):
    entries = entries_of(spark, [{"source": s} for s in "abba"] + [{"source": "c", "noise": True}] * 5)
    batched = entries.withColumn("batch_id", F.lit("x")).withColumn("sanitized_line", F.lit("l"))
    (row,) = B.batch_texts(batched).collect()
    assert (row.source_label, row.n_rows, row.batch_text) == ("a", 4, "l\nl\nl\nl")


def test_prompts_hold_no_personal_data(spark):
    lines = [
        ('10.0.0.7 - - [15/Jan/2024:10:30:%02d +0000] "GET /u/12345/x?mail=joe@site.org HTTP/1.1" '
         '200 5 "https://h.io/cb?token=t" "UA fe80::1"') % i for i in range(12)
    ]
    options = Options(mask=MaskOptions(salt="s"))
    df = spark.createDataFrame([(i, "web", t) for i, t in enumerate(lines)],
                               "seq bigint, source_label string, raw_line string")
    texts = P.open_batches(P.masked_entries(df, options), options)
    prompts = [r[0] for r in texts.select(B.fast_prompt()).collect()]
    assert prompts and all("Context:" in p for p in prompts)
    for prompt in prompts:
        for secret in ("10.0.0.7", "joe@site.org", "/12345", "token=t", "fe80::1"):
            assert secret not in prompt


def test_context_keeps_the_last_rows(spark):
    entries = entries_of(spark, [{"source": "a" if i % 5 else "b", "noise": i % 7 == 0}
                                 for i in range(300)])
    rows = B.rolling_context(entries, ["source_label"], 30, ("status",), chunk=50).collect()
    signal = [i for i in range(300) if i % 7]
    for row in rows:
        mine = [i for i in signal if (i % 5 == 0) == (row.seq % 5 == 0) and i <= row.seq][-30:]
        assert [c.seq for c in row.context] == mine
    assert len(rows) == len(signal)


def _context_rows(spark, n=400):
    """Rows whose batches interleave, as those of neighbouring numbers fall on different days; every ninth is noise."""
    rows = [{"at": (i * 7 % 5) * 86_400 + i, "path": f"/p{i}", "noise": i % 9 == 0} for i in range(n)]
    return entries_of(spark, rows)


def test_contexts_are_cut_for_wanted_batches_only(spark):
    """One context per batch, of the last rows before its end, and none for batches that are left out."""
    options = Options().overlay({"batch": {"interval_seconds": 86_400}})
    batched = B.assign_batches(_context_rows(spark), options.batch).localCheckpoint()
    signal = sorted((r.seq, r.batch_id) for r in batched.where("not is_noise").collect())
    seqs = [seq for seq, _ in signal]
    last = {batch: seq for seq, batch in signal}
    want = {batch: seqs[max(0, seqs.index(seq) - 29):seqs.index(seq) + 1] for batch, seq in last.items()}
    out = set(sorted(want)[::3])
    without = spark.createDataFrame([(b,) for b in out], "batch_id string")
    rows = B.batch_contexts(batched, options.batch, without=without).collect()
    assert len(rows) == len(want) - len(out)
    assert {r.batch_id: [c.seq for c in r.context] for r in rows} == {b: s for b, s in want.items() if b not in out}
    assert len(B.batch_contexts(batched, options.batch).collect()) == len(want)


def test_little_is_landed_for_the_scorer(spark, monkeypatch):
    """Open batches land the columns that are read, once, and no text of a line beside the one that is shown."""
    landed = {}
    keep = P.land
    monkeypatch.setattr(P, "land", lambda df, name: landed.setdefault(name, keep(df, name)))
    entries = _context_rows(spark).withColumn("token_list", F.expr(f"cast(array() as {TOKEN_LIST})"))
    P.open_batches(entries, Options(), "raw_line").collect()
    assert set(landed) == {"entries", "taken"}
    assert set(landed["entries"].columns) == {
        "seq", "ts", "source_label", "actor", "method", "path", "status", "user_agent", "is_noise", "raw_line",
        "_shown_path", "_shown_user_agent"}
    assert landed["taken"].columns == ["seq", "batch_id"]


def test_rows_are_landed_with_their_labels_not_joined_back(spark, monkeypatch):
    """Contexts without taken rows come from one landed table of labels: no table joins rows by their number."""
    rows = [{"ip": f"10.0.0.{k % 7}", "path": f"/a{k % 5}" if k % 4 else "/x?id=%27", "line": f"line {k}"} for k in range(40)]
    options = Options().overlay({"batch": {"consume": True, "size": 5}})
    plans = []

    def land(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    real = P.land
    monkeypatch.setattr(P, "land", land)
    texts = P.open_batches(entries_of(spark, rows), options, "raw_line")
    assert plans and not any("LeftAnti" in plan for plan in plans)
    # every batch of five has a row that the rules take, except where none falls in it
    assert texts.collect() == []
    few = entries_of(spark, [{"path": "/x?id=%27" if k == 2 else f"/p{k}", "ip": f"10.0.0.{k}"} for k in range(10)])
    got = P.open_batches(few, options, "raw_line").collect()
    assert [r["first_seq"] for r in got] == [5]
    assert got[0]["context_text"].startswith("Total entries: 9\n") and "/x?id" not in got[0]["context_text"]


def test_context_text_of_single_repeated_and_missing_values(spark):
    """Actors with one row are described as those with more are, also where a value is missing or empty."""
    row = "struct<seq:bigint,ts:timestamp,actor:string,method:string,path:string,status:int,user_agent:string>"
    at = "timestamp'2024-01-01 00:00:0%d'"
    given = [("a", "GET", "/x", 200, "ua"), ("b", "POST", "/x", 404, ""), ("a", "GET", "/y", 200, "ua"),
             ("c", None, "/z", 200, "ua"), ("d", "GET", "/x", None, "ua"), ("e", "GET", "/w", 200, None), ("f", "PUT", "", 500, "f1")]
    items = [f"named_struct('seq',{k}L,'ts',{at % k},'actor','{a}','method',{m!r},'path','{p}','status',{s},'user_agent',{u!r})"
             .replace("None", "null") for k, (a, m, p, s, u) in enumerate(given)]
    df = spark.range(1).select(F.expr(f"cast(array({','.join(items)}) as array<{row}>)").alias("context"))
    text = df.select(B.context_text(F.col("context"))).first()[0]
    assert text == "\n".join([
        "Total entries: 7", "Time window: 00:00:00 - 00:00:06", "",
        "IP a: 2 requests", "  GET /x -> 1x (status 200:2)", "  GET /y -> 1x (status 200:2)", "  User-Agent: ua", "",
        "IP b: 1 requests", "  POST /x -> 1x (status 404:1)", "",
        "IP c: 1 requests", "  User-Agent: ua", "",
        "IP d: 1 requests", "  GET /x -> 1x (status )", "  User-Agent: ua", "",
        "IP e: 1 requests", "  GET /w -> 1x (status 200:1)", "",
        "IP f: 1 requests", "  PUT  -> 1x (status 500:1)", "  User-Agent: f1", "",
        "Frequent paths:", "  /x: 3 hits from 3 IPs", ""])
