from __future__ import annotations

import random
import re

import pytest
from conftest import lines_of
from pyspark.sql import functions as F

from logwarden.functions import fixed
from logwarden.operators import mask
from logwarden.options import MaskOptions

OPTIONS = MaskOptions(salt="pepper")


def masked(spark, *texts, options=OPTIONS):
    return mask.mask_hashed(lines_of(spark, *texts), options).orderBy("seq")


def kinds(text):
    return re.findall(r"\[([A-Z0-9_]+)_[0-9a-f]{32}\]", text)


def test_golden_lines(spark):
    rows = masked(
        spark,
        "mail of ops@shop.test opened /orders/90210 at 192.0.2.8",
        "GET http://shop.test/v2?token=hushhush77&page=4 HTTP/1.1",
        "GET /index.html HTTP/1.1",
        "2001:db8:85a3:0:0:8a2e:370:7334 and fe80::1 called",
    ).collect()
    assert kinds(rows[0].sanitized_line) == ["EMAIL", "ID", "IP"]
    assert kinds(rows[1].sanitized_line) == ["URL_SENSITIVE"] and "hushhush" not in rows[1][3]
    assert rows[2].sanitized_line == rows[2].raw_line and rows[2].token_list == []
    assert kinds(rows[3].sanitized_line)[0] == "IPV6"


def test_same_value_same_token(spark):
    a, b = masked(spark, "10.0.0.1 x", "y 10.0.0.1").collect()
    assert a.token_list[0].token == b.token_list[0].token


def test_a_value_inside_another_is_kept_apart(spark):
    (row,) = masked(spark, "1.2.3.4 then 1.2.3.45").collect()
    tokens = {t.original: t.token for t in row.token_list}
    assert row.sanitized_line == f"{tokens['1.2.3.4']} then {tokens['1.2.3.45']}"


def test_switches(spark):
    text = "a@b.org from 10.0.0.1"
    (row,) = masked(spark, text, options=MaskOptions(salt="s", patterns={"email": False})).collect()
    assert kinds(row.sanitized_line) == ["IP"] and "a@b.org" in row.sanitized_line
    (row,) = masked(spark, text, options=MaskOptions(enabled=False)).collect()
    assert row.sanitized_line == text
    with pytest.raises(ValueError):
        mask.mask_hashed(lines_of(spark, text), MaskOptions())


def random_texts(n, seed=7):
    rng = random.Random(seed)
    parts = ["10.0.0.1", "10.0.0.12", "1.2.3.4", "fe80::1", "::", "std::vector", "a@b.org",
             "x.a@b.org", "http://h/p?token=1", "https://10.0.0.1/a?b=1&key=2/1234", "/1234",
             "/12345", "/1234/", "/users/999", " ", " ", " ", "word", "[IP_001]", "é", ":", "$1", "\\"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_round_trip_on_random_lines(spark):
    texts = random_texts(400)
    rows = masked(spark, *texts).withColumn(
        "restored", mask.unmask(F.col("sanitized_line"), F.col("token_list"))
    ).collect()
    assert [r.restored for r in rows] == texts


def test_nothing_is_left_of_separate_values(spark):
    rng = random.Random(9)
    values = ["10.0.0.1", "10.0.0.12", "fe80::1", "a@b.org", "x.a@b.org", "/users/1234/x",
              "https://10.0.0.1/a?b=1&key=2", "word", "::"]
    texts = [" ".join(rng.choice(values) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for row in masked(spark, *texts).collect():
        outside = re.sub(fixed.ANY_TOKEN, "", row.sanitized_line)
        for name, pattern, _ in fixed.PII_PATTERNS:
            assert not re.search(pattern, outside), (name, row.sanitized_line)


def test_masking_equals_a_plain_python_one(spark):
    import hashlib

    def by_hand(text):
        for _, pattern, prefix in fixed.PII_PATTERNS:
            found = set(re.findall(pattern, text))
            for value in sorted(found, key=lambda v: (-len(v), v)):
                digest = hashlib.sha256(("pepper" + value).encode()).hexdigest()[:32]
                text = text.replace(value, f"{prefix}{digest}]")
        return text

    texts = random_texts(400, seed=11)
    got = [r.sanitized_line for r in masked(spark, *texts).collect()]
    assert got == [by_hand(t) for t in texts]


def test_numbered_tokens(spark):
    work = masked(spark, "b 10.0.0.2 10.0.0.1", "10.0.0.1 a@b.org", "10.0.0.3")
    dictionary = mask.token_dictionary(mask.token_occurrences(work))
    numbered = mask.mask_numbered(work, dictionary).orderBy("seq").collect()
    assert [r.sanitized_line for r in numbered] == [
        "b [IP_001] [IP_002]", "[IP_002] [EMAIL_001]", "[IP_003]"]


def test_numbers_grow_past_their_width(spark):
    lines = lines_of(spark, *[f"10.{i // 250}.{i % 250}.1" for i in range(1100)])
    work = mask.mask_hashed(lines, OPTIONS)
    dictionary = mask.token_dictionary(mask.token_occurrences(work))
    rows = {r.first_seq: r.token for r in dictionary.collect()}
    assert rows[0] == "[IP_001]" and rows[998] == "[IP_999]" and rows[999] == "[IP_1000]"
    assert len(set(rows.values())) == 1100


def test_token_lookup_with_time_to_live(spark):
    dictionary = spark.createDataFrame(
        [("[IP_1]", "1.1.1.1", 0), ("[IP_2]", "2.2.2.2", 1000)], "token string, original string, c int"
    ).select("token", "original", F.timestamp_seconds("c").alias("created_at"))
    asked = spark.createDataFrame(
        [("[IP_1]", 100), ("[IP_1]", 101), ("[IP_2]", 1001), ("[IP_9]", 1)], "token string, t int"
    ).select("token", "t", F.timestamp_seconds("t").alias("asked_at"))
    rows = mask.resolve_tokens(asked, dictionary, 100).orderBy("t", "token").collect()
    assert [(r.t, r.original) for r in rows] == [
        (1, None), (100, "1.1.1.1"), (101, None), (1001, "2.2.2.2")]
    flags = mask.purge_expired(dictionary, F.timestamp_seconds(F.lit(1000)), 100).collect()
    assert {r.token: r.expired for r in flags} == {"[IP_1]": True, "[IP_2]": False}


def test_token_epochs_against_a_loop(spark):
    rng = random.Random(3)
    seen = [(rng.choice("abc"), rng.randint(0, 40_000)) for _ in range(3000)]
    seen += [("hot", t // 4) for t in range(8000)]
    want = []
    for value in {v for v, _ in seen}:
        times = sorted(t for v, t in seen if v == value)
        number, anchor, n = 0, None, 0
        for t in times:
            if anchor is None or t > anchor + 360:
                if anchor is not None:
                    want.append((value, number, anchor, n))
                number, anchor, n = number + 1, t, 0
            n += 1
        want.append((value, number, anchor, n))
    df = spark.createDataFrame(seen, "value string, epoch bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = sorted(tuple(r) for r in mask.token_epochs(df, 360).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)


def test_the_first_address_alone_gives_the_same_actor(spark):
    texts = ["from 10.0.0.9 to 10.0.0.10", "see 2001:db8::1 a@b.example", "", "1.2.3.4"]
    lines = lines_of(spark, *texts).withColumn("source_ip", F.lit("10.9.9.9"))
    for options in (OPTIONS, MaskOptions(salt="s", patterns={"ipv4": False}), MaskOptions(salt="s", enabled=False)):
        plain = mask.masked_actor(mask.mask_hashed(lines, options), options)
        short = mask.masked_actor(mask.mask_hashed(lines, options, address="_a"), options, "_a")
        assert sorted(plain.select("seq", "actor").collect()) == sorted(short.select("seq", "actor").collect())
        assert sorted(mask.actor_dictionary(plain).collect()) == sorted(mask.actor_dictionary(short, "_a").collect())
    assert set(short.columns) == {*plain.columns, "_a"}
