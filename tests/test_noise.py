from __future__ import annotations

import os

import pytest
from conftest import entries_of

from logwarden.operators import noise
from logwarden.options import NoiseOptions, Options

CASES = [
    ({"path": "/style.css"}, "static_asset"),
    ({"path": "/style.CSS?v=1"}, "static_asset"),
    ({"path": "/health"}, "health_check"),
    ({"path": "/health?x=1"}, None),
    ({"agent": "Googlebot/2.1"}, "known_bot"),
    ({"agent": "googlebot/2.1"}, None),
    ({"path": "/admin", "status": 403}, None),
    ({"path": "/ADMIN/x.css", "status": 403}, None),
    ({"path": "/admin.css"}, "static_asset"),
    ({"path": "/wp-login.php", "status": 404, "agent": "Googlebot"}, None),
    ({"path": "/.env", "status": 500}, None),
    ({"path": "/page", "status": 301}, None),
]


def test_reasons(spark):
    rows = noise.with_noise(entries_of(spark, [c for c, _ in CASES])).orderBy("seq").collect()
    assert [r.noise_reason for r in rows] == [want for _, want in CASES]
    assert all(r.is_noise == (r.noise_reason is not None) for r in rows)


def test_switches(spark):
    entries = entries_of(spark, [{"path": "/x.css"}, {"path": "/p", "status": 301},
                                 {"path": "/tiny", "size": 10}])
    off = noise.with_noise(entries, NoiseOptions(enabled=False))
    assert not any(r.is_noise for r in off.collect())
    wide = NoiseOptions(ignore_status_codes=(301,), small_get_below=50)
    found = [r.noise_reason for r in noise.with_noise(entries, wide).orderBy("seq").collect()]
    assert found == ["static_asset", "ignored_status", "small_get"]


def test_extension_is_splitext(spark):
    paths = ["/a.b", "/a.b.c", "/.env", "/..x", "/a.", "/a.b/c", "x", "", "/a.b/.c", "/a.b/c.d?e.f",
             "/...", "/.a.b", "/a..b", "a.B"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(noise.file_extension(df.path)).collect()]
    assert got == [os.path.splitext(p.split("?", 1)[0])[1].lower() for p in paths]


def test_overlay_of_options():
    options = Options().overlay({"rules": {"brute_force_threshold": 3},
                                 "mask": {"patterns": {"email": False}}})
    assert options.rules.brute_force_threshold == 3
    assert options.rules.path_fuzz_threshold == 5
    assert options.mask.patterns == {"email": False}
    with pytest.raises(KeyError):
        Options().overlay({"rulez": {}})
