from __future__ import annotations

from conftest import entries_of

from logwarden.operators import stats

BY = ["source_label"]


def test_sketches_merge_to_the_counts_of_all_rows(spark):
    rows = [{"path": "/a", "ip": f"10.0.{i % 40}.{i % 250}", "source": "ab"[i % 2]} for i in range(6000)]
    rows += [{"path": "/rare", "source": "a"}, {"path": "", "source": "a"}, {"path": "/a", "noise": True, "ip": "x"},
             {"path": "/none", "ip": None}]
    entries = entries_of(spark, rows)
    sketches = stats.path_sketches(entries, BY)
    assert {t for _, t in sketches.dtypes if t == "binary"} == {"binary"}
    merged = {r.path: r for r in stats.sketched_counts(stats.merged_sketches(sketches, ())).collect()}
    exact = {r.path: r for r in stats.path_stats(entries, ()).collect()}
    assert set(merged) == set(exact) == {"/a", "/rare", "/none"}
    for path in ("/a", "/rare"):
        assert abs(merged[path].n_ips - exact[path].n_ips) <= 0.02 * exact[path].n_ips
        assert (merged[path].request_count, merged[path].first_seq) == (exact[path].request_count, exact[path].first_seq)
    # a sketch holds no null: rows without an actor are counted as requests only
    assert (merged["/none"].n_ips, merged["/none"].request_count) == (0, 1)


def test_sketches_of_no_rows(spark):
    empty = stats.path_sketches(entries_of(spark, [{}]).where("false"), BY)
    assert stats.sketched_counts(stats.merged_sketches(empty, ())).count() == 0
