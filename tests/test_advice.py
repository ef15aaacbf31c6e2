"""Advice on settings: each rule at its edge, and the order."""

import pytest

from stagelens.plans import advice as AD

MB, GB, MINUTE = AD.MB, AD.GB, 60_000
STAGE = "context string, stage_id long, stage_attempt long, tasks long, shuffle_read long, input_bytes long, input_records long, df_cache_bytes long, wmed_bytes long, p50_bytes long, max_bytes long, p50_task_ms long, max_task_ms long, disk_spill long, first_ms long, end_ms long, duration_ms long"
RUN, EXECUTOR = "context string, run_key string, start_ms long, end_ms long, status string", "context string, executor_id string, cores int, added_ms long, removed_ms long, removal_category string"
QUERY = "context string, run_key string, duration_ms long, input_bytes long, shuffle_read long, engine_share double, tables_read array<string>, tables_written array<string>"
FOUND, USE = "context string, category string, severity int, cost_ms long", "context string, core_ms_up long, core_ms_used long, cores long"


@pytest.fixture
def advise(spark):
    def go(stages=(), settings=(), queries=(), runs=(), executors=(), findings=(), compute=()):
        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        out = AD.advice(make(stages, STAGE), make(settings, "context string, setting string, value string"), make(queries, QUERY), make(runs, RUN), make(executors, EXECUTOR), make(findings, FOUND), make(compute, USE))
        by = {}
        for r in sorted(out.collect(), key=lambda r: (r["context"], r["rank"])):
            by.setdefault(r["context"], []).append((r["rule"], r["severity"], r["n"], r["suggest"], r["cost_ms"], r["also"]))
        return by

    return go


def stage(i, **over):
    row = dict(context="c", stage_id=i, stage_attempt=0, tasks=200, shuffle_read=0, input_bytes=0, input_records=0, df_cache_bytes=0, wmed_bytes=0, p50_bytes=0, max_bytes=0, p50_task_ms=10, max_task_ms=20, disk_spill=0, first_ms=0, end_ms=100, duration_ms=110)
    return tuple((row | over).values())


def test_rules_over_stages(advise):
    stages = [
        stage(1, shuffle_read=300 * GB, wmed_bytes=128 * MB, disk_spill=GB), stage(2, shuffle_read=GB, wmed_bytes=128 * MB - 1), stage(3, tasks=199, shuffle_read=GB, wmed_bytes=GB),
        stage(4, input_bytes=GB, wmed_bytes=256 * MB), stage(5, input_bytes=GB, wmed_bytes=256 * MB, df_cache_bytes=GB), stage(6, p50_bytes=MB, max_bytes=256 * MB, max_task_ms=300_000, p50_task_ms=30_000),
        stage(7, p50_bytes=9, max_bytes=17, max_task_ms=300_000, p50_task_ms=30_000), stage(8, input_records=5, max_task_ms=300_000, p50_task_ms=30_000), stage(9, shuffle_read=None, max_bytes=None),
    ]
    got = advise([*stages, ("auto", *stages[0][1:])], [("c", AD.SKEW_JOIN, "false"), ("auto", AD.PARTITIONS, "auto"), ("auto", AD.ADAPTIVE, "False"), ("auto", AD.MASTER, "local[2]")])
    assert got["c"] == [("too few shuffle partitions", 0, 1, 2400, 110, 0), ("spill", 1, 1, None, 100, 0), ("skew joins are not split", 0, 1, None, None, 0), ("files cannot be split", 1, 1, None, None, 0), ("slow tasks without more data", 2, 1, None, None, 0)]
    assert [r[:2] for r in got["auto"]] == [("spill", 1), ("adaptive execution is off", 2)]


def test_bursts_and_sharing_join_the_wait_for_cores(advise):
    runs = [("c", f"r{i}", i * MINUTE, i * MINUTE + 10 * MINUTE, "failed" if i == 2 else "succeeded") for i in range(6)]
    up = [("c", "1", 4, 0, None, None), ("c", "2", 4, -5, 0, "autoscale"), ("c", "3", 8, MINUTE, None, None)]
    all_runs = [(c, *r[1:]) for c in ("burst", "waited") for r in runs] + [("apart", *r[1:2], i * 3 * MINUTE, i * 3 * MINUTE + 1, r[4]) for i, r in enumerate(runs)]
    found = [("waited", "cores_full", 1, 60 * MINUTE), ("waited", "core_hog", 0, 5 * MINUTE), ("waited", "dataframe_cache", 2, 1), ("fair", "core_hog", 0, 5), ("fair", "merge_rewrite", 1, 2), ("fair", "count_only", 1, 9)]
    got = advise(runs=all_runs, executors=[(c, *e[1:]) for c in ("burst", "waited") for e in up], settings=[("fair", AD.SCHEDULER, "FAIR")], findings=found)
    assert got["burst"] == [("burst of starts", 0, 6, None, None, 0), ("runs share the executors", 2, 6, None, None, 0)]
    assert got["waited"] == [("cache larger than memory", 2, 1, None, 1, 0), ("fifo stage", 0, 1, None, 5 * MINUTE, 0), ("runs waited for cores", 0, 1, None, 15 * MINUTE, 2)]
    assert [r[0] for r in got["fair"]] == ["merge reads more than it merges", "counts run the query again"]
    assert "apart" not in got


def test_lookups_engine_and_idle_executors(advise):
    queries = [("c", f"r{i}", 30_000, 2 * GB, 8 * GB if i == 0 else 0, None, ["small", "small", "log/_delta_log", "out"], ["out"] if i == 0 else []) for i in range(5)]
    few = [("few", *q[1:]) for q in queries[:4]]
    got = advise(queries=queries + few, settings=[("c", "x", "y"), ("few", AD.ENGINE, "photon")], compute=[("c", 1000, 700, 2), ("few", 1000, 701, 2)])
    assert got == {"c": [("executors ran nothing", 1, 2, None, 150, 0), ("lookup read again", 2, 5, None, None, 0), ("vectorised engine not used", 2, 1, None, None, 0)]}


def test_no_rows(advise):
    assert advise() == {}
