"""Incidents on small tables: which findings are one problem, what caused what, who plays which role; paths of exact depth, with cycles."""

import pytest
from pyspark.sql import functions as F

from stagelens.operators import graph, incidents

H = 3_600_000
FINDING = "finding_id string, category string, severity int, ts long, context string, stage_id long, stage_attempt long, executor_id string, sql_execution_id long, run_key string, entity string, evidence string, signal string, fingerprint string"
STAGE = "context string, stage_id long, stage_attempt long, sql_execution_id long, start_ms long, end_ms long, stage_name string"
EXECUTOR = "context string, executor_id string, host string, added_ms long, removed_ms long"
TASK = "context string, stage_id long, stage_attempt long, executor_id string, launch_ms long, finish_ms long"
LINE = "signal string, line string, ts long, context string, executor_id string"
ERROR = "fingerprint string, message string, ts long, context string, executor_id string, source string, user_frame string"


def finding(ident, category, ts, severity=0, context="c", **more):
    return {"finding_id": ident, "category": category, "ts": ts, "severity": severity, "context": context, "evidence": ""} | more


def stage(ident, attempt=0, query=None, start=0, end=None, name=None):
    return {"context": "c", "stage_id": ident, "stage_attempt": attempt, "sql_execution_id": query, "start_ms": start, "end_ms": end, "stage_name": name or f"stage {ident}"}


def executor(ident):
    return {"context": "c", "executor_id": ident, "host": f"10.0.0.{ident}", "added_ms": 0, "removed_ms": None}


@pytest.fixture(scope="module")
def build(spark):
    def frame(rows, schema):
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def run(findings, stages=(), executors=(), tasks=(), lines=(), errors=()):
        parts = [frame(r, s) for r, s in ((findings, FINDING), (stages, STAGE), (executors, EXECUTOR), (tasks, TASK), (lines, LINE), (errors, ERROR))]
        return {r["finding_id"]: r for r in incidents.build_incidents(*parts).collect()}

    return run


def test_a_failure_seen_three_ways_and_its_chain(build):
    """The removal, the log line and the exception are one problem; the lost files fail a fetch, which fails the stage and the query."""
    rows = build(
        [
            finding("F1", "executor_oom", H, executor_id="1"), finding("F2", "exception", H + 800, entity="java.lang.OutOfMemoryError", fingerprint="a", executor_id="1"), finding("F3", "log:executor_oom", H + 900, signal="executor_oom", context=None),
            finding("F4", "log:fetch_failure", H + 60_000, evidence="Failed to connect to host-1/10.0.0.1:4048 in stage 6.0"), finding("F5", "stage_failed", H + 61_000, stage_id=6, stage_attempt=0, evidence="fetch failed"),
            finding("F6", "query_failed", H + 62_000, sql_execution_id=3, evidence="query failed"), finding("F7", "capacity_bound", H),
        ],
        [stage(6, 0, 3, H - 1000, H + 61_000)], [executor("1"), executor("2")], [{"context": "c", "stage_id": 6, "stage_attempt": 0, "executor_id": "1", "launch_ms": H - 900, "finish_ms": H + 100}],
        [{"signal": "executor_oom", "line": "OutOfMemory on executor 1", "ts": H + 900, "context": "c", "executor_id": "1"}], [{"fingerprint": "a", "message": "Java heap space", "ts": H + 800, "context": "c", "executor_id": "1", "source": "executor"}],
    )
    assert set(rows) == {"F1", "F2", "F3", "F4", "F5", "F6"}
    assert len({rows[f]["problem"] for f in ("F1", "F2", "F3")}) == 1 and sorted(rows[f]["role"] for f in ("F1", "F2", "F3")) == ["root", "same", "same"]
    lead = next(f for f in ("F1", "F2", "F3") if rows[f]["role"] == "root")
    assert rows["F4"]["caused_by"] == lead and rows["F4"]["confidence"] == "strong" and "shuffle files" in rows["F4"]["because"]
    assert rows["F5"]["caused_by"] == "F4" and rows["F6"]["caused_by"] == "F5" and {rows[f]["role"] for f in ("F4", "F5", "F6")} == {"effect"}
    assert {r["rank"] for r in rows.values()} == {1} and rows["F6"]["title"] == "Query 3 failed"


def test_what_is_one_problem_and_what_is_no_cause(build):
    """Three contexts in one build: two errors on one executor stay two; a wrapper and the error in it, within two seconds on an executor or both on the driver, are one; a fetch
    failure that names another host, and a loss half an hour before on the executor alone, have no cause."""
    error = {"executor_id": "0", "context": "c", "source": "executor"}
    rows = build(
        [
            finding("A1", "exception", H, entity="ValueError", fingerprint="a", executor_id="0"), finding("A2", "exception", 6 * H, entity="KeyError", fingerprint="b", executor_id="0"),
            finding("B1", "log:python_error", H, context="d", executor_id="4"), finding("B2", "log:other", H + 1500, context="d", executor_id="4"), finding("B3", "log:other", 3 * H, context="d"), finding("B4", "log:another", 3 * H + 1999, context="d"), finding("B5", "log:other", 5 * H, context="d"),
            finding("C1", "executor_lost", H, context="e", executor_id="1"), finding("C2", "log:fetch_failure", H + 1000, context="e", evidence="Failed to connect to /10.0.0.9:77, executor 1"), finding("C3", "executor_lost", 2 * H, context="e", executor_id="3"), finding("C4", "task_retries", 3 * H, 1, context="e", executor_id="3"),
        ],
        executors=[executor("0"), executor("4") | {"context": "d"}, executor("1") | {"context": "e"}, executor("3") | {"context": "e"}],
        errors=[error | {"fingerprint": "a", "message": "invalid literal", "ts": H, "user_frame": "x.py 1"}, error | {"fingerprint": "b", "message": "KeyError: k", "ts": 6 * H, "user_frame": "y.py 9"}],
    )
    assert rows["A1"]["problem"] != rows["A2"]["problem"] and rows["A2"]["role"] != "same" and rows["A1"]["kind"] == rows["A2"]["kind"] == "error in task code"
    assert rows["B1"]["problem"] == rows["B2"]["problem"] and rows["B3"]["problem"] == rows["B4"]["problem"]
    assert len({rows[f"B{i}"]["problem"] for i in range(1, 6)}) == 3 and rows["B5"]["kind"] == "other"
    assert all(rows[f"C{i}"]["caused_by"] is None for i in range(1, 5)) and len({rows[f"C{i}"]["incident"] for i in range(1, 5)}) == 4


def test_a_signal_of_many_lines_bridges_nothing(build):
    lines = [{"signal": "executor_lost", "line": "Lost executor 2 on 10.0.0.2", "ts": H}, {"signal": "executor_lost", "line": "Lost executor 5 on 10.0.0.5", "ts": 8 * H}, {"signal": "executor_lost", "line": "Lost executor 5 again", "ts": 8 * H + 10}]
    rows = build(
        [
            finding("F1", "executor_lost", H, executor_id="2"), finding("F2", "stage_failed", H + 500, stage_id=4, stage_attempt=0, evidence="Stage 4.0 failed: lost executor 2"),
            finding("F3", "executor_lost", 8 * H, executor_id="5"), finding("F4", "stage_failed", 8 * H + 500, stage_id=9, stage_attempt=0, evidence="Stage 9.0 failed: lost executor 5"), finding("F5", "log:executor_lost", H, signal="executor_lost", context=None),
        ],
        [stage(4, 0, 1, H - 1000, H + 1000), stage(9, 0, 7, 8 * H - 1000, 8 * H + 1000)], [executor("2"), executor("5")], lines=lines,
    )
    assert rows["F2"]["incident"] != rows["F4"]["incident"] and rows["F4"]["caused_by"] in ("F3", "F5") and rows["F2"]["caused_by"] == "F1"
    assert rows["F5"]["problem"] == rows["F3"]["problem"]  # most of its lines


def test_one_querys_slow_stages_and_a_mere_report(build):
    rows = build(
        [
            finding("F1", "task_skew", H, 1, stage_id=1, stage_attempt=0), finding("F2", "disk_spill", H + 5, 1, stage_id=2, stage_attempt=0), finding("F3", "executor_oom", 9 * H, executor_id="1"),
            finding("F4", "exception", 20 * H, entity="py4j.protocol.Py4JJavaError", fingerprint="p", context=None),
        ],
        [stage(1, 0, 0, 0, H), stage(2, 0, 0, 0, H)], [executor("1")], errors=[{"fingerprint": "p", "message": "An error occurred while calling o1.collect.", "ts": 20 * H, "source": "driver"}],
    )
    assert rows["F1"]["incident"] == rows["F2"]["incident"] and rows["F1"]["title"].startswith("Query 0 ran slow")
    assert rows["F3"]["rank"] == 1 and rows["F4"]["rank"] == 2 and rows["F4"]["kind"] == "error reported to the notebook / job"


def test_hot_scope_gives_one_candidate_a_kind(spark):
    """A thousand problems of one stage: an effect gets the last cause of each kind, and no more rows than kinds."""
    n = 1000
    problems = spark.range(n).select(F.concat(F.lit("p"), F.lpad("id", 4, "0")).alias("problem"), F.when(F.col("id") % 2 == 0, "fetch").otherwise("retries").alias("kind"), F.lit("x").alias("label"), F.when(F.col("id") % 2 == 0, 5).otherwise(6).alias("level"), (F.col("id") * 10_000).alias("ts"), (F.col("id") * 10_000).alias("until"), F.lit(1).alias("severity"), F.lit("f").alias("lead"), F.lit(1).alias("n"))
    about = problems.select("problem", F.lit("stage").alias("type"), F.lit("c|1|0").alias("key"), F.lit(False).alias("inferred"))
    tasks, stages = spark.createDataFrame([], TASK), spark.createDataFrame([], STAGE)
    got = {r["effect"]: r["cause"] for r in incidents.best_links(problems, about, tasks, stages).collect()}
    assert got == {f"p{i:04d}": f"p{i - 1:04d}" for i in range(1, n, 2)}


def test_empty(build):
    assert build([]) == {}


@pytest.mark.parametrize("depth", [1, 7, 10, None])
def test_paths_of_exact_depth(spark, depth):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "e long, c long")
    got = {r["e"]: (r["root"], r["steps"], list(r["path"])) for r in graph.follow_paths(chain, "e", "c", depth).collect()}
    reach = lambda i: min(30, i + (depth or 99))
    assert got == {i: (reach(i), reach(i) - i, list(range(i, reach(i) + 1))) for i in range(30)}


def test_cycles_end_at_their_least_node(spark):
    edges = [(1, 2), (2, 1), (7, 5), (5, 6), (6, 5), (8, 7), (9, 9), (10, 11), (20, 1)]
    got = {r["e"]: r["root"] for r in graph.follow_roots(spark.createDataFrame(edges, "e long, c long"), "e", "c", depth=50).collect()}
    assert got == {2: 1, 7: 5, 6: 5, 8: 5, 10: 11, 20: 1}
