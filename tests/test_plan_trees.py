"""Plans as rows at any depth, headline metrics by their rules, and work that only a replan ended."""

import json

from pyspark.sql import functions as F

from stagelens.functions import plan_text
from stagelens.plans import tree
from stagelens.sources import eventlog


def node(name, *children, metrics=()):
    return {"nodeName": name, "simpleString": f"{name} x", "children": list(children), "metadata": {}, "metrics": list(metrics)}


def test_plans_of_any_depth(spark):
    deep = node("leaf")
    for i in range(3 * tree.LEVELS + 1):
        deep = node(f"n{i}", *([node("side")] if i % 5 == 0 else []), deep)
    wide = node("root", *[node(f"c{i}", node(f"d{i}")) for i in range(12)])
    plans = {1: json.dumps(deep), 2: json.dumps(wide), 3: json.dumps(node("alone")), 4: None, 5: "not json"}
    want = []
    for key, text in plans.items():
        if key < 4:
            stack, n = [(json.loads(text), None)], 0
            while stack:
                x, up = stack.pop()
                want.append((key, n, up, x["nodeName"], x["simpleString"]))
                stack += [(c, n) for c in reversed(x["children"])]
                n += 1
    got = tree.plan_nodes(spark.createDataFrame(list(plans.items()), "k long, plan string"), ["k"], "plan")
    assert sorted(tuple(r) for r in got.drop("metrics").collect()) == sorted(want)


def test_headline_rules(spark):
    rows = [
        (1, "scan time", "timing", 5), (1, "metadata time", "nsTiming", 7_000_000), (1, "number of output rows", "sum", 4), (1, "number of output rows", "sum", 6),
        (2, "duration", "timing", 9), (2, "sort time", "timing", 100), (2, "peak memory", "size", 11), (2, "peak memory total", "size", 30), (2, "spill size", "size", 2), (2, "local spill size", "size", 3),
        (3, "size of files read", "size", 8), (3, "data size", "size", 5), (4, "other", "sum", 1),
    ]
    got = tree.headline(spark.createDataFrame([("c", *r) for r in rows], "k string, node_id long, metric string, type string, value long"), ["k"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 10, 12.0, None, None, None), (2, None, 9.0, 30, 5, None), (3, None, None, None, None, 5), (4, None, None, None, None, None)]


def test_replans_are_no_failures(spark):
    said = "Stage cancelled: Adaptive Query Execution has replanned the query"
    rows = [("TaskKilled", said, True), ("TaskKilled", "another attempt succeeded", False), ("ExceptionFailure", said, False), ("TaskKilled", None, False)]
    df = spark.createDataFrame(rows, "reason string, text string, want boolean")
    assert df.filter(eventlog.replan_kill(F.col("reason"), F.col("text")) != F.col("want")).count() == 0


def events(spark, tmp_path, *rows):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "app-1").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return eventlog.events(eventlog.lines(spark, str(tmp_path / "log")))


def test_replanned_tasks_jobs_and_stages(spark, tmp_path):
    said = "Adaptive query execution has replanned the query and cancelled this stage"
    task = lambda i, reason: {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Stage Attempt ID": 0, "Task End Reason": reason, "Task Info": {"Task ID": i, "Index": i, "Attempt": 0, "Launch Time": 1, "Finish Time": 2, "Executor ID": "1"}}
    stage = lambda i, why: {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": i, "Stage Attempt ID": 0, "Stage Name": "s", "Number of Tasks": 1, "Submission Time": 1, "Completion Time": 2, "Accumulables": [{"ID": 1, "Name": "cloud storage response size", "Value": i * 10}, {"ID": 2, "Name": "cloud storage response size", "Value": "5"}, {"ID": 3, "Name": "cache hits size", "Value": "many"}]} | ({"Failure Reason": why} if why else {})}
    job = lambda i, result: [{"Event": "SparkListenerJobStart", "Job ID": i, "Submission Time": 1, "Stage IDs": [i]}, {"Event": "SparkListenerJobEnd", "Job ID": i, "Completion Time": 2, "Job Result": result}]
    failed = lambda text: {"Result": "JobFailed", "Exception": {"Message": text}}
    ev = events(
        spark, tmp_path, {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "App Name": "a", "Timestamp": 1},
        task(1, {"Reason": "Success"}), task(2, {"Reason": "TaskKilled", "Kill Reason": said}), task(3, {"Reason": "TaskKilled", "Kill Reason": "another attempt succeeded"}),
        stage(1, None), stage(2, said), stage(3, "Job aborted"), *job(1, {"Result": "JobSucceeded"}), *job(2, failed(said)), *job(3, failed("boom")),
    )
    assert {r["task_id"]: r["failed"] for r in eventlog.tasks(ev).collect()} == {1: False, 2: False, 3: True}
    assert {r["stage_id"]: r["status"] for r in eventlog.stages(ev).collect()} == {1: "succeeded", 2: "replanned", 3: "failed"}
    assert {r["stage_id"]: (r["cloud_bytes"], r["disk_cache_bytes"]) for r in eventlog.stages(ev).collect()} == {i: (10 * i + 5, None) for i in (1, 2, 3)}
    assert {r["job_id"]: (r["result"], r["status"]) for r in eventlog.jobs(ev).collect()} == {1: ("JobSucceeded", "succeeded"), 2: ("JobReplanned", "replanned"), 3: ("JobFailed", "failed")}


def test_ranking_windows_of_real_plans(spark):
    """Plans that Spark itself prints: keys with commas in brackets, ranks with and without a limit, ties."""
    spark.range(20).selectExpr("id AS a", "id % 3 AS b", "CAST(id AS STRING) AS c").createOrReplaceTempView("ranked")
    facts = {}
    for name, sql in {
        "first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(a, b), b ORDER BY c DESC) AS rn FROM ranked) WHERE rn = 1", "ties": "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY b ORDER BY a, c) AS r FROM ranked) WHERE r < 2",
        "top3": "SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY b ORDER BY a) AS r FROM ranked) WHERE r <= 3", "all": "SELECT *, row_number() OVER (ORDER BY a) AS rn FROM ranked", "none": "SELECT count(*) FROM ranked",
    }.items():
        text = spark.sql(sql)._jdf.queryExecution().executedPlan().toString()
        facts[name] = [tuple(w) for w in spark.createDataFrame([(text,)], "plan string").select(plan_text.ranking_windows(F.col("plan")).alias("w")).first()["w"]]
    short = {k: [(w[0], len(w[1]), [x.split(" ")[0] for x in w[2]], w[4], w[5]) for w in v] for k, v in facts.items()}
    assert short["ties"] == [("rank", 1, ["a", "c"], 1, True)] and short["top3"] == [("dense_rank", 1, ["a"], 3, False)]
    assert short["first"][0][0] == "row_number" and short["first"][0][1] == 2 and short["first"][0][3:] == (1, False)
    assert short["all"] == [("row_number", 0, ["a"], None, False)] and short["none"] == []


def test_arguments(spark):
    cases = {"a, f(b, c), [d, e]": ["a", "f(b, c)", "[d, e]"], "a#1, g(h(x, y), z)) AS w, q": ["a#1", "g(h(x, y), z)"], "": [], "one": ["one"]}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", plan_text.arguments(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == cases


def test_plans_take_one_pass_and_metrics_one_join(spark):
    """Plans are neither written nor read again (they were), totals of tasks and driver are joined at once (two joins before); odd plans leave the others alone."""
    metrics = [{"name": f"m{i}", "accumulatorId": i, "metricType": "sum"} for i in range(1, 5)]
    plans = {1: json.dumps(node("a", node("b", metrics=metrics))), 2: '{"nodeName": 5, "simpleString": null, "children": [7, {"nodeName": "é"}]}', 3: '{"nodeName": "cut', 4: '{"nodeName": "x", "children": "none"}'}
    nodes = tree.plan_nodes(spark.createDataFrame([("c", *p) for p in plans.items()], "context string, k long, plan string"), ["context", "k"], "plan")
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString().lower()
    assert "parquet" not in shown(nodes)
    assert sorted((r["k"], r["node_id"], r["parent_id"], r["name"]) for r in nodes.filter("k > 1").collect()) == [(2, 0, None, "5"), (2, 1, 0, None), (2, 2, 0, "é"), (4, 0, None, "x")]
    added = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "context string, accumulator long, total long")
    got = tree.node_metrics(nodes, ["context", "k"], added((1, 5), (1, 6), (3, 1)), added((2, 7), (3, 2)))
    assert shown(got).split("== initial plan ==")[0].count("leftouter") == 1
    assert {r["metric"]: r["value"] for r in got.collect()} == {"m1": 11, "m2": 7, "m3": 3, "m4": None}
