"""Logs and event logs that are written here, the latter by a real Spark run."""

import gzip
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stagelens.functions.text import Signal
from stagelens.sources import eventlog, logs
from stagelens.streaming import jobs

RUN = """
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").appName("logged").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://{0}").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").config("spark.ui.enabled", "false").getOrCreate()
s.range(1000).groupBy(F.col("id") % 7).count().collect()
s.range(10).count()
s.stop()
"""


@pytest.fixture(scope="module")
def event_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    subprocess.run([sys.executable, "-c", RUN.format(d)], check=True, capture_output=True, timeout=300)
    return str(d)


def test_event_log(spark, event_dir):
    lines = eventlog.lines(spark, event_dir).persist()
    ev = eventlog.events(lines).persist()
    tasks = eventlog.tasks(ev)
    assert tasks.count() > 2 and tasks.filter("failed").count() == 0 and tasks.filter("task_ms < 0 OR run_ms IS NULL").count() == 0
    stages = eventlog.stages(ev)
    assert stages.filter("end_time IS NULL").count() == 0 and stages.count() == stages.select("stage_id", "stage_attempt").distinct().count()
    assert {r["status"] for r in eventlog.jobs(ev).collect()} == {"succeeded"}
    q = eventlog.queries(ev)
    assert q.count() == 2 and q.filter("final_plan IS NULL AND initial_plan IS NULL").count() == 0
    app = eventlog.apps(ev).first()
    assert app["app_name"] == "logged" and app["start_time"] <= app["end_time"]
    counts = {r["kind"]: (r["n"], r["malformed"]) for r in eventlog.event_counts(lines).collect()}
    assert counts["TaskEnd"][0] == tasks.count() and counts["TaskEnd"][1] == 0
    assert eventlog.settings(ev).filter("setting = 'spark.app.name'").first()["value"] == "logged"
    assert eventlog.metric_totals(tasks).count() > 0


def test_malformed_event(spark, tmp_path):
    (tmp_path / "log").write_text('{"Event":"SparkListenerTaskEnd","Stage ID":1}\n{"Event":"SparkListenerTaskEnd", broken\n{"Event":"SparkListenerOther"}\nnoise\n')
    lines = eventlog.lines(spark, str(tmp_path))
    assert eventlog.tasks(eventlog.events(lines)).count() == 1
    assert sorted(tuple(r)[1:] for r in eventlog.event_counts(lines).collect()) == [("Other", 1, 0), ("TaskEnd", 2, 1)]


@pytest.fixture
def log_dir(tmp_path):
    d = tmp_path / "driver"
    d.mkdir()
    with gzip.open(d / "log4j-2024-01-01-00.log.gz", "wt") as f:
        f.write("24/01/01 00:00:00 INFO a.B: one\n")
    (d / "log4j-active.log").write_text("24/01/01 01:00:00 ERROR a.B: java.lang.OutOfMemoryError: heap\r\njava.lang.OutOfMemoryError: heap\n\tat org.apache.x(Y.java:1)\n\tat my.app(Z.java:2)\n24/01/01 01:00:01 INFO a.B: later\n")
    return str(tmp_path)


def test_log_lines(spark, log_dir):
    raw = logs.lines(spark, log_dir)
    assert [(r["seq"], r["line"][:9]) for r in raw.orderBy("seq").collect()][:2] == [(1, "24/01/01 "), (2, "24/01/01 ")]
    ll = logs.log_lines(raw).persist()
    rows = {r["seq"]: r for r in ll.collect()}
    assert rows[2]["level"] == rows[3]["level"] == rows[5]["level"] == "ERROR" and rows[3]["continuation"] and not rows[2]["continuation"]
    assert rows[4]["ts"] == rows[2]["ts"] and rows[2]["source"] == "driver" and not rows[2]["line"].endswith("\r")
    found = logs.signals(ll, [Signal("oom", "java.lang.OutOfMemoryError", "high")])
    assert found.count() == 2
    e = logs.errors(ll).orderBy("seq").collect()  # the logged line names the exception, the next one opens the trace
    assert [x["seq"] for x in e] == [2, 3] and e[0]["frames"] == [] and e[1]["user_frame"] == "at my.app(Z.java:2)" and len(e[1]["frames"]) == 2
    assert logs.catalogue(spark, log_dir).filter("top = 'driver'").count() == 2


def test_conform_and_write(spark, tmp_path):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    schema = StructType().add("a", LongType()).add("b", DoubleType()).add("cluster_id", StringType())
    df = spark.createDataFrame([(1, float("nan"), "extra")], "a int, b double, x string").withColumn("cluster_id", F.lit("c"))
    logs.write_table(df, str(tmp_path / "t"), schema)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("a", "b", "cluster_id").collect()] == [(1, None, "c")]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("minutes", jobs.signals_per_minute(stream, "ts", ["event_type"])), ("busy", jobs.busy_stretches(stream, "ts", ["user_id"], "2 hours")), ("once", jobs.first_fingerprints(stream, "ts", "event_type")), ("last", jobs.latest_per_key(stream, "ts", ["user_id"], "value"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert spark.table(name).count() > 0


def test_views(spark, event_dir):
    from stagelens.operators import findings as FI
    from stagelens.plans import views as V

    ev = eventlog.events(eventlog.lines(spark, event_dir)).persist()
    tasks, stages, jobs_, queries, executors = (f(ev).persist() for f in (eventlog.tasks, eventlog.stages, eventlog.jobs, eventlog.queries, eventlog.executors))
    table = V.stage_table(tasks, stages).persist()
    ran = table.filter("tasks IS NOT NULL")
    assert ran.agg(F.sum("tasks")).first()[0] == tasks.count() and ran.filter("skew < 1 AND max_task_ms > 0").count() == 0
    assert V.stage_jobs(jobs_).groupBy("context", "stage_id").count().filter("count > 1").count() == 0
    assert V.dag_edges(stages).filter("parent >= child").count() == 0
    shares = V.stage_executors(tasks).groupBy(*V.STAGE).agg(F.sum("share").alias("s"), F.sum("task_ms").alias("t")).filter("t > 0").collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares)
    assert V.executor_profile(tasks, executors).filter("busy_ms IS NULL AND tasks > 0").count() == 0
    assert V.placement(tasks).count() == V.stage_executors(tasks).count()
    facts = V.query_facts(queries).persist()
    assert {"HashAggregate", "Range"} <= {o for r in facts.collect() for o in r["operators"]}
    assert V.engine_summary(facts).first()["adaptive"] == 2
    assert facts.filter("count_only").count() == 1
    assert V.runs(jobs_).first()["status"] == "succeeded"
    assert V.waiting(table, ["context"]).filter("run_ms > 0").count() == 1
    assert FI.detect(table, FI.stage_rules(FI.Thresholds()), F.col("stage_id")).count() == 0
    assert FI.stage_flags(table, FI.Thresholds()).filter("failed OR spill").count() == 0
    assert {r["kind"]: r["missing"] for r in V.coverage({"tasks": tasks, "none": tasks.limit(0)}).collect()} == {"tasks": False, "none": True}
    assert V.spill_markers(V.spill_shuffle_timeline(tasks)).count() == 0 and V.peak_buckets(tasks, "task_ms").count() >= 1
    assert V.skewed_tasks(tasks, table, floor_ms=0, ratio=1.0).filter("rank > 5").count() == 0
    for df in (V.table_reads(facts), V.micro_batches(queries), V.core_use(tasks, executors), V.reuse_edges(jobs_), V.settings_merge(eventlog.settings(ev), eventlog.settings(ev), eventlog.settings(ev).limit(0)), V.story([(queries.select(F.col("start_time").alias("at"), F.col("description").alias("text")), "query")])):
        df.collect()


def test_plan_text(spark):
    from stagelens.functions import plan_text as P

    plan = "AdaptiveSparkPlan isFinalPlan=true\n+- *(2) HashAggregate(keys=[], functions=[count(1)])\n   +- Exchange SinglePartition\n      +- FileScan parquet cat.db.sales[a#1]\n   +- Scan JDBCRelation((select count(*) from t) x) [numPartitions=1] [a]"
    df = spark.createDataFrame([(plan,)], "p string")
    r = df.select(P.operators(F.col("p")).alias("o"), P.tables_read(F.col("p")).alias("t"), P.jdbc(F.col("p")).alias("j"), P.count_only(F.col("p")).alias("c")).first()
    assert r["o"] == ["Scan", "FileScan", "Exchange", "HashAggregate"] and r["t"] == ["cat.db.sales"] and r["j"]["kind"] == "count" and r["j"]["partitions"] == 1 and r["c"]


def test_more_views(spark, event_dir):
    from stagelens.plans import views as V

    ev = eventlog.events(eventlog.lines(spark, event_dir)).persist()
    tasks, stages, jobs_, queries = (f(ev).persist() for f in (eventlog.tasks, eventlog.stages, eventlog.jobs, eventlog.queries))
    table = V.stage_table(tasks, stages)
    links = V.stage_jobs(jobs_)
    one = V.totals(tasks, stages, jobs_, queries).first()
    assert one["tasks"] == tasks.count() and one["queries"] == 2 and one["failed_jobs"] == 0
    assert V.query_rollup(table, links.withColumnRenamed("job_id", "sql_execution_id")).agg(F.sum("stages")).first()[0] > 0
    assert V.grain_distribution(tasks, links, "job_id").agg(F.sum("n")).first()[0] == tasks.count()
    assert V.stage_times(tasks).filter("tail_ms < 0").count() == 0
    r = V.runs(jobs_)
    assert V.default_run(r).first()["run_key"].startswith("app:")
    assert V.retry_summary(tasks).count() == 0 and V.storage_split(tasks).count() > 0
    found = spark.createDataFrame([("skew", "e1", 1, 3.0, "app:x"), ("skew", "e2", 0, 1.0, "app:y")], "category string, entity string, severity int, measure double, run_key string")
    assert V.kinds_over_runs(found, r).first()["worst"] == "e2"
    assert V.top(tasks, "task_ms", ["task_id"], 3).count() == 3
    assert V.first_key(eventlog.settings(ev), "context", ["no.such", "spark.app.name"], "name").first()["source"] == "spark.app.name"
    assert tuple(V.scopes_of_text(spark.createDataFrame([("F1", "Stage 6.1 on executor 3")], "id string, t string"), "id", "t").first()) == ("F1", ["6"], ["3"])
    assert V.widened(r, r.select("run_key", "start_time", "end_time")).count() == r.count()
    fails = spark.createDataFrame([("1", "java.lang.OutOfMemoryError at TorrentBroadcast", 5)], "executor_id string, error string, t long").withColumn("finish_time", F.timestamp_millis("t"))
    errs = spark.createDataFrame([("1", 1, "java.lang.OutOfMemoryError", ["x.toPandas"]), ("2", 1, "java.lang.OutOfMemoryError", ["x.toPandas"])], "executor_id string, seq long, exception string, frames array<string>")
    assert sorted(map(tuple, V.oom_sites(fails, errs).collect())) == [("1", "broadcast"), ("2", "driver_result")]
    assert spark.range(1).select(V.stage_label(F.array(F.lit("Scan parquet"), F.lit("HashAggregate")))).first()[0] == "read, aggregate"
    dump = spark.createDataFrame([("f", 1, '"a" prio=5 tid=1', None), ("f", 2, "\tat x", None), ("f", 3, '"b" prio=5 tid=2', None), ("f", 4, "24/01/01 x", "log4j"), ("f", 5, '"c" prio=5 tid=3', None)], "file_path string, seq long, line string, kind string")
    assert V.thread_dumps(dump).first()["dumps"] == 2
    shared = spark.createDataFrame([("a", 5), (None, 6), ("b", 7)], "run_key string, at long")
    spans = spark.createDataFrame([("a", "ok", 1, 9), ("b", "ok", 20, 30)], "run_key string, status string, start_time long, end_time long")
    assert sorted(r["at"] for r in V.of_run(shared, spans, "a", "at").collect()) == [5, 6]


def test_rolled_event_log(spark, tmp_path):
    """Two files of one log are one application, read in the order in which they were written; Connect, driver and profile events have tables."""
    import json

    d = tmp_path / "eventlog_v2_app-1"
    d.mkdir()
    x = lambda kind, **more: json.dumps({"Event": f"SparkListener{kind}", **more})
    plan = lambda n: json.dumps({"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate", "executionId": 1, "physicalPlanDescription": f"plan {n}"})
    first = [
        x("JobStart", **{"Job ID": 7, "Submission Time": 1000, "Stage IDs": [1]}),
        json.dumps({"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 1, "rootExecutionId": 1, "description": "d", "time": 900, "physicalPlanDescription": "first"}), plan(2),
        json.dumps({"Event": "org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates", "executionId": 1, "accumUpdates": [[5, 70]]}),
        x("BlockManagerAdded", **{"Block Manager ID": {"Executor ID": "3", "Host": "h"}, "Maximum Memory": 99, "Timestamp": 5}), x("ResourceProfileAdded", **{"Resource Profile Id": 0, "Executor Resource Requests": {"cores": {"Amount": 4}}}),
        x("ConnectSessionStarted", sessionId="s", userName="ann"), x("ConnectOperationStarted", operationId="o", sessionId="s", statementText="SELECT 1", eventTime=10, jobTag="t"),
    ]
    (d / "events_2_app-1").write_text("\n".join(first) + "\n")
    (d / "events_10_app-1").write_text("\n".join([plan(10), x("JobEnd", **{"Job ID": 7, "Completion Time": 2000, "Job Result": {"Result": "JobSucceeded"}}), x("ConnectOperationFailed", operationId="o", sessionId="s", eventTime=30, errorMessage="no")]) + "\n")
    (tmp_path / "other-app.inprogress").write_text(x("JobStart", **{"Job ID": 1, "Submission Time": 5, "Stage IDs": []}) + "\n")
    ev = eventlog.events(eventlog.lines(spark, str(tmp_path))).persist()
    assert sorted(tuple(r) for r in eventlog.jobs(ev).select("context", "job_id", "status").collect()) == [("app-1", 7, "succeeded"), ("other-app", 1, "open")]
    assert eventlog.queries(ev).first()["final_plan"] == "plan 10"
    assert [tuple(r) for r in eventlog.driver_metrics(ev).collect()] == [("app-1", 1, 5, 70)]
    assert tuple(eventlog.block_managers(ev).select("executor_id", "storage_memory").first()) == ("3", 99)
    assert tuple(eventlog.resource_profiles(ev).first()) == ("app-1", 0, "cores", 4)
    o = eventlog.operations(ev).first()
    assert (o["status"], o["user"], o["statement"], o["Started_time"], o["Failed_time"], o["job_tag"]) == ("failed", "ann", "SELECT 1", 10, 30, "t")


def test_large_file_blocks(spark, tmp_path):
    """A file of several blocks is numbered through."""
    (tmp_path / "driver").mkdir()
    (tmp_path / "driver" / "log4j-active.log").write_text("".join(f"line {i:06d} {'x' * 60}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = logs.lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["seq"], r["line_no"], r["line"][5:11]) for r in rows] == [(i + 1, i + 1, f"{i:06d}") for i in range(4000)]
