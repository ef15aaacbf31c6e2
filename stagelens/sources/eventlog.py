"""Spark event logs as typed tables, read by schema: an event's name is taken by pattern first, and only wanted events are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.operators import aggregates as A
from stagelens.operators import joins as J
from stagelens.sources.logs import order_key

ACCUMULABLES = "Accumulables array<struct<ID: long, Name: string, Update: string, Value: string, Internal: boolean>>"
STAGE = f"struct<`Stage ID`: long, `Stage Attempt ID`: long, `Stage Name`: string, `Number of Tasks`: long, `Submission Time`: long, `Completion Time`: long, `Failure Reason`: string, `Parent IDs`: array<long>, `RDD Info`: array<struct<Name: string, Scope: string>>, {ACCUMULABLES.replace(' array', ': array', 1)}>"
#: The fields of all events that the tables need; a missing one is null.
EVENT = f"""Event string, Timestamp long, `Spark Version` string, `App Name` string, `App ID` string, User string,
`Stage ID` long, `Stage Attempt ID` long, `Task End Reason` struct<Reason: string, Description: string, `Loss Reason`: string, `Kill Reason`: string, Message: string, `Class Name`: string, `Full Stack Trace`: string, `Stack Trace`: array<struct<`Declaring Class`: string, `Method Name`: string>>>,
`Task Info` struct<`Task ID`: long, Index: long, Attempt: long, `Launch Time`: long, `Finish Time`: long, `Executor ID`: string, Host: string, Speculative: boolean, {ACCUMULABLES.replace(' array', ': array', 1)}>,
`Task Metrics` struct<`Executor Run Time`: long, `Executor CPU Time`: long, `JVM GC Time`: long, `Peak Execution Memory`: long, `Memory Bytes Spilled`: long, `Disk Bytes Spilled`: long, `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>, `Output Metrics`: struct<`Bytes Written`: long, `Records Written`: long>, `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long, `Fetch Wait Time`: long, `Total Records Read`: long>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long, `Shuffle Write Time`: long, `Shuffle Records Written`: long>>,
`Stage Info` {STAGE}, `Job ID` long, `Submission Time` long, `Completion Time` long, `Stage IDs` array<long>, Properties map<string, string>, `Job Result` struct<Result: string, Exception: struct<Message: string>>,
`Executor ID` string, `Executor Info` struct<Host: string, `Total Cores`: long>, `Removed Reason` string, executionId long, rootExecutionId long, description string, time long, errorMessage string, physicalPlanDescription string, `Spark Properties` map<string, string>,
accumUpdates array<array<long>>, `Block Manager ID` struct<`Executor ID`: string, Host: string>, `Maximum Memory` long, `Resource Profile Id` long, `Executor Resource Requests` map<string, struct<Amount: long>>,
jobTag string, operationId string, sessionId string, userId string, userName string, statementText string, eventTime long"""
#: What happens to a Connect operation, in order.
OPERATION_KINDS = ("Started", "Analyzed", "ReadyForExecution", "Finished", "Closed", "Failed", "Canceled")
#: Names of the files of one application's log, which stand in a folder of its own.
ROLLED = r"^(events_\d+_|eventlog)"
WANTED = ("TaskEnd", "StageCompleted", "StageSubmitted", "JobStart", "JobEnd", "ExecutorAdded", "ExecutorRemoved", "SQLExecutionStart", "SQLExecutionEnd", "SQLAdaptiveExecutionUpdate", "ApplicationStart", "ApplicationEnd", "EnvironmentUpdate", "LogStart", "DriverAccumUpdates", "BlockManagerAdded", "BlockManagerRemoved", "ResourceProfileAdded",
          *(f"ConnectOperation{k}" for k in OPERATION_KINDS), "ConnectSessionStarted", "ConnectSessionClosed")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """context, seq, kind (short event name, null if the line has none), line.

    A log of several rolled files is one application, named by their folder; another file is one by its own name. seq orders a context's lines: by file
    (rolled ones before the active one, numbers by value), block and place in it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
    name = F.nullif(F.regexp_extract("value", r'"Event"\s*:\s*"([^"]+)"', 1), F.lit(""))
    file = F.col("_metadata.file_path")
    parts = F.split(file, "/")
    own = F.regexp_replace(F.element_at(parts, -1), r"\.(gz|zstd|lz4|inprogress)$", "")
    folder = F.regexp_replace(F.element_at(parts, -2), r"^eventlog_v\d+_", "")
    seq = F.struct(order_key(file).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return raw.select(F.when(own.rlike(ROLLED), folder).otherwise(own).alias("context"), seq.alias("seq"), F.regexp_replace(F.element_at(F.split(name, r"\."), -1), "^SparkListener", "").alias("kind"), F.col("value").alias("line"))


def event_counts(lines: DataFrame) -> DataFrame:
    """context, kind, n, malformed: all events by name, and how many wanted ones do not parse."""
    bad = F.col("kind").isin(*WANTED) & F.from_json("line", "Event string, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    return lines.filter("kind IS NOT NULL").groupBy("context", "kind").agg(F.count("*").alias("n"), F.count_if(bad).alias("malformed"))


def events(lines: DataFrame) -> DataFrame:
    """context, seq, kind, e of wanted events that parse. The filter on the name comes before the parse."""
    wanted = lines.filter(F.col("kind").isin(*WANTED))
    return wanted.select("context", "seq", "kind", F.from_json("line", EVENT).alias("e")).filter(F.col("e.Event").isNotNull())


def _time(c: str) -> F.Column:
    return F.timestamp_millis(F.col(c))


# fixed values: what a replan says, and which accumulables say where a stage's input came from
REPLANNED = r"(?i)Adaptive query execution has replanned"
CLOUD_BYTES, DISK_CACHE_BYTES = "cloud storage response size", "cache hits size"
# end of fixed values


def replanned(text: F.Column) -> F.Column:
    """Whether a job, stage or task ended only because adaptive execution made a new plan."""
    return F.coalesce(text.rlike(REPLANNED), F.lit(False))


def replan_kill(reason: F.Column, text: F.Column) -> F.Column:
    return (reason == "TaskKilled") & replanned(text)


def tasks(ev: DataFrame) -> DataFrame:
    """One row a task attempt. A task that was killed as adaptive execution no longer needed its stage has not failed; its reason and text stay."""
    i, m, r = "e.`Task Info`", "e.`Task Metrics`", "e.`Task End Reason`"
    read, write = f"{m}.`Shuffle Read Metrics`", f"{m}.`Shuffle Write Metrics`"
    c = F.col
    error = F.coalesce(c(f"{r}.Description"), c(f"{r}.`Loss Reason`"), c(f"{r}.`Kill Reason`"), c(f"{r}.Message"))
    return ev.filter("kind = 'TaskEnd'").select(
        "context", c("e.`Stage ID`").alias("stage_id"), c("e.`Stage Attempt ID`").alias("stage_attempt"), c(f"{i}.`Task ID`").alias("task_id"), c(f"{i}.Index").alias("task_index"), c(f"{i}.Attempt").alias("task_attempt"),
        c(f"{i}.`Executor ID`").alias("executor_id"), c(f"{i}.Host").alias("host"), _time(f"{i}.`Launch Time`").alias("launch_time"), _time(f"{i}.`Finish Time`").alias("finish_time"), (c(f"{i}.`Finish Time`") - c(f"{i}.`Launch Time`")).alias("task_ms"),
        c(f"{m}.`Executor Run Time`").alias("run_ms"), F.floor(c(f"{m}.`Executor CPU Time`") / 1_000_000).alias("cpu_ms"), c(f"{m}.`JVM GC Time`").alias("gc_ms"), c(f"{read}.`Fetch Wait Time`").alias("fetch_wait_ms"), F.floor(c(f"{write}.`Shuffle Write Time`") / 1_000_000).alias("shuffle_write_ms"),
        c(f"{m}.`Peak Execution Memory`").alias("peak_mem"), c(f"{m}.`Memory Bytes Spilled`").alias("mem_spill"), c(f"{m}.`Disk Bytes Spilled`").alias("disk_spill"), c(f"{m}.`Input Metrics`.`Bytes Read`").alias("input_bytes"), c(f"{m}.`Input Metrics`.`Records Read`").alias("input_records"),
        c(f"{m}.`Output Metrics`.`Bytes Written`").alias("output_bytes"), (c(f"{read}.`Remote Bytes Read`") + c(f"{read}.`Local Bytes Read`")).alias("shuffle_read"), c(f"{write}.`Shuffle Bytes Written`").alias("shuffle_write"),
        c(f"{i}.Speculative").alias("speculative"), ((c(f"{r}.Reason") != "Success") & ~replan_kill(c(f"{r}.Reason"), error)).alias("failed"), c(f"{r}.Reason").alias("end_reason"), error.alias("error"),
        c(f"{i}.Accumulables").alias("accumulables"),
    )


def accumulated(name: str) -> F.Column:
    """The sum of a stage's accumulables of that name; null if it has none with a number."""
    values = F.filter(F.transform(F.filter("Accumulables", lambda a: a["Name"] == name), lambda a: a["Value"].try_cast("long")), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("long"), lambda x, v: x + v))


def stages(ev: DataFrame) -> DataFrame:
    """One row a stage attempt: submitted and completed paired, non-null values of the latter first."""
    s = ev.filter("kind IN ('StageSubmitted', 'StageCompleted')").select("context", "seq", "kind", "e.`Stage Info`.*")
    names = F.slice(F.array_distinct(F.transform("RDD Info", lambda x: x["Name"])), 1, 20)
    scopes = F.slice(F.array_distinct(F.transform("RDD Info", lambda x: F.get_json_object(x["Scope"], "$.name"))), 1, 20)
    s = s.select("context", "seq", "kind", F.col("Stage ID").alias("stage_id"), F.col("Stage Attempt ID").alias("stage_attempt"), F.col("Stage Name").alias("stage_name"), F.col("Number of Tasks").alias("n_tasks"), _time("`Submission Time`").alias("start_time"), _time("`Completion Time`").alias("end_time"), F.col("Failure Reason").alias("failure_reason"), F.sort_array(F.array_distinct("Parent IDs")).alias("parent_ids"), names.alias("rdd_names"), scopes.alias("rdd_scopes"), accumulated(CLOUD_BYTES).alias("cloud_bytes"), accumulated(DISK_CACHE_BYTES).alias("disk_cache_bytes"))
    pair = lambda k: s.filter(F.col("kind") == k).drop("kind")
    status = F.when(replanned(F.col("failure_reason")), "replanned").when(F.col("failure_reason").isNotNull(), "failed").when(F.col("end_time").isNotNull(), "succeeded").otherwise("open")
    return J.start_end(pair("StageSubmitted"), pair("StageCompleted"), ["context", "stage_id", "stage_attempt"], "seq").drop("seq").withColumn("status", status)


def jobs(ev: DataFrame) -> DataFrame:
    starts = ev.filter("kind = 'JobStart'").select("context", "seq", F.col("e.`Job ID`").alias("job_id"), _time("e.`Submission Time`").alias("start_time"), F.col("e.`Stage IDs`").alias("stage_ids"), F.col("e.Properties").alias("properties"))
    ends = ev.filter("kind = 'JobEnd'").select("context", "seq", F.col("e.`Job ID`").alias("job_id"), _time("e.`Completion Time`").alias("end_time"), F.col("e.`Job Result`.Result").alias("result"), F.col("e.`Job Result`.Exception.Message").alias("error"))
    out = J.start_end(starts, ends, ["context", "job_id"], "seq").drop("seq")
    result = F.when((F.col("result") == "JobFailed") & replanned(F.col("error")), "JobReplanned").otherwise(F.col("result"))
    out = out.withColumn("result", result)
    return out.withColumn("status", F.when(F.col("result") == "JobSucceeded", "succeeded").when(F.col("result") == "JobReplanned", "replanned").when(F.col("result").isNotNull(), "failed").otherwise("open"))


def queries(ev: DataFrame) -> DataFrame:
    """One row a SQL execution, with the last plan that adaptive execution gave."""
    keys = ["context", "sql_execution_id"]
    base = ev.select("context", "seq", "kind", F.col("e.executionId").alias("sql_execution_id"), F.col("e.rootExecutionId").alias("root_execution_id"), F.col("e.description").alias("description"), F.col("e.time").alias("__t"), F.col("e.errorMessage").alias("error"), F.col("e.physicalPlanDescription").alias("plan"))
    starts = base.filter("kind = 'SQLExecutionStart'").select(*keys, "seq", "root_execution_id", "description", _time("__t").alias("start_time"), F.col("plan").alias("initial_plan"))
    ends = base.filter("kind = 'SQLExecutionEnd'").select(*keys, "seq", _time("__t").alias("end_time"), F.nullif("error", F.lit("")).alias("error"))
    last = J.latest(base.filter("kind = 'SQLAdaptiveExecutionUpdate'"), keys, "seq", ["plan"]).withColumnRenamed("plan", "final_plan")
    out = J.start_end(starts, ends, keys, "seq").drop("seq").join(last, keys, "left")
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("end_time").isNotNull(), "succeeded").otherwise("open"))


def executors(ev: DataFrame) -> DataFrame:
    from stagelens.functions.text import removal_category

    keys = ["context", "executor_id"]
    base = ev.select("context", "seq", "kind", F.col("e.`Executor ID`").alias("executor_id"), _time("e.Timestamp").alias("at"), F.col("e.`Executor Info`").alias("i"), F.col("e.`Removed Reason`").alias("removed_reason"))
    added = base.filter("kind = 'ExecutorAdded'").select(*keys, "seq", F.col("i.Host").alias("host"), F.col("i.`Total Cores`").alias("cores"), F.col("at").alias("added_time"))
    gone = base.filter("kind = 'ExecutorRemoved'").select(*keys, "seq", F.col("at").alias("removed_time"), "removed_reason")
    return J.start_end(added, gone, keys, "seq").drop("seq").withColumn("removal_category", removal_category(F.col("removed_reason")))


def apps(ev: DataFrame) -> DataFrame:
    """One row a context: name, user, span (from its own events, else from any event's time)."""
    e = ev.withColumn("t", F.coalesce("e.Timestamp", "e.time", "e.`Task Info`.`Finish Time`", "e.`Submission Time`", "e.`Completion Time`"))
    when = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return e.groupBy("context").agg(when("ApplicationStart", "e.`App Name`").alias("app_name"), when("ApplicationStart", "e.User").alias("user"), F.timestamp_millis(F.coalesce(when("ApplicationStart", "t"), F.min("t"))).alias("start_time"), F.timestamp_millis(F.coalesce(when("ApplicationEnd", "t"), F.max("t"))).alias("end_time"))


def settings(ev: DataFrame) -> DataFrame:
    """context, setting, value."""
    return ev.filter("kind = 'EnvironmentUpdate'").select("context", F.explode("e.`Spark Properties`").alias("setting", "value"))


def metric_totals(task_rows: DataFrame) -> DataFrame:
    """context, stage_id, accumulator, name, total, most, tasks of numeric accumulables over successful tasks."""
    a = task_rows.filter(~F.col("failed")).select("context", "stage_id", F.explode("accumulables").alias("a"))
    n = F.col("a.Update").try_cast("long")
    return a.filter(n.isNotNull()).groupBy("context", "stage_id", F.col("a.ID").alias("accumulator"), F.col("a.Name").alias("name")).agg(F.sum(n).alias("total"), F.max(n).alias("most"), F.count("*").alias("tasks"))


def driver_metrics(ev: DataFrame) -> DataFrame:
    """context, sql_execution_id, accumulator, total: what the driver added to a query's metrics (the last value of each)."""
    u = ev.filter("kind = 'DriverAccumUpdates'").select("context", "seq", F.col("e.executionId").alias("sql_execution_id"), F.explode("e.accumUpdates").alias("u"))
    u = u.select("context", "seq", "sql_execution_id", F.get("u", F.lit(0)).alias("accumulator"), F.get("u", F.lit(1)).alias("total"))
    return J.latest(u, ["context", "sql_execution_id", "accumulator"], "seq", ["total"])


def block_managers(ev: DataFrame) -> DataFrame:
    """context, executor_id: host, storage memory and when it came and went."""
    b = ev.filter("kind IN ('BlockManagerAdded', 'BlockManagerRemoved')").select("context", "kind", F.col("e.`Block Manager ID`.`Executor ID`").alias("executor_id"), F.col("e.`Block Manager ID`.Host").alias("host"), F.col("e.`Maximum Memory`").alias("memory"), _time("e.Timestamp").alias("at"))
    when = lambda k: F.min(F.when(F.col("kind") == f"BlockManager{k}", F.col("at")))
    return b.groupBy("context", "executor_id").agg(F.max("host").alias("host"), F.max("memory").alias("storage_memory"), when("Added").alias("added_time"), when("Removed").alias("removed_time"))


def resource_profiles(ev: DataFrame) -> DataFrame:
    """context, profile, resource, amount."""
    p = ev.filter("kind = 'ResourceProfileAdded'").select("context", F.col("e.`Resource Profile Id`").alias("profile"), F.explode("e.`Executor Resource Requests`").alias("resource", "request"))
    return p.select("context", "profile", "resource", F.col("request.Amount").alias("amount"))


def operations(ev: DataFrame) -> DataFrame:
    """One row a Connect operation: its statement, session and user, the times of its events, and status: failed before canceled before finished before open."""
    c = ev.filter(F.col("kind").startswith("ConnectOperation"))
    c = c.select("context", "seq", F.col("e.operationId").alias("operation_id"), F.regexp_replace("kind", "^ConnectOperation", "").alias("event"), F.col("e.jobTag").alias("job_tag"), F.col("e.sessionId").alias("session_id"), F.coalesce("e.userName", "e.userId").alias("user"), F.col("e.statementText").alias("statement"), F.col("e.errorMessage").alias("error"), F.coalesce("e.eventTime", "e.Timestamp").alias("at"))
    out = A.pivot_first(c, ["context", "operation_id"], "seq", ["job_tag", "session_id", "user", "statement", "error"], "event", "at", OPERATION_KINDS)
    s = ev.filter("kind = 'ConnectSessionStarted'").groupBy("context", F.col("e.sessionId").alias("session_id")).agg(F.max(F.coalesce("e.userName", "e.userId")).alias("__user"))
    out = out.join(s, ["context", "session_id"], "left").withColumn("user", F.coalesce("user", "__user")).drop("__user")
    has = lambda k: F.col(f"{k}_time").isNotNull()
    return out.withColumn("status", F.when(has("Failed"), "failed").when(has("Canceled"), "canceled").when(has("Finished") | has("Closed"), "finished").otherwise("open"))
