"""Views over the tables of an event log (stagelens.sources.eventlog): each composes operators and stays a plan until it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.functions import plan_text as P
from stagelens.operators import aggregates as A
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators import windows as W
from stagelens.operators.graph import written

STAGE = ["context", "stage_id", "stage_attempt"]


def ms(c: str) -> Column:
    return F.unix_millis(c)


def stage_table(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages with their tasks' figures: good attempts for data, all for cost; all attempts where none is good."""
    ok = ~F.col("failed")
    has_ok = F.bool_or(ok).over(Window.partitionBy(*STAGE))
    good = ok | ~F.col("has_ok")
    t = tasks.withColumn("has_ok", has_ok).withColumn("good_ms", F.when(good, F.col("task_ms"))).withColumn("good_bytes", F.when(good, F.coalesce("input_bytes", F.lit(0)) + F.coalesce("shuffle_read", F.lit(0))))
    sums = [F.sum(F.when(good, F.col(c))).alias(c) for c in ("input_bytes", "output_bytes", "shuffle_read", "shuffle_write")] + [F.sum(c).alias(c) for c in ("gc_ms", "cpu_ms", "disk_spill", "mem_spill", "task_ms")]
    per = t.groupBy(*STAGE).agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.countDistinct("executor_id").alias("executors"), F.min("launch_time").alias("first_task_time"), F.max("peak_mem").alias("peak_mem"), F.max("good_ms").alias("max_task_ms"),
        *[A.quantile("good_ms", q).cast("long").alias(f"p{round(100 * q)}_task_ms") for q in (0.1, 0.5, 0.9)], A.quantile("good_bytes", 0.5).cast("long").alias("p50_read_bytes"), F.max("good_bytes").alias("max_read_bytes"), *sums,
    )
    out = stages.join(per, STAGE, "left").withColumn("duration_ms", ms("end_time") - ms("start_time"))
    return out.withColumn("skew", F.round(F.col("max_task_ms") / F.greatest("p50_task_ms", F.lit(1)), 1)).withColumn("data_skew", F.round(F.col("max_read_bytes") / F.greatest("p50_read_bytes", F.lit(1)), 1)).withColumn("gc_share", F.least(F.lit(1.0), F.col("gc_ms") / F.greatest("task_ms", F.lit(1)))).withColumn("replanned", F.coalesce(F.col("failure_reason").rlike("Adaptive query execution has replanned|cancelled unused stages"), F.lit(False)))


def stage_jobs(jobs: DataFrame) -> DataFrame:
    """context, stage_id, job_id: the least job that lists the stage."""
    return J.lowest_parent(jobs.select("context", F.explode("stage_ids").alias("stage_id"), "job_id"), ["context", "stage_id"], "job_id")


def reuse_edges(jobs: DataFrame) -> DataFrame:
    """context, src, dst, stage_id: a job that lists a stage which an earlier job ran."""
    each = jobs.select("context", F.explode("stage_ids").alias("stage_id"), "job_id")
    return each.join(stage_jobs(jobs).withColumnRenamed("job_id", "src"), ["context", "stage_id"]).filter("job_id > src").select("context", "src", F.col("job_id").alias("dst"), "stage_id")


def dag_edges(stages: DataFrame) -> DataFrame:
    """context, parent, parent_attempt, child, child_attempt: a parent's latest attempt that started before the child (its latest at all, if none did)."""
    child = stages.select("context", F.explode("parent_ids").alias("stage_id"), F.col("stage_id").alias("child"), F.col("stage_attempt").alias("child_attempt"), F.col("start_time").alias("child_start"))
    pairs = child.join(stages.select("context", "stage_id", F.col("stage_attempt").alias("a"), F.col("start_time").alias("s")), ["context", "stage_id"])
    return pairs.groupBy("context", F.col("stage_id").alias("parent"), "child", "child_attempt").agg(F.coalesce(F.max(F.when(F.col("s") <= F.col("child_start"), F.col("a"))), F.max("a")).alias("parent_attempt"))


def stage_executors(tasks: DataFrame) -> DataFrame:
    """Stage and executor: tasks, time, bytes, and the share of the stage's time."""
    per = tasks.groupBy(*STAGE, "executor_id").agg(F.count("*").alias("tasks"), F.sum("task_ms").alias("task_ms"), F.max("task_ms").alias("max_task_ms"), F.sum("gc_ms").alias("gc_ms"), F.sum("input_bytes").alias("input_bytes"), F.sum("disk_spill").alias("disk_spill"))
    return per.withColumn("share", F.col("task_ms") / F.greatest(F.sum("task_ms").over(Window.partitionBy(*STAGE)), F.lit(1)))


def executor_busy(tasks: DataFrame, gap: int = 2000) -> DataFrame:
    """context, executor_id, start, end, n, task_ms: stretches in which the executor ran tasks."""
    spans = tasks.select("context", "executor_id", ms("launch_time").alias("start"), ms("finish_time").alias("end"), "task_ms")
    return I.merge_intervals(spans, ["context", "executor_id"], "start", "end", gap, ["task_ms"])


def executor_profile(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Executors with task sums, busy time, lifetime and idle core time; ones only seen in tasks too."""
    busy = executor_busy(tasks).groupBy("context", "executor_id").agg(F.sum(F.col("end") - F.col("start")).alias("busy_ms"))
    sums = tasks.groupBy("context", "executor_id").agg(F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.sum("task_ms").alias("task_ms"), F.sum("gc_ms").alias("gc_ms"), F.sum("disk_spill").alias("disk_spill"), F.min("launch_time").alias("first_task"), F.max("finish_time").alias("last_task"))
    out = sums.join(busy, ["context", "executor_id"], "left").join(executors, ["context", "executor_id"], "full")
    life = ms("removed_or_last") - ms("added_or_first")
    out = out.withColumn("removed_or_last", F.coalesce("removed_time", "last_task")).withColumn("added_or_first", F.coalesce("added_time", "first_task"))
    return out.withColumn("lifetime_ms", life).withColumn("idle_core_ms", F.greatest(F.lit(0), F.col("lifetime_ms") * F.coalesce("cores", F.lit(1)) - F.coalesce("task_ms", F.lit(0)))).drop("removed_or_last", "added_or_first")


def placement(tasks: DataFrame) -> DataFrame:
    """Stage and executor: tasks and bytes by size band, and the interpolated median time."""
    sized = tasks.withColumn("bytes", F.coalesce("input_bytes", F.lit(0)) + F.coalesce("shuffle_read", F.lit(0)))
    keys = [*STAGE, "executor_id"]
    return A.size_bands(sized, keys, "bytes").join(sized.groupBy(*keys).agg(F.median("task_ms").alias("median_ms")), keys)


def skewed_tasks(tasks: DataFrame, stages: DataFrame, ratio: float = 10.0, floor_ms: int = 60_000, data_ratio: float = 5.0, n: int = 5, stuck: DataFrame | None = None, slow_ratio: float = 1.5, gc_share: float = 0.2) -> DataFrame:
    """The slowest n tasks of each stage that take ratio times its median, with what explains them, the first that holds: gc_stuck, lost, data_skew, gc, slow_executor, source_db, unknown.

    stuck: context, executor_id of executors whose heap stayed full; data is bytes, or rows where no task of the stage has any bytes (a database read).
    """
    s = stages.select(*STAGE, "p50_task_ms", "p50_read_bytes")
    read = F.coalesce("input_bytes", F.lit(0)) + F.coalesce("shuffle_read", F.lit(0))
    rows = tasks.groupBy(*STAGE).agg(A.quantile("input_records", 0.5, where=~F.col("failed")).alias("__rows"), (F.max(read) == 0).alias("__rows_only"), F.median("task_ms").alias("__stage"))
    rows = written(rows)  # one row a stage, for its own tasks and for the executors' slowness
    slow = _slowness(tasks, rows.select(*STAGE, "__stage"))
    rows = rows.drop("__stage")
    t = tasks.join(s, STAGE).filter((F.col("task_ms") >= ratio * F.greatest("p50_task_ms", F.lit(1))) & (F.col("task_ms") >= floor_ms))
    t = W.top_n(t, STAGE, [F.desc("task_ms"), F.col("task_id"), F.col("input_bytes"), F.col("executor_id"), F.col("gc_ms")], n)
    t = t.join(rows, STAGE).join(slow, ["context", "executor_id"], "left")
    t = t.join(stuck.withColumn("__stuck", F.lit(True)), ["context", "executor_id"], "left") if stuck is not None else t.withColumn("__stuck", F.lit(None).cast("boolean"))
    cause = (
        F.when(F.col("__stuck"), "gc_stuck")
        .when(F.col("end_reason").isin("ExecutorLostFailure", "TaskResultLost") & (read == 0), "lost")
        .when((read > 0) & (read >= data_ratio * F.greatest("p50_read_bytes", F.lit(1))), "data_skew")
        .when((read == 0) & (F.col("input_records") >= data_ratio * F.greatest("__rows", F.lit(1))), "data_skew")
        .when(F.col("gc_ms") >= gc_share * F.col("task_ms"), "gc")
        .when(F.col("slowness") >= slow_ratio, "slow_executor")
        .when(F.col("__rows_only") & (F.col("__rows") > 0), "source_db")
        .otherwise("unknown")
    )
    return t.withColumn("cause", cause).drop("__rows", "__rows_only", "__stuck", "slowness")


def _slowness(tasks: DataFrame, per_stage: DataFrame | None = None) -> DataFrame:
    """context, executor_id, slowness (A39), within each context."""
    per = tasks.withColumn("__e", F.struct("context", "executor_id"))
    return A.slowness(per, STAGE, "__e", "task_ms", per_stage).select("__e.context", "__e.executor_id", "slowness")


def peak_buckets(tasks: DataFrame, measure: str, width: int = 60_000, n: int = 3) -> DataFrame:
    """context, bucket, total, average: the n buckets with most of a measure, tasks spread over the time they ran."""
    spans = tasks.select("context", ms("launch_time").alias("s"), ms("finish_time").alias("e"), F.col(measure).cast("double").alias("total"))
    per = I.bucket_spread(spans, ["context"], "s", "e", ["total"], width).drop("n")
    per = per.withColumn("average", F.avg("total").over(Window.partitionBy("context")))
    return W.top_n(per, ["context"], [F.desc("total"), F.col("bucket")], n)


def spill_shuffle_timeline(tasks: DataFrame, width: int = 60_000) -> DataFrame:
    """context, executor, stage, bucket: tasks and bytes spilled, shuffled and read."""
    measures = ["disk_spill", "shuffle_read", "shuffle_write", "input_bytes"]
    spans = tasks.select("context", "executor_id", "stage_id", ms("launch_time").alias("s"), ms("finish_time").alias("e"), *[F.coalesce(F.col(m), F.lit(0)).cast("double").alias(m) for m in measures])
    out = I.bucket_spread(spans, ["context", "executor_id", "stage_id"], "s", "e", measures, width)
    return out.withColumns({m: F.round(m) for m in measures})


def spill_markers(timeline: DataFrame) -> DataFrame:
    """context, executor, bucket: bytes spilled and the stages that did."""
    return timeline.filter("disk_spill > 0").groupBy("context", "executor_id", "bucket").agg(F.sum("disk_spill").alias("disk_spill"), F.sort_array(F.collect_set("stage_id")).alias("stages"))


def waiting(stages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wait_ms, run_ms: time with a stage submitted and none running, and time with one running."""
    s = stages.filter("start_time IS NOT NULL")
    first, end = F.coalesce("first_task_time", "end_time"), F.coalesce("end_time", "first_task_time", "start_time")
    wait = s.select(*keys, ms("start_time").alias("start"), F.unix_millis(first).alias("end"))
    run = s.filter("first_task_time IS NOT NULL").select(*keys, ms("first_task_time").alias("start"), F.unix_millis(end).alias("end"))
    only = I.union_length(I.subtract_intervals(wait, run, keys, "start", "end"), keys, "start", "end").withColumnRenamed("covered", "wait_ms")
    return only.join(I.union_length(run, keys, "start", "end").withColumnRenamed("covered", "run_ms"), keys, "full").fillna(0, ["wait_ms", "run_ms"])


def query_facts(queries: DataFrame) -> DataFrame:
    """Queries with their plans' operators, tables, flags and identity."""
    from stagelens.functions.text import plan_hash, query_key

    q = queries.withColumn("plan", P.final_plan(F.col("final_plan"), F.col("initial_plan")))
    plan = F.col("plan")
    return q.withColumns({"operators": P.operators(plan), "tables_read": P.tables_read(plan), "tables_written": P.tables_written(plan), "count_only": P.count_only(plan), "uses_cache": P.uses_cache(plan), "adaptive": P.adaptive(plan), "jdbc": P.jdbc(plan), "plan_hash": plan_hash(plan), "query_key": query_key(F.col("description")), "duration_ms": ms("end_time") - ms("start_time"), "label": P.description_label(F.col("description"))})


def engine_summary(facts: DataFrame) -> DataFrame:
    """context, queries, adaptive, cached, count_only."""
    return facts.groupBy("context").agg(F.count("*").alias("queries"), F.count_if("adaptive").alias("adaptive"), F.count_if("uses_cache").alias("cached"), F.count_if("count_only").alias("count_only"))


def micro_batches(queries: DataFrame) -> DataFrame:
    """stream, batches, first and last start, and the lower median time of a batch."""
    b = queries.withColumn("m", P.micro_batch(F.col("description"))).filter("m IS NOT NULL").select("m.*", "start_time", (ms("end_time") - ms("start_time")).alias("took"))
    return b.groupBy("stream").agg(F.countDistinct("batch").alias("batches"), F.min("start_time").alias("first"), F.max("start_time").alias("last"), A.quantile("took", 0.5).cast("long").alias("median_ms"))


def table_reads(facts: DataFrame) -> DataFrame:
    """table, reads, writes, queries: how often queries read and write each table."""
    reads = facts.select("context", "sql_execution_id", F.explode("tables_read").alias("table"), F.lit(1).alias("r"), F.lit(0).alias("w"))
    writes = facts.select("context", "sql_execution_id", F.explode("tables_written").alias("table"), F.lit(0).alias("r"), F.lit(1).alias("w"))
    return reads.unionByName(writes).groupBy("table").agg(F.sum("r").alias("reads"), F.sum("w").alias("writes"), F.countDistinct("context", "sql_execution_id").alias("queries"))


def settings_merge(cluster: DataFrame, session: DataFrame, defaults: DataFrame) -> DataFrame:
    """setting, cluster value, distinct session values, default and the value that holds: session (if there is one alone), cluster, default."""
    s = session.groupBy("setting").agg(F.sort_array(F.collect_set("value")).alias("session_values"))
    c = cluster.groupBy("setting").agg(F.max("value").alias("cluster_value"))
    out = defaults.select("setting", F.col("value").alias("default_value")).join(c, "setting", "full").join(s, "setting", "full")
    return out.withColumn("effective", F.coalesce(F.when(F.size("session_values") == 1, F.get("session_values", F.lit(0))), "cluster_value", "default_value"))


def runs(jobs: DataFrame) -> DataFrame:
    """run_key: jobs, span, duration, status (failed before open before succeeded) and how it compares with the typical earlier one of its program."""
    from stagelens.functions.text import run_key

    p = F.transform_keys("properties", lambda k, _: F.regexp_replace(F.replace(k, F.lit("spark.jobGroup.id"), F.lit("job_group")), r"^spark\.", ""))
    j = jobs.withColumn("run_key", run_key(F.coalesce(p, F.create_map().cast("map<string,string>")), F.col("context")))
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "open", 1).otherwise(2)
    out = j.groupBy("run_key").agg(F.count("*").alias("jobs"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min_by("status", rank).alias("status"))
    out = out.withColumn("duration_ms", ms("end_time") - ms("start_time")).withColumn("program", F.regexp_replace("run_key", r"[-:]\d+$", ""))
    return A.typical(out, ["program"], ["start_time", "run_key"], "duration_ms")


def coverage(parts: dict[str, DataFrame]) -> DataFrame:
    """kind, missing: which of the named tables have no rows. One row a table."""
    out = None
    for name, df in parts.items():
        one = df.limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), (F.col("n") == 0).alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


def core_use(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """context, paid_core_ms, good_task_ms, use: the share of paid core time that went into successful tasks."""
    span = tasks.groupBy("context").agg(F.max("finish_time").alias("last"))
    e = executors.join(span, "context").withColumn("paid", (F.unix_millis(F.coalesce("removed_time", "last")) - ms("added_time")) * F.coalesce("cores", F.lit(1)))
    paid = e.groupBy("context").agg(F.sum(F.greatest(F.lit(0), F.col("paid"))).alias("paid_core_ms"))
    good = tasks.groupBy("context").agg(F.sum(F.when(~F.col("failed"), F.col("task_ms"))).alias("good_task_ms"))
    return paid.join(good, "context", "full").withColumn("use", F.col("good_task_ms") / F.nullif("paid_core_ms", F.lit(0)))


def story(parts: list[tuple[DataFrame, str | Column]]) -> DataFrame:
    """seq, at, kind, text: all events (at, text) in order of time, nulls last, then of the parts."""
    out = None
    for i, (df, kind) in enumerate(parts):
        one = df.select("at", F.lit(i).alias("class"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), "text")
        out = one if out is None else out.unionByName(one)
    return W.numbered(out, [F.col("at").asc_nulls_last(), F.col("class"), F.col("text")], "seq").select("seq", "at", "kind", "text")


def query_rollup(stages: DataFrame, links: DataFrame) -> DataFrame:
    """context, sql_execution_id and its stages' totals. links: context, stage_id, sql_execution_id."""
    sums = ("tasks", "failed_tasks", "task_ms", "gc_ms", "input_bytes", "output_bytes", "shuffle_read", "shuffle_write", "disk_spill")
    s = stages.join(links, ["context", "stage_id"])
    return s.groupBy("context", "sql_execution_id").agg(F.count("*").alias("stages"), *[F.sum(c).alias(c) for c in sums], F.max("skew").alias("max_skew"))


def grain_distribution(tasks: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key and the distribution of its good tasks' time (A2 at the grain of a job, query or run); null keys are left out. links: context, stage_id, key."""
    t = tasks.filter(~F.col("failed")).join(links, ["context", "stage_id"]).filter(F.col(key).isNotNull())
    return A.distribution(t, ["context", key], "task_ms")


def storage_split(tasks: DataFrame) -> DataFrame:
    """context, stage: input bytes, null where no task of the context knows the metric at all."""
    per = tasks.groupBy("context", "stage_id").agg(F.sum("input_bytes").alias("__b"))
    known = per.groupBy("context").agg(F.bool_or(F.col("__b").isNotNull()).alias("__known"))
    return I.by_keys(per, known, ["context"]).select("context", "stage_id", F.when(F.col("__known"), F.coalesce("__b", F.lit(0))).alias("input_bytes"))


def retry_summary(tasks: DataFrame) -> DataFrame:
    """Stage: tasks with a failure, failed attempts by category, wasted time, and the earliest failure's text."""
    from stagelens.functions.text import failure_category

    bad = tasks.filter("failed").withColumn("category", failure_category(F.col("end_reason"), F.col("error"), F.lit(None).cast("string")))
    per = bad.groupBy(*STAGE, "category").agg(F.count("*").alias("n"), F.sum("task_ms").alias("ms"), F.min_by("error", F.struct("finish_time", "task_id")).alias("example"), F.min("finish_time").alias("at"))
    tasks_hit = bad.groupBy(*STAGE).agg(F.countDistinct("task_index").alias("tasks"))
    out = per.groupBy(*STAGE).agg(F.sum("n").alias("attempts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"), F.sum("ms").alias("wasted_ms"), F.min_by("example", "at").alias("example"))
    return out.join(tasks_hit, STAGE)


def first_key(properties: DataFrame, ident: str, keys: list[str], name: str) -> DataFrame:
    """ident, name, source: the first of the property keys, in this order, that has a value. properties: ident, setting, value."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)]), F.col("setting"))
    p = properties.filter(F.col("setting").isin(*keys) & (F.trim("value") != "")).withColumn("__r", rank)
    return p.groupBy(ident).agg(F.min_by("value", "__r").alias(name), F.min_by("setting", "__r").alias("source"))


def default_run(run_table: DataFrame) -> DataFrame:
    """The run to show first: failed before others, then the longest; application-wide ones only if there is nothing else."""
    rank = F.struct((~F.col("run_key").startswith("app:")).alias("a"), (F.col("status") == "failed").alias("b"), F.coalesce("duration_ms", F.lit(-1)).alias("c"), "run_key")
    return run_table.agg(F.max_by("run_key", rank).alias("run_key"))


def oom_sites(failed_tasks: DataFrame, errors: DataFrame) -> DataFrame:
    """executor_id, site: from its failed tasks' texts, else from its log's exceptions (executor_id, seq, exception, frames)."""
    from stagelens.functions.text import OOM_TEXT, oom_site

    none = F.array().cast("array<string>")
    t = failed_tasks.filter(F.col("error").rlike(OOM_TEXT)).select("executor_id", F.lit(0).alias("p"), F.unix_millis("finish_time").alias("at"), F.coalesce(oom_site(none, F.col("error")), F.lit("unknown")).alias("site"))
    e = errors.filter(F.col("exception").rlike(OOM_TEXT)).select("executor_id", F.lit(1).alias("p"), F.col("seq").alias("at"), F.coalesce(oom_site(F.col("frames"), F.col("exception")), F.lit("unknown")).alias("site"))
    return t.unionByName(e).groupBy("executor_id").agg(F.min_by("site", F.struct("p", "at")).alias("site"))


def thread_dumps(lines: DataFrame) -> DataFrame:
    """file_path, dumps: headers of thread dumps, one dump for headers that follow each other with only dump lines between."""
    from stagelens.functions.text import DUMP_HEADER

    head = F.col("line").rlike(DUMP_HEADER)
    w = Window.partitionBy("file_path").orderBy("seq")
    state = F.when(head, 1).when(F.col("kind").isNotNull(), 0)
    before = F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("__new", head & (before == 0)).groupBy("file_path").agg(F.count_if("__new").alias("dumps"))


def totals(tasks: DataFrame, stages: DataFrame, jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: counts by state and sums."""
    t = tasks.agg(F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.sum("task_ms").alias("task_ms"), F.sum("input_bytes").alias("input_bytes"), F.sum("disk_spill").alias("disk_spill"))
    s = stages.agg(F.count("*").alias("stages"), F.count_if(F.col("failure_reason").isNotNull()).alias("failed_stages"))
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    q = queries.agg(F.count("*").alias("queries"), F.count_if(F.col("status") == "failed").alias("failed_queries"))
    return t.join(s).join(j).join(q)  # one row each


def kinds_over_runs(findings: DataFrame, run_table: DataFrame) -> DataFrame:
    """category: number of runs and failed runs that have it, and its worst example."""
    f = findings.join(run_table.select("run_key", (F.col("status") == "failed").alias("bad")), "run_key", "left")
    return f.groupBy("category").agg(F.countDistinct("run_key").alias("runs"), F.countDistinct(F.when(F.col("bad"), F.col("run_key"))).alias("failed_runs"), F.min_by("entity", F.struct("severity", (-F.coalesce("measure", F.lit(0.0))).alias("m"), "entity")).alias("worst"))


def top(df: DataFrame, measure: str, ident: list[str], limit: int = 20) -> DataFrame:
    """The rows with most of a measure, nulls last: a report of `limit` rows (200 at most)."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *ident).limit(min(limit, 200))


def in_window(df: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Rows whose span meets [lo, hi]; an open end counts as going on."""
    return df.filter((F.col(start) <= hi) & (F.coalesce(F.col(end), hi) >= lo))


def of_run(df: DataFrame, run_table: DataFrame, run: str, at: str) -> DataFrame:
    """Rows of a run by key, and rows of no run within its span, if no other run overlapped it."""
    r = run_table.filter(F.col("run_key") == run).select(F.col("start_time").alias("__s"), F.col("end_time").alias("__e"))
    others = run_table.filter(F.col("run_key") != run).join(F.broadcast(r), (F.col("start_time") < F.col("__e")) & (F.col("end_time") > F.col("__s")))
    alone = r.join(others.agg(F.count("*").alias("__n"))).filter("__n = 0")
    shared = df.filter(F.col("run_key").isNull()).join(F.broadcast(alone), F.col(at).between(F.col("__s"), F.col("__e"))).select(*df.columns)
    return df.filter(F.col("run_key") == run).unionByName(shared)


def stage_label(scopes: Column) -> Column:
    """What a stage does, from its operators' names."""
    known = (("Scan", "read"), ("Exchange", "shuffle"), ("Sort", "sort"), ("Aggregate", "aggregate"), ("Join", "join"), ("Window", "window"), ("Generate", "explode"), ("Write", "write"), ("InMemory", "cache"))
    hits = F.array(*[F.when(F.exists(scopes, lambda s: s.contains(k)), F.lit(label)) for k, label in known])
    return F.nullif(F.array_join(F.array_compact(hits), ", "), F.lit(""))


def run_family(job: Column, program: Column, kind: Column, label: Column) -> Column:
    return F.coalesce(F.concat_ws("|", F.when(job.isNotNull() & program.isNotNull(), F.concat_ws("|", job, program))), program, F.concat_ws("|", kind, label))


def stage_times(tasks: DataFrame) -> DataFrame:
    """Stage: first launch, last finish, the lower 90th percentile of finishes, and the tail after it."""
    t = tasks.withColumn("fin", ms("finish_time"))
    out = t.groupBy(*STAGE).agg(F.min(ms("launch_time")).alias("first_launch"), F.max("fin").alias("last_finish"), A.quantile("fin", 0.9).cast("long").alias("p90_finish"))
    return out.withColumn("tail_ms", F.col("last_finish") - F.col("p90_finish"))


def widened(run_table: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs whose span also covers their queries' (run_key, start_time, end_time)."""
    q = spans.groupBy("run_key").agg(F.min("start_time").alias("__s"), F.max("end_time").alias("__e"))
    out = run_table.join(q, "run_key", "left")
    return out.withColumn("start_time", F.least("start_time", "__s")).withColumn("end_time", F.greatest("end_time", "__e")).drop("__s", "__e")


def scopes_of_text(findings: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, stages, executors: the stages ("stage 6.1") and executors ("executor 3") that a finding's text names."""
    ids = lambda p: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(p), 1))
    return findings.select(ident, ids(r"\bstage (\d+)").alias("stages"), ids(r"\bexecutor (\d+)").alias("executors"))


def log_context(lines: DataFrame, file: str, seq: int, before: int = 10, after: int = 20) -> DataFrame:
    """The lines around one line of a file."""
    return lines.filter((F.col("file_path") == file) & F.col("seq").between(seq - before, seq + after)).orderBy("seq")


def cluster_list(summaries: DataFrame, limit: int = 50) -> DataFrame:
    """The latest outputs: cluster_id and the columns of its newest summary. A report of `limit` rows."""
    newest = summaries.groupBy("cluster_id").agg(F.max_by(F.struct(*summaries.columns), "built").alias("s")).select("s.*")
    return newest.orderBy(F.desc("built"), "cluster_id").limit(limit)
