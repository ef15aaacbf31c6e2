"""Views of runs and queries: where time went, steps, lists, timelines, ends, diagnosis and advice. Times are epoch milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelens.operators import aggregates as A
from stagelens.operators import intervals as I
from stagelens.operators import windows as W
from stagelens.operators.findings import HIGH


def scan(spark: SparkSession, path: str, where: dict | None = None, order: Sequence[Column] = (), limit: int | None = None, truncate: dict[str, int] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """A Parquet table with equality filters (which reach the scan), sorted, cut to a report of `limit` rows, long texts cut, columns left out."""
    df = spark.read.parquet(path).drop(*exclude)
    df = W.where_equal(df, where or {})
    df = df.withColumns({c: F.substring(c, 1, n) for c, n in (truncate or {}).items() if c in df.columns})
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)


def query_time(queries: DataFrame, stages: DataFrame) -> DataFrame:
    """context, root: total, waiting (a stage has no core and none runs), running and outside (no stage at all), over a root query and those inside it.

    queries: context, sql_execution_id, root_execution_id, start_ms, end_ms; stages: context, sql_execution_id, start_ms, first_ms, end_ms.
    """
    keys = ["context", "root"]
    q = queries.withColumn("root", F.coalesce("root_execution_id", "sql_execution_id"))
    span = q.filter(F.col("root") == F.col("sql_execution_id")).select(*keys, F.col("start_ms").alias("q0"), F.col("end_ms").alias("q1"))
    s = stages.join(q.select("context", "sql_execution_id", "root"), ["context", "sql_execution_id"]).join(span, keys)
    first = F.least(F.greatest(F.coalesce("first_ms", "start_ms"), "start_ms"), "end_ms")
    cut = lambda a, b: s.select(*keys, F.greatest(a, "q0").alias("s"), F.least(b, "q1").alias("e")).filter("e > s")
    wait, run = cut(F.col("start_ms"), first), cut(first, F.col("end_ms"))
    ran = I.union_length(run, keys, "s", "e").withColumnRenamed("covered", "running_ms")
    waited = I.union_length(I.subtract_intervals(wait, run, keys, "s", "e"), keys, "s", "e").withColumnRenamed("covered", "waiting_ms")
    out = span.join(ran, keys, "left").join(waited, keys, "left").fillna(0, ["running_ms", "waiting_ms"]).withColumn("total_ms", F.col("q1") - F.col("q0"))
    return out.select(*keys, "total_ms", "waiting_ms", "running_ms", F.greatest(F.lit(0), F.col("total_ms") - F.col("running_ms") - F.col("waiting_ms")).alias("outside_ms"))


def run_steps(groups: DataFrame, run: str, gap_ms: int = 60_000) -> DataFrame:
    """run, step, start, end, n: a run's groups of work merged where they overlap, in order, with the pause before each (null if under gap_ms)."""
    m = I.merge_intervals(groups, [run], "start_ms", "end_ms")
    w = Window.partitionBy(run).orderBy("start_ms")
    pause = F.col("start_ms") - F.lag("end_ms").over(w)
    return m.withColumn("step", F.row_number().over(w)).withColumn("pause_ms", F.when(pause >= gap_ms, pause))


def runs_list(runs: DataFrame, waits: DataFrame, reads: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """runs with wait_ms (waits: key, wait_ms), bytes read (reads: key, bytes) and their biggest task (tasks: key, task_id, task_ms)."""
    w = waits.groupBy(key).agg(F.sum("wait_ms").alias("waited_ms"))
    r = reads.groupBy(key).agg(F.sum("bytes").alias("read_bytes"))
    t = tasks.groupBy(key).agg(F.max("task_ms").alias("biggest_ms"), F.max_by("task_id", F.struct("task_ms", "task_id")).alias("biggest_task"))
    return runs.join(w, key, "left").join(r, key, "left").join(t, key, "left")


def cluster_minutes(tasks: DataFrame, executors: DataFrame, ends: DataFrame, width: int = 60_000) -> DataFrame:
    """context, bucket: task time and what it went into (cpu, gc, fetch, failed, other), cores up (time-weighted) and their use.

    tasks: launch_ms, finish_ms, task_ms, cpu_ms, gc_ms, fetch_wait_ms, failed; executors: cores, added_ms, removed_ms; ends: context, end_ms.
    """
    good = ~F.col("failed")
    part = lambda c: F.when(good, F.coalesce(c, F.lit(0))).otherwise(0).cast("double")
    t = tasks.select("context", F.col("launch_ms").alias("s"), F.col("finish_ms").alias("e"), F.col("task_ms").cast("double").alias("total"), F.when(F.col("failed"), F.col("task_ms")).otherwise(0).cast("double").alias("failed_ms"), *[part(F.col(c)).alias(c) for c in ("cpu_ms", "gc_ms", "fetch_wait_ms")])
    per = I.bucket_spread(t, ["context"], "s", "e", ["total", "failed_ms", "cpu_ms", "gc_ms", "fetch_wait_ms"], width)
    split = A.cause_split(F.col("total"), {"failed": F.col("failed_ms"), "cpu": F.col("cpu_ms"), "gc": F.col("gc_ms"), "fetch": F.col("fetch_wait_ms")})
    per = per.select("context", "bucket", F.col("n").alias("tasks"), "total", *split)
    up = executors.join(ends, "context").select("context", F.col("added_ms").alias("s"), F.coalesce("removed_ms", "end_ms").alias("e"), "cores").filter("e > s")
    paid = I.bucket_spread(up.withColumn("core_ms", (F.col("cores") * (F.col("e") - F.col("s"))).cast("double")), ["context"], "s", "e", ["core_ms"], width).drop("n")
    return per.join(paid, ["context", "bucket"], "left").withColumn("use", F.col("total") / F.col("core_ms"))


def gantt(jobs: DataFrame, stages: DataFrame, executors: DataFrame, tasks: DataFrame, every: int = 20) -> DataFrame:
    """kind, id, start_ms, end_ms of jobs, stages, executors and sampled tasks (every so many-th of a context by start, id, end, failed ones last; all failed ones), with markers for removals and failures.

    Each part: context, id, start_ms, end_ms; tasks with failed.
    """
    one = lambda df, kind: df.select("context", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "start_ms", "end_ms")
    some = W.systematic_sample(tasks, ["context"], [F.col("start_ms"), F.col("id"), F.col("end_ms"), F.col("failed")], every, F.col("failed"))
    mark = lambda df, kind, at: df.select("context", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(at).alias("start_ms"), F.col(at).alias("end_ms"))
    parts = [one(jobs, "job"), one(stages, "stage"), one(executors, "executor"), one(some, "task"), mark(executors.filter("end_ms IS NOT NULL"), "removed", "end_ms"), mark(tasks.filter("failed"), "task_failed", "end_ms")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def task_columns(tasks: DataFrame, keys: Sequence[str], measure: str, every: int) -> DataFrame:
    """A sample of tasks for a chart: every so many-th of the keys by time, failed ones, and each key's longest; with place, 0 for the first."""
    w = Window.partitionBy(*keys)
    t = tasks.withColumn("place", F.row_number().over(w.orderBy("launch_ms", "task_id", measure)) - 1).withColumn("__most", F.max(measure).over(w))
    return t.filter((F.col("place") % every == 0) | F.col("failed") | (F.col(measure) == F.col("__most"))).drop("__most")


def query_profile(queries: DataFrame, stages: DataFrame, tasks: DataFrame, executors: DataFrame, findings: DataFrame) -> DataFrame:
    """context, sql_execution_id: stages, distinct executors, executors lost while it ran, findings and the worst severity.

    stages: context, stage_id, sql_execution_id; tasks: context, stage_id, executor_id; executors: context, executor_id, removed_ms, removal_category; findings: context, sql_execution_id, severity.
    """
    keys = ["context", "sql_execution_id"]
    links = stages.select(*keys, "stage_id").distinct()
    n = links.groupBy(*keys).agg(F.count("*").alias("stages"))
    used = tasks.select("context", "stage_id", "executor_id").distinct().join(links, ["context", "stage_id"]).select(*keys, "executor_id").distinct()
    gone = executors.filter(F.col("removal_category").isin("oom", "lost", "killed")).select("context", "executor_id", "removed_ms")
    lost = used.join(gone, ["context", "executor_id"]).join(queries.select(*keys, "start_ms", "end_ms"), keys).filter("removed_ms BETWEEN start_ms AND end_ms").groupBy(*keys).agg(F.count("*").alias("lost"))
    f = findings.groupBy(*keys).agg(F.count("*").alias("findings"), F.min("severity").alias("worst"))
    out = queries.select(*keys).join(n, keys, "left").join(used.groupBy(*keys).agg(F.count("*").alias("executors")), keys, "left").join(lost, keys, "left").join(f, keys, "left")
    return out.fillna(0, ["stages", "executors", "lost", "findings"])


def executor_logs(logs: DataFrame, executors: DataFrame, seen: DataFrame) -> DataFrame:
    """executors with the records of their logs: by (app, executor), else by executor among apps without a context; executors only seen elsewhere (seen: context, executor_id) too.

    logs: app_id, executor_id, records; executors: context, app_id, executor_id.
    """
    all_ = executors.select("context", "app_id", "executor_id").unionByName(seen.join(executors, ["context", "executor_id"], "left_anti").select("context", F.lit(None).cast("string").alias("app_id"), "executor_id").distinct())
    own = logs.groupBy("app_id", "executor_id").agg(F.sum("records").alias("__own"))
    known = executors.select("app_id").distinct()
    rest = own.join(known, "app_id", "left_anti").groupBy("executor_id").agg(F.sum("__own").alias("__rest"))
    return all_.join(own, ["app_id", "executor_id"], "left").join(rest, "executor_id", "left").select("context", "app_id", "executor_id", F.coalesce("__own", "__rest").alias("records"))


def run_end(runs: DataFrame, queries: DataFrame, executors: DataFrame, errors: DataFrame, app_ends: DataFrame, before_ms: int = 300_000, after_ms: int = 60_000, stop_ms: int = 120_000, width: int = 3_600_000) -> DataFrame:
    """How each run ended: its failed and open queries, the last finished one, executors that went while it ran, error kinds logged near its end and how many of its
    program's runs have the most common one there too, whether its cluster stopped right after, and the outcome.

    runs: run_key, context, program, start_ms, end_ms; queries: run_key, sql_execution_id, status, end_ms; errors: context, fingerprint, ts_ms; app_ends: context, end_ms.
    """
    q = queries.groupBy("run_key").agg(F.count_if(F.col("status") == "failed").alias("failed_queries"), F.count_if(F.col("status") == "open").alias("open_queries"), F.max_by("sql_execution_id", F.when(F.col("status") != "open", F.struct("end_ms", "sql_execution_id"))).alias("last_query"))
    near = runs.select("run_key", "context", "program", (F.col("end_ms") - before_ms).alias("l_start"), (F.col("end_ms") + after_ms).alias("l_end"))
    # all windows are of one length: errors of a kind at most that far apart are one stretch that every window inside it meets, and a window meets one such stretch at most
    points = errors.filter("ts_ms IS NOT NULL").select("context", "fingerprint", F.col("ts_ms").alias("r_start"), F.col("ts_ms").alias("r_end")).distinct()
    stretches = I.merge_intervals(points, ["context", "fingerprint"], "r_start", "r_end", before_ms + after_ms, width=max(width, before_ms + after_ms)).drop("n")
    hits = I.overlap_join(near, stretches, ["context"], width, closed=True).select("run_key", "program", "fingerprint").distinct()
    common = hits.groupBy("program", "fingerprint").agg(F.countDistinct("run_key").alias("runs_with"))
    errs = hits.join(common, ["program", "fingerprint"]).groupBy("run_key").agg(F.count("*").alias("error_kinds"), F.max("runs_with").alias("runs_with"))
    gone = executors.filter("removed_ms IS NOT NULL").select("context", F.col("removed_ms").alias("r_start"), F.col("removed_ms").alias("r_end"), "removal_category")
    went = I.overlap_join(runs.select("run_key", "context", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end")), gone, ["context"], width * 24, closed=True).groupBy("run_key").agg(F.count("*").alias("executors_gone"), F.count_if(F.col("removal_category").isin("oom", "lost", "killed")).alias("executors_lost"))
    out = runs.join(q, "run_key", "left").join(errs, "run_key", "left").join(went, "run_key", "left").join(app_ends.withColumnRenamed("end_ms", "app_end"), "context", "left")
    out = out.fillna(0, ["failed_queries", "open_queries", "error_kinds", "executors_gone", "executors_lost"])
    outcome = F.when(F.col("failed_queries") > 0, "failed").when(F.col("open_queries") > 0, "cut off").otherwise("succeeded")
    stopped = F.coalesce((F.col("app_end") - F.col("end_ms")).between(0, stop_ms), F.lit(False))
    return out.select("run_key", outcome.alias("outcome"), "failed_queries", "open_queries", "last_query", "error_kinds", "runs_with", "executors_gone", "executors_lost", stopped.alias("cluster_stopped"))


def diagnosis(runs: DataFrame, findings: DataFrame, causes: DataFrame, errors: DataFrame, retries: DataFrame) -> DataFrame:
    """run_key: outcome, first error, root (what a cause path leads to, else the earliest of the worst findings), retries, time lost, and the findings to look at next.

    findings: run_key, id, category, severity, ts_ms; causes: effect, root; errors: run_key, ts_ms, text; retries: run_key, wasted.
    """
    worst = findings.groupBy("run_key").agg(F.min_by("id", F.struct("severity", F.coalesce("ts_ms", F.lit(1 << 62)).alias("t"), "id")).alias("top"), F.count("*").alias("findings"), F.count_if(F.col("severity") == HIGH).alias("high"))
    next_ = W.top_n(findings.groupBy("run_key", "category").agg(F.min("severity").alias("severity"), F.count("*").alias("n")), ["run_key"], [F.col("severity"), F.desc("n"), F.col("category")], 3)
    next_ = next_.groupBy("run_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]), ", ").alias("next"))
    first = errors.groupBy("run_key").agg(F.min_by("text", F.struct("ts_ms", "text")).alias("first_error"))
    lost = retries.groupBy("run_key").agg(F.count("*").alias("retries"), F.sum("wasted").alias("wasted"))
    out = runs.select("run_key", "status").join(worst, "run_key", "left").join(causes.select(F.col("effect").alias("top"), F.col("root").alias("__root")), "top", "left")
    out = out.join(next_, "run_key", "left").join(first, "run_key", "left").join(lost, "run_key", "left").fillna(0, ["findings", "high", "retries", "wasted"])
    return out.select("run_key", F.col("status").alias("outcome"), "first_error", F.coalesce("__root", "top").alias("root"), F.col("__root").isNotNull().alias("by_cause"), "findings", "high", "retries", "wasted", "next")


def settings_advice(stages: DataFrame, settings: DataFrame, small: int = 1 << 20, large: int = 512 << 20) -> DataFrame:
    """context, setting, current, advice, cost_ms, stages: settings to change, the costliest first in `rank`.

    From stages (context, tasks, shuffle_read, duration_ms, skew, disk_spill, gc_ms, task_ms, failed_tasks): shuffle partitions far too small or large, spill, skew without its join
    rule, garbage collection, retries without speculation. settings: context, setting, value.
    """
    per = F.col("shuffle_read") / F.greatest("tasks", F.lit(1))
    rules = (
        ("spark.sql.shuffle.partitions", "fewer partitions", (F.col("shuffle_read") > 0) & (per < small), F.col("duration_ms")),
        ("spark.sql.shuffle.partitions", "more partitions", per > large, F.col("duration_ms")),
        ("spark.sql.files.maxPartitionBytes", "smaller input splits", F.col("disk_spill") > 0, F.col("duration_ms")),
        ("spark.sql.adaptive.skewJoin.enabled", "on, with a lower factor", F.col("skew") >= 10, F.col("max_task_ms") - F.col("p50_task_ms")),
        ("spark.memory.fraction", "less cached, or more memory a core", F.col("gc_ms") >= 0.2 * F.col("task_ms"), F.col("gc_ms")),
        ("spark.speculation", "look at the hosts that fail first", F.col("failed_tasks") > 0, F.col("duration_ms")),
    )
    hit = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("setting"), F.lit(a).alias("advice"), cost.cast("long").alias("cost"))) for s, a, cond, cost in rules]))
    each = stages.select("context", F.explode(hit).alias("h")).groupBy("context", "h.setting", "h.advice").agg(F.sum("h.cost").alias("cost_ms"), F.count("*").alias("stages"))
    now = settings.groupBy("context", "setting").agg(F.max("value").alias("current"))
    out = each.join(now, ["context", "setting"], "left")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("cost_ms"), "setting", "advice")))


def debug_steps(lines: DataFrame, tasks: DataFrame, stages: DataFrame, queries: DataFrame, limit: int = 50) -> dict[str, DataFrame]:
    """The tables to look at between the steps of a build, by name."""
    by = lambda df, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    failed = tasks.filter("failed")
    return {
        "levels": by(lines, "level"), "sources": by(lines, "source"), "signals": by(lines.filter("signal IS NOT NULL"), "signal"), "exceptions": by(lines.filter("exception IS NOT NULL"), "exception"),
        "first_errors": lines.filter("level = 'ERROR'").orderBy("ts_ms", "event_id").limit(limit).select(F.col("line").alias("value"), F.lit(1).cast("long").alias("n")),
        "end_reasons": by(tasks, "end_reason"), "failed_by_executor": by(failed, "executor_id"), "failed_by_host": by(failed, "host"), "stage_attempts": by(stages, "stage_attempt"),
        "failure_reasons": by(stages.filter("failure_reason IS NOT NULL"), "failure_reason"), "query_status": by(queries, "status"), "tables_written": by(queries.filter("table_written IS NOT NULL"), "table_written"),
    }


def coverage_gaps(parts: DataFrame, expected: dict[str, str], rolled: DataFrame, factor: float = 1.8) -> DataFrame:
    """context, kind, what: logs that are missing and what that leaves unknown.

    expected: kind -> what is unknown without it; parts: context, kind of what is there; rolled: context, file, at of rolled files, whose usual step shows holes (W15).
    """
    contexts = parts.select("context").distinct()
    pairs = contexts.select("context", F.explode(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])).alias("kind", "what"))
    missing = pairs.join(parts.select("context", "kind").distinct(), ["context", "kind"], "left_anti")
    holes = W.series_gaps(rolled, ["context", "file"], "at", factor).groupBy("context").agg(F.count("*").alias("n")).select("context", F.lit("rolled files").alias("kind"), F.format_string("%d holes between rolled files", "n").alias("what"))
    return missing.unionByName(holes)


def stage_shares(tasks: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """Peak buckets (context, bucket) with the stage and executor that ran most in each and their shares (W10, A38). tasks: launch_ms, finish_ms, task_ms, stage_id, executor_id."""
    t = tasks.select("context", "stage_id", "executor_id", F.col("launch_ms").alias("s"), F.col("finish_ms").alias("e"), F.col("task_ms").cast("double").alias("ms"))
    per = I.bucket_spread(t, ["context", "stage_id", "executor_id"], "s", "e", ["ms"], width).join(buckets.select("context", "bucket"), ["context", "bucket"])
    out = buckets
    for c in ("stage_id", "executor_id"):
        s = A.share(per, ["context", "bucket"], [c], "ms")
        out = out.join(s.groupBy("context", "bucket").agg(F.max_by(c, F.struct("total", c)).alias(f"top_{c}"), F.max("share").alias(f"{c}_share")), ["context", "bucket"], "left")
    return out
