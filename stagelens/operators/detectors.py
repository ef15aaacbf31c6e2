"""Findings that take several tables: memory sites, log signals, exceptions, capacity, autoscaling, caches, loops and idle time.

Times are epoch milliseconds. Each gives category, entity, severity (0 high to 2 low), measure and the keys that it is about; thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.functions.text import OOM_TEXT, ddl_shape, oom_site

from . import aggregates as A
from . import intervals as I
from . import joins as J
from . import windows as W
from .findings import GB, HIGH, LOW, MEDIUM
from .graph import written

# fixed values: exception classes that fail work, and texts that healthy clusters log too
EXCEPTION_HIGH = r"OutOfMemoryError|SparkException|Py4JJavaError|PythonException"
EXCEPTION_BENIGN = r"_encryption_meta/manifest\.json|ExecutorJfrCollector|logs/jfr does not exist|No FileSystem for scheme|No filesystem implementation found|NoSuchFieldException.*Promise|Promise.*NoSuchFieldException|ServiceConfigurationError|SdkClientException\W+The requested metadata is not found at http://169\.254\.169\.254/|\[SHOULD_USE_AUTOSCALING_INFO\]"
REAL_LOSS = r"ExecutorLostFailure|Lost executor"
SHUTDOWN_SIGNALS = ("executor_lost", "cache_lost", "cache_dropped")
NAMED_EXECUTOR = r"executor (\d+)"
# end of fixed values


def found(df: DataFrame, category: str, entity: Column, severity: Column | int, measure: Column, keys: Sequence[str]) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, int) else severity
    return df.select(F.lit(category).alias("category"), entity.cast("string").alias("entity"), severity.cast("int").alias("severity"), measure.cast("double").alias("measure"), *keys)


def oom_site_findings(tasks: DataFrame) -> DataFrame:
    """A finding for each stage and place where its tasks ran out of memory, with the executors; tasks: context, stage_id, executor_id, finish_ms, failed, error."""
    bad = tasks.filter(F.col("failed") & F.col("error").rlike(OOM_TEXT)).withColumn("site", F.coalesce(oom_site(F.array().cast("array<string>"), F.col("error")), F.lit("unknown")))
    per = bad.groupBy("context", "stage_id", "site").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("executor_id")), ",").alias("executors"), F.min("finish_ms").alias("at_ms"))
    return found(per, "oom_site", F.concat_ws(" ", F.lit("stage"), "stage_id", "site"), HIGH, F.col("n"), ["context", "executors", "at_ms"])


def confirmed_signals(lines: DataFrame, stages: DataFrame, executors: DataFrame, shutdown_ms: int = 30_000) -> DataFrame:
    """lines (context, signal, ts_ms, line) that are not noise, of contexts with stages.

    A fetch failure counts only where a stage was tried again or failed of one; losses just before the context's last stage ended are its stop; losses that do not
    name a lost executor are planned where all removals were. Contexts without stages keep all.
    """
    per_stage = stages.groupBy("context").agg(F.bool_or((F.col("stage_attempt") > 0) | F.coalesce(F.col("failure_reason").contains("FetchFailed"), F.lit(False))).alias("__fetch"), F.max("end_ms").alias("__end"))
    gone = executors.filter("removed_ms IS NOT NULL").groupBy("context").agg(F.bool_or(~F.coalesce(F.col("removal_category").isin("autoscale", "termination"), F.lit(False))).alias("__real"))
    known = lines.filter("signal IS NOT NULL").join(per_stage, "context", "left").join(gone, "context", "left")
    noise = (
        ((F.col("signal") == "fetch_failure") & ~F.col("__fetch"))
        | (F.col("signal").isin(*SHUTDOWN_SIGNALS) & (F.col("ts_ms") >= F.col("__end") - shutdown_ms))
        | ((F.col("signal") == "executor_lost") & ~F.coalesce(F.col("__real"), F.lit(False)) & ~F.col("line").rlike(REAL_LOSS))
    )
    return known.filter(F.col("__fetch").isNull() | ~F.coalesce(noise, F.lit(False))).select(*lines.columns)


def signal_findings(lines: DataFrame, severities: dict[str, int]) -> DataFrame:
    """A finding for each signal of confirmed lines: lines, executors, first and last time, the earliest line."""
    s = A.summary(lines, ["signal"], "ts_ms", ["event_id"], ["executor_id"], ["line"])
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in severities.items() for x in kv]), F.col("signal"))
    return found(s, "log", F.col("signal"), F.coalesce(rank, F.lit(MEDIUM)), F.col("n"), ["n_executor_id", "first", "last", "line"])


def exception_findings(errors: DataFrame, high: str = EXCEPTION_HIGH, benign: str = EXCEPTION_BENIGN) -> DataFrame:
    """A finding for each error (exception, frame): occurrences, executors, sources; benign ones are low, those that fail work high."""
    per = errors.groupBy("exception", "frame").agg(F.count("*").alias("n"), F.countDistinct("executor_id").alias("executors"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("ts_ms").alias("at_ms"))
    c = F.col("exception")
    return found(per, "exception", F.concat_ws(" ", "exception", "frame"), F.when(c.rlike(benign), LOW).when(c.rlike(high), HIGH).otherwise(MEDIUM), F.col("n"), ["executors", "sources", "at_ms"])


def peak_cores(executors: DataFrame, until: DataFrame) -> DataFrame:
    """context, peak, peak_at: the most cores ever up at once. until: context, end_ms, which ends what was never removed."""
    up = executors.join(until, "context").select("context", "cores", F.col("added_ms").alias("s"), F.coalesce("removed_ms", "end_ms").alias("e"))
    return I.peak(up, ["context"], "s", "e", weight=F.col("cores"))


def ends_of(stages: DataFrame) -> DataFrame:
    return stages.groupBy("context").agg(F.max("end_ms").alias("end_ms"))


def core_hogs(stages: DataFrame, executors: DataFrame, runs: DataFrame, held_ms: int = 1_800_000, waited_ms: int = 60_000) -> DataFrame:
    """Per context the stage that held cores longest with more tasks than the peak cores, and how many runs that overlapped it had waited."""
    held = stages.withColumn("held", F.col("end_ms") - F.col("first_ms")).join(peak_cores(executors, ends_of(stages)), "context").filter((F.col("held") >= held_ms) & (F.col("tasks") > F.col("peak")))
    hog = W.top_n(held, ["context"], [F.desc("held"), F.col("stage_id"), F.col("stage_attempt")], 1)
    waited = runs.filter(F.col("wait_ms") >= waited_ms).select("context", "run_key", "wait_ms", F.col("start_ms").alias("r0"), F.col("end_ms").alias("r1"))
    behind = hog.join(waited, (hog["context"] == waited["context"]) & (F.col("r0") < F.col("end_ms")) & (F.col("r1") > F.col("first_ms"))).groupBy(hog["context"]).agg(F.count("*").alias("behind"), F.max_by("run_key", F.struct("wait_ms", "run_key")).alias("worst"))
    out = hog.join(behind, "context", "left").withColumn("behind", F.coalesce("behind", F.lit(0)))
    return found(out, "core_hog", F.concat_ws(" ", F.lit("stage"), "stage_id"), HIGH, F.col("held"), ["context", "peak", "behind", "worst"])


def cluster_sweep(queued: DataFrame, busy: DataFrame, cores: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column, width: int | None = None) -> DataFrame:
    """keys, t, until, queued, busy, cores: one sweep over three sets of intervals (the last weighted), in segments without a change. width: in two levels, for keys with too many rows for one task."""
    zero = F.lit(0)
    parts = [I.change_rows(df, keys, start, end, {c: (w if c == name else zero) for c in ("queued", "busy", "cores")}) for name, df, w in (("queued", queued, F.lit(1)), ("busy", busy, F.lit(1)), ("cores", cores, weight))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in ("queued", "busy", "cores")])
    return I.level_segments(rows, keys, "t", ["queued", "busy", "cores"], width)


def queue_episodes(sweep: DataFrame, keys: Sequence[str], gap: int = 2_000, at_least: int = 30_000, width: int | None = None) -> DataFrame:
    """keys, start, end, n, short: stretches with tasks queued on a full cluster below the most cores it had (gaps under 2 s closed), and the core time it was short of."""
    sweep = written(sweep)
    most = sweep.groupBy(*keys).agg(F.max("cores").alias("most"))
    full = sweep.join(most, list(keys)).filter((F.col("queued") > 0) & (F.col("busy") >= F.col("cores")) & (F.col("cores") < F.col("most")))
    full = full.select(*keys, F.col("t").alias("start"), F.col("until").alias("end"), (F.least("queued", F.col("most") - F.col("cores")) * (F.col("until") - F.col("t"))).alias("short"))
    return I.merge_intervals(full, keys, "start", "end", gap - 1, ["short"], width).filter(F.col("end") - F.col("start") >= at_least)


def autoscale_lags(episodes: DataFrame, executors: DataFrame, keys: Sequence[str], lag_ms: int = 120_000, short_ms: int = 600_000, high_ms: int = 300_000) -> DataFrame:
    """Per key: how long after the first queue episode the first new executor came, if long, and the core time short in all episodes."""
    first = episodes.groupBy(*keys).agg(F.min("start").alias("queue_ms"), F.sum("short").alias("short"))
    added = executors.select(*keys, "added_ms")
    out = J.asof_join(first, added, keys, "queue_ms", "added_ms", ["added_ms"], forward=True, strict=True).withColumn("lag", F.col("added_ms") - F.col("queue_ms"))
    return found(out.filter((F.col("lag") >= lag_ms) & (F.col("short") >= short_ms)), "autoscale_lag", F.concat_ws(" ", *keys), F.when(F.col("lag") >= high_ms, HIGH).otherwise(MEDIUM), F.col("lag"), [*keys, "queue_ms", "short"])


def autoscale_removals(executors: DataFrame, stages: DataFrame, lines: DataFrame, gap: int = 120_000, many: int = 100) -> DataFrame:
    """Per context and burst of autoscale removals: executors gone, stages running meanwhile, and cached blocks that log lines call lost before the next burst.

    A line goes to the last removal of any kind at or before it, in whole seconds; it counts if that removal is in the burst.
    """
    gone = executors.filter("removed_ms IS NOT NULL")
    auto = gone.filter("removal_category = 'autoscale'")
    runs = I.bursts(auto, ["context"], "removed_ms", gap, 1).withColumn("next", F.lead("start").over(Window.partitionBy("context").orderBy("start")))
    meet = I.overlap_join(runs.select("context", F.col("start").alias("l_start"), F.col("end").alias("l_end")), stages.select("context", "stage_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")), ["context"], 3_600_000, closed=True)
    active = meet.groupBy("context", F.col("l_start").alias("start")).agg(F.count("*").alias("active"), F.min("stage_id").alias("stage_id"))
    second = lambda c: F.floor(F.col(c) / 1000) * 1000
    lost = lines.filter("signal = 'cache_lost'").select("context", "ts_ms")
    owned = J.asof_join(lost, gone.select("context", second("removed_ms").alias("at"), "executor_id", "removed_ms", "removal_category"), ["context"], "ts_ms", "at", ["at", "executor_id", "removed_ms", "removal_category"])
    owned = owned.filter("removal_category = 'autoscale'").join(runs, "context").filter("removed_ms BETWEEN start AND `end` AND ts_ms >= floor(start / 1000) * 1000 AND (next IS NULL OR ts_ms < next)").groupBy("context", "start").agg(F.count("*").alias("lost"))
    out = runs.join(active, ["context", "start"], "left").join(owned, ["context", "start"], "left").fillna(0, ["active", "lost"]).filter("active > 0 OR lost > 0")
    return found(out, "autoscale_removed", F.col("n"), F.when(F.col("lost") >= many, HIGH).otherwise(MEDIUM), F.col("lost"), ["context", "start", "end", "active", "stage_id"])


def cores_full(runs: DataFrame, executors: DataFrame, ends: DataFrame, wait_ms: int = 1_800_000, share: float = 0.2, high_share: float = 0.4) -> DataFrame:
    """Per context whose runs together waited long: the peak of runs at once, when, and the cores up then."""
    sums = runs.groupBy("context").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"), F.sum("wait_ms").alias("wait"), F.count("*").alias("runs"), F.max_by("run_key", F.struct("wait_ms", "run_key")).alias("worst"))
    out = sums.filter((F.col("total") > 0) & (F.col("wait") >= wait_ms) & (F.col("wait") >= share * F.col("total"))).join(I.peak(runs, ["context"], "start_ms", "end_ms"), "context")
    up = executors.join(out.select("context", "peak_at"), "context").filter("added_ms <= peak_at AND (removed_ms IS NULL OR removed_ms > peak_at)").groupBy("context").agg(F.sum("cores").alias("cores_then"))
    out = out.join(up, "context", "left").join(peak_cores(executors, ends).select("context", F.col("peak").alias("cores_most")), "context", "left")
    return found(out, "cores_full", F.col("runs"), F.when(F.col("wait") >= high_share * F.col("total"), HIGH).otherwise(MEDIUM), F.col("wait"), ["context", "peak", "peak_at", "cores_then", "cores_most", "worst"])


def tiny_task_stages(stages: DataFrame, keys: Sequence[str] = ("context",), at_least: int = 10, tasks_min: int = 20, p50_ms: int = 100, p50_bytes: int = 64 << 10, share: float = 0.3, floor: int = 1000) -> DataFrame:
    """Many stages cut into the same number of tiny tasks that together are a large share of all tasks. stages: keys, tasks, p50_task_ms, p50_bytes, duration_ms."""
    keys = list(keys)
    total = stages.groupBy(*keys).agg(F.sum("tasks").alias("__all"))
    tiny = stages.filter((F.col("tasks") >= tasks_min) & (F.col("p50_task_ms") <= p50_ms) & (F.coalesce("p50_bytes", F.lit(0)) <= p50_bytes))
    per = tiny.groupBy(*keys, "tasks").agg(F.count("*").alias("stages"), F.sum("duration_ms").alias("ms")).withColumn("n", F.col("stages") * F.col("tasks"))
    out = per.join(total, keys).filter((F.col("stages") >= at_least) & (F.col("n") >= F.greatest(F.lit(float(floor)), share * F.col("__all"))))
    return found(out, "tiny_task_stages", F.concat_ws(" x ", "stages", "tasks"), F.when(F.col("ms") >= 60_000, MEDIUM).otherwise(LOW), F.col("n"), [*keys, "ms"])


def empty_inputs(queries: DataFrame, empty: Column, least_ms: int = 600_000, high_ms: int = 3_600_000, records: int = 1_000_000, bytes_: int = 64 << 20) -> DataFrame:
    """Per context: queries whose plan became an empty relation, counted at their root, and their time in all. Queries that read much anyway are none."""
    e = queries.filter(empty).select("context", "sql_execution_id", "root_execution_id", "run_key", "duration_ms", "input_records", "input_bytes")
    roots = e.select("context", F.col("sql_execution_id").alias("root_execution_id")).distinct()
    child = e.filter(F.col("root_execution_id") != F.col("sql_execution_id")).join(roots, ["context", "root_execution_id"], "left_semi").select("context", "sql_execution_id")
    e = e.join(child, ["context", "sql_execution_id"], "left_anti").filter((F.coalesce("input_records", F.lit(0)) < records) & (F.coalesce("input_bytes", F.lit(0)) < bytes_))
    per = e.groupBy("context").agg(F.count("*").alias("queries"), F.countDistinct("run_key").alias("runs"), F.sum("duration_ms").alias("ms"), F.max_by("sql_execution_id", F.struct("duration_ms", "sql_execution_id")).alias("longest")).filter(F.col("ms") >= least_ms)
    return found(per, "empty_input", F.col("queries"), F.when(F.col("ms") >= high_ms, MEDIUM).otherwise(LOW), F.col("ms"), ["context", "runs", "longest"])


def ddl_loops(queries: DataFrame, more_than: int = 10) -> DataFrame:
    """Per run and statement shape: more ALTERs than that. queries: context, run_key, description, duration_ms."""
    per = queries.withColumn("shape", ddl_shape(F.col("description"))).filter("shape IS NOT NULL").groupBy("context", "run_key", "shape").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms")).filter(F.col("n") > more_than)
    return found(per, "ddl_loop", F.col("shape"), F.when(F.col("ms") >= 60_000, MEDIUM).otherwise(LOW), F.col("n"), ["context", "run_key", "ms"])


def count_only_runs(queries: DataFrame, runs: DataFrame, counts: Column, least_ms: int = 60_000, share: float = 0.1, high_share: float = 0.3) -> DataFrame:
    """Per run: queries that only count rows (the condition), if they cost much of it. queries: run_key, duration_ms, busy_ms; runs: run_key, start_ms, end_ms."""
    cost = F.least("duration_ms", F.coalesce("busy_ms", F.lit(0)))
    per = queries.filter(counts).withColumn("cost", cost).filter("cost > 0").groupBy("run_key").agg(F.count("*").alias("n"), F.sum("cost").alias("ms"))
    out = per.join(runs.groupBy("run_key").agg((F.max("end_ms") - F.min("start_ms")).alias("dur")), "run_key").filter((F.col("ms") >= least_ms) & (F.col("ms") >= share * F.col("dur")))
    return found(out, "count_only", F.col("run_key"), F.when(F.col("ms") >= high_share * F.col("dur"), HIGH).otherwise(MEDIUM), F.col("ms"), ["n"])


def dedup_noops(queries: DataFrame, dedup: Column, rows: int = 10_000_000) -> DataFrame:
    """Queries that deduplicate (the condition) and give back as many rows as they read."""
    q = queries.filter(dedup & (F.col("input_records") >= rows) & (F.col("output_records") == F.col("input_records")))
    return found(q, "dedup_noop", F.col("sql_execution_id"), F.when(F.coalesce("shuffle_read", F.lit(0)) >= 100 * GB, MEDIUM).otherwise(LOW), F.col("input_records"), ["context", "run_key"])


def disk_caches(reads: DataFrame, written: int = 10 * GB, hit_share: float = 0.1) -> DataFrame:
    """Per context: the disk cache wrote much and served little. reads: context, hit, miss, written (bytes)."""
    per = reads.groupBy("context").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.sum("written").alias("written"))
    out = per.filter((F.col("hit") + F.col("miss") > 0) & (F.col("written") >= written) & (F.col("hit") < hit_share * (F.col("hit") + F.col("miss"))))
    return found(out, "disk_cache", F.col("context"), LOW, F.col("written"), ["hit", "miss"])


def dataframe_caches(cached: DataFrame, executors: DataFrame, ends: DataFrame, lines: DataFrame, many: int = 100) -> DataFrame:
    """Per context that reads a cache: its largest one against the memory that the executors alive at once had, and blocks that did not fit, were dropped or lost.

    cached: context, sql_execution_id, cache_bytes; executors with unified_memory; lines with signal.
    """
    big = cached.groupBy("context").agg(F.count("*").alias("queries"), F.max("cache_bytes").alias("big"), F.max_by("sql_execution_id", F.struct("cache_bytes", "sql_execution_id")).alias("query"))
    up = executors.join(ends, "context").select("context", "unified_memory", F.col("added_ms").alias("s"), F.coalesce("removed_ms", "end_ms").alias("e"))
    room = up.groupBy("context").agg(F.max("unified_memory").alias("per")).join(I.peak(up, ["context"], "s", "e"), "context").select("context", (F.col("per") * F.col("peak")).alias("room"))
    said = lines.groupBy("context").agg(*[F.count_if(F.col("signal") == s).alias(s) for s in ("cache_not_fit", "cache_dropped", "cache_lost")])
    out = big.join(room, "context", "left").join(said, "context", "left").fillna(0, ["cache_not_fit", "cache_dropped", "cache_lost"])
    out = out.filter((F.coalesce(F.col("big") > F.col("room"), F.lit(False))) | (F.col("cache_not_fit") + F.col("cache_dropped") + F.col("cache_lost") > 0))
    bad = F.coalesce(F.col("big") > 2 * F.col("room"), F.lit(False)) | (F.col("cache_lost") >= many) | (F.col("cache_not_fit") >= many)
    return found(out, "dataframe_cache", F.col("query"), F.when(bad, HIGH).otherwise(MEDIUM), F.col("big"), ["context", "queries", "room", "cache_lost"])


def no_stage_time(runs: DataFrame, stages: DataFrame, statements: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, total, no_stage, inside, between: a run's time, what of it no stage covers, and how much of that lies inside and between its statements."""
    span = runs.groupBy(key).agg(F.min(start).alias(start), F.max(end).alias(end))
    idle = I.subtract_intervals(span, stages, [key], start, end)
    between = I.subtract_intervals(idle, statements, [key], start, end)
    length = lambda df, name: df.groupBy(key).agg(F.sum(F.col(end) - F.col(start)).alias(name))
    out = length(span, "total").join(length(idle, "no_stage"), key, "left").join(length(between, "between"), key, "left").fillna(0, ["no_stage", "between"])
    return out.withColumn("inside", F.col("no_stage") - F.col("between"))


def init_scripts(lines: DataFrame, executors: DataFrame, wait_ms: int = 900_000, bad: str = r"(?i)\b(error|fatal|failed|cannot|not found|permission denied)\b") -> DataFrame:
    """Per script: nodes whose output has error lines, the lines, the first of them, and the longest time until an executor came up on such a node.

    lines: script, host, ts_ms, line; executors: host, added_ms.
    """
    errors = lines.filter(F.col("line").rlike(bad))
    ran = lines.groupBy("script", "host").agg(F.min("ts_ms").alias("t"))
    joined = J.asof_join(ran, executors.select("host", "added_ms"), ["host"], "t", "added_ms", ["added_ms"], forward=True, width=wait_ms).withColumn("took", F.col("added_ms") - F.col("t"))
    slow = joined.filter(F.col("took") <= wait_ms).groupBy("script").agg(F.max("took").alias("join_ms"))
    per = errors.groupBy("script").agg(F.countDistinct("host").alias("nodes"), F.count("*").alias("n"), F.min_by("line", F.struct("ts_ms", "line")).alias("first")).join(slow, "script", "left")
    return found(per, "init_script", F.col("script"), MEDIUM, F.col("n"), ["nodes", "first", "join_ms"])


def settled_states(queries: DataFrame, replanned: Column) -> DataFrame:
    """queries with status replanned where the failure was only adaptive execution's new plan, and with the root's name of the table where a child, run for it, knows its table by a path or not at all."""
    named = ~F.col("table_written").contains("/")
    roots = queries.filter(named).groupBy("context", F.col("sql_execution_id").alias("root_execution_id")).agg(F.min("table_written").alias("__t"))
    out = queries.join(roots, ["context", "root_execution_id"], "left")
    child = F.col("root_execution_id") != F.col("sql_execution_id")
    out = out.withColumn("table_written", F.when(child & ~F.coalesce(named, F.lit(False)), F.coalesce("__t", "table_written")).otherwise(F.col("table_written"))).drop("__t")
    return out.withColumn("status", F.when((F.col("status") == "failed") & F.coalesce(replanned, F.lit(False)), "replanned").otherwise(F.col("status")))


def quieter(findings: DataFrame, queries: DataFrame, explained: Sequence[str]) -> DataFrame:
    """findings with the failures of queries that have no run (orphans) made low, and log findings of the explained signals made low where there is such an orphan."""
    orphans = queries.filter("run_key IS NULL AND status = 'failed'").select(F.col("sql_execution_id").cast("string").alias("entity")).distinct()
    out = findings.join(orphans.withColumn("__o", F.lit(True)), "entity", "left")
    any_ = orphans.limit(1).agg((F.count("*") > 0).alias("__any"))
    out = out.join(F.broadcast(any_))  # one row
    low = (F.col("category") == "query_failed") & F.col("__o").isNotNull() | (F.col("category") == "log") & F.col("entity").isin(*explained) & F.col("__any")
    return out.withColumn("severity", F.when(low, LOW).otherwise(F.col("severity"))).select(*findings.columns)
