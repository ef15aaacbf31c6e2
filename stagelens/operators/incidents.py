"""Incidents: findings with what they are about, the same problem seen several ways, causes and effects, and who plays which role.

Everything a finding is about is a row (type, key): a stage attempt, an executor, a host, a query, a message, a frame. Named things come from the finding's own
columns, from its text and from the lines and errors behind it; stages are also inferred from the tasks that ran on its executor then, and marked so.

* Findings are one problem through shared rows: each points to the least finding of its row, or to the one before it in time if that is near. No pairs of a
  row are made; components of these few edges are the problems.
* A cause is looked up, not joined: for each row of an effect and each kind that may cause it, the last such problem that had begun by then (an as-of join).
  So a row has at most one candidate a kind, however many problems share it.
* Best causes rise in level, so that the edges are a forest; roots and paths come by doubling pointers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, follow_paths, written
from .intervals import overlap_join
from .joins import asof_each, asof_join
from .windows import numbered

# fixed values: kinds of problems with their label and level (causes have lower levels), what category is which kind, what may cause what and why
KINDS = {
    "skew": ("task skew", 0), "tiny": ("too many tiny tasks", 0), "large": ("tasks too big", 0), "big_read": ("big table read", 0), "idle": ("executors idle", 0), "driver": ("time on the driver, no Spark work", 0),
    "count": ("queries that only counted rows", 0), "spill": ("disk spill", 1), "cache": ("DataFrame cache larger than memory", 1), "gc": ("GC pressure", 2), "oom": ("out of memory", 3),
    "killed": ("executor killed by the OS", 3), "disk_full": ("disk full", 3), "lost": ("executor lost", 4), "autoscale": ("autoscaling removed executors mid-work", 4), "fetch": ("shuffle fetch failure", 5),
    "task_error": ("error in task code", 5), "source_db": ("source database connection", 5), "driver_error": ("error in driver code", 5), "other_error": ("error", 5), "retries": ("task retries", 6),
    "stage_failed": ("stage failed", 6), "job_aborted": ("job aborted", 7), "query_failed": ("query failed", 8), "reported": ("error reported to the notebook / job", 9),
}
CATEGORIES = {
    "task_skew": "skew", "tiny_tasks": "tiny", "tiny_task_stages": "tiny", "no_spark_work": "driver", "count_only": "count", "large_tasks": "large", "big_read": "big_read", "executors_idle": "idle",
    "disk_spill": "spill", "log:disk_spill": "spill", "gc_pressure": "gc", "log:gc_pressure": "gc", "jvm_full_gc": "gc", "gc_stuck": "gc", "executor_oom": "oom", "oom_site": "oom", "log:executor_oom": "oom",
    "executor_killed": "killed", "log:disk_full": "disk_full", "executor_lost": "lost", "log:executor_lost": "lost", "log:fetch_failure": "fetch", "log:python_error": "task_error", "task_retries": "retries",
    "stage_failed": "stage_failed", "query_failed": "query_failed", "dataframe_cache": "cache", "autoscale_removed": "autoscale",
}
OUTSIDE = ("capacity_bound", "autoscale_lag", "cores_full", "waited_for_cores", "merge_rewrite", "ddl_loop", "disk_cache", "init_script", "dedup_noop", "jdbc_one_partition", "empty_input", "core_hog")
PERFORMANCE = ("skew", "tiny", "large", "big_read", "idle", "driver", "count", "spill", "gc")
ERRORS = ("task_error", "driver_error", "other_error", "reported", "source_db")
FAILURES = ("oom", "killed", "disk_full", "lost", "fetch", "task_error", "source_db", "driver_error", "stage_failed", "job_aborted", "query_failed", "reported")
CAUSES = {
    "spill": ("skew", "large", "cache"), "gc": ("skew", "spill", "large", "cache"), "oom": ("skew", "spill", "gc", "large", "cache"), "killed": ("skew", "spill", "gc", "oom", "cache"), "disk_full": ("spill",),
    "lost": ("oom", "killed", "disk_full"), "fetch": ("oom", "killed", "lost", "disk_full", "autoscale"), "other_error": ("oom", "killed", "lost", "fetch", "disk_full", "autoscale"),
    "retries": ("oom", "killed", "lost", "fetch", "task_error", "other_error", "disk_full", "autoscale", "source_db"), "stage_failed": ("oom", "killed", "lost", "fetch", "task_error", "other_error", "disk_full", "autoscale", "source_db"),
    "job_aborted": ("stage_failed", "task_error", "other_error"), "query_failed": ("stage_failed", "job_aborted", "task_error", "driver_error", "other_error"), "reported": ("query_failed", "job_aborted", "stage_failed", "driver_error"),
}
BECAUSE = {
    ("skew", "spill"): "one partition is much bigger than the rest, so its task holds far more data than memory fits", ("skew", "oom"): "one partition is much bigger than the rest, so its task needed far more memory",
    ("skew", "gc"): "the oversized partition fills the heap, so the JVM keeps collecting", ("large", "spill"): "each task was given far more data than the ~128 MiB a task is sized for, more than its memory holds",
    ("spill", "oom"): "data did not fit in memory: spilling usually comes before running out of it", ("gc", "oom"): "the heap stayed full after collections, then ran out",
    ("oom", "lost"): "the executor ran out of memory, so its process was killed", ("killed", "lost"): "the OS killed the executor process",
    ("oom", "fetch"): "the executor that ran out of memory held shuffle files; once it died other tasks could not read them", ("killed", "fetch"): "the killed executor held shuffle files other tasks needed",
    ("lost", "fetch"): "the lost executor held shuffle files other tasks needed", ("lost", "retries"): "tasks running on the lost executor had to run again elsewhere", ("fetch", "retries"): "tasks that could not read their shuffle input were retried",
    ("fetch", "stage_failed"): "a stage fails as soon as its shuffle input cannot be read; Spark then re-runs the stage before it",
    ("task_error", "stage_failed"): "the same task kept failing (spark.task.maxFailures, 4 by default), so Spark gave up on the stage", ("oom", "stage_failed"): "tasks of this stage were running on the executor that ran out of memory",
    ("lost", "stage_failed"): "tasks of this stage were running on the executor that was lost", ("stage_failed", "job_aborted"): "a stage that fails for good aborts its job", ("stage_failed", "query_failed"): "the query's stage failed for good",
    ("job_aborted", "query_failed"): "the aborted job belongs to this query", ("driver_error", "query_failed"): "the error was raised in the driver while the query ran", ("query_failed", "reported"): "the query failure is what the notebook or job saw",
}
STAGE = r"(?i)\bstage (\d+)\.(\d+)"
EXECUTOR = r"(?i)\bexecutor (\d+)\b(?! exited caused by)"
LOST_HOST = r"(?i)Lost executor \d+ on ([\w.\-]+)"
FETCH_HOST = r"(?i)(?:connect to|from) (?:[\w.\-]+/|/)?([\w.\-]+?):\d+"
CALL = r"calling o\d+\.(\w+)"
SOURCE_DB = r"connection timed out|connect timed out|sockettimeoutexception|read timed out|data receive failed|connection reset|cannot open socket|communications link failure|socket timeout|cannot connect to|timeoutexception|connection refused|cannot_open_socket"
JDBC_VENDOR = r"jdbc|com\.sap\.db|com\.microsoft\.sqlserver|org\.postgresql|com\.mysql|org\.mariadb|com\.ibm\.db2|net\.snowflake|com\.teradata"
SAME_MS, ERROR_MS, LINK_MS, LATE_MS, QUERY_ERROR_MS, RUNNING_MS, OPEN_MS = 120_000, 2_000, 1_800_000, 5_000, 10_000, 2_000, 60_000
CONFIDENCE = {3: "strong", 2: "likely", 1: "weak"}
# end of fixed values

#: Where the last cause by time is looked for, in buckets of this width.
WIDTH = 86_400_000


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def finding_kinds(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Findings that take part in incidents, with kind, label and level. An exception's kind comes from its class, messages and frames."""
    behind = errors.groupBy("fingerprint").agg(
        F.lower(F.concat_ws(" ", F.sort_array(F.collect_set("message")))).alias("__message"), F.lower(F.concat_ws(" ", F.sort_array(F.collect_set("user_frame")))).alias("__frames"),
        F.bool_and((F.col("source") == "driver") & F.col("executor_id").isNull()).alias("__driver"),
    )
    f = findings.filter(~F.coalesce(F.col("category").isin(*OUTSIDE), F.lit(False))).join(behind, "fingerprint", "left")
    name, said = F.lower(F.coalesce("entity", F.lit(""))), F.coalesce("__message", F.lit(""))
    shown = F.concat_ws(" ", "__frames", F.lower("evidence"))
    on_driver = F.coalesce("__driver", F.lit(False))
    exception = (
        F.when(name.contains("outofmemory"), "oom")
        .when(name.contains("fetchfailed") | (name.contains("ioexception") & said.rlike("shuffleblockfetcher|fetchfailed")), "fetch")
        .when(F.concat_ws(" ", said, name).rlike(SOURCE_DB) & F.concat_ws(" ", said, name, shown).rlike(JDBC_VENDOR), "source_db")
        .when(F.concat_ws(" ", said, F.lower("evidence")).contains("job aborted"), "job_aborted")
        .when(name.contains("py4jjavaerror") | (name.startswith("pyspark.errors") & on_driver), "reported")
        .when((F.coalesce("__frames", F.lit("")) != "") | name.rlike("python|error"), F.when(on_driver, "driver_error").otherwise("task_error"))
        .otherwise("other_error")
    )
    kind = F.when(F.col("category") == "exception", exception).otherwise(F.coalesce(F.try_element_at(_map(CATEGORIES), F.col("category")), F.lit("other_error")))
    own = F.when(F.col("category").startswith("log:"), F.translate(F.substring("category", 5, 99), "_", " ")).when(F.col("entity").isNotNull(), F.concat(F.lit("error: "), F.substring_index("entity", ".", -1)))
    f = f.withColumn("kind", kind)
    label = F.element_at(_map({k: v[0] for k, v in KINDS.items()}), F.col("kind"))
    return f.withColumn("label", F.when(F.col("kind") == "other_error", F.coalesce(own, label)).otherwise(label)).withColumn("level", F.element_at(_map({k: v[1] for k, v in KINDS.items()}), F.col("kind"))).drop("__message", "__frames", "__driver")


def normal(text: Column) -> Column:
    """A message for comparison; null if it is empty."""
    return F.nullif(F.substring(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 1, 120), F.lit(""))


def named_in(text: Column) -> Column:
    """What a text names: an array of (type, id, attempt)."""
    thing = lambda kind, ident, attempt=None: F.struct(F.lit(kind).alias("type"), ident.alias("id"), (F.lit(None).cast("string") if attempt is None else attempt).alias("attempt"))
    every = lambda pattern, i=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    stages = F.transform(F.arrays_zip(every(STAGE).alias("a"), every(STAGE, 2).alias("b")), lambda x: thing("stage", x["a"], x["b"]))
    rest = [_each(every(p), kind, thing) for kind, p in (("executor", EXECUTOR), ("host", LOST_HOST), ("fetch_host", FETCH_HOST), ("call", CALL))]
    return F.concat(stages, *rest)


def _each(found: Column, kind: str, thing: Callable[[str, Column], Column]) -> Column:
    return F.transform(found, lambda x: thing(kind, F.lower(x) if kind == "call" else x))


def with_context(named: DataFrame, stages: DataFrame, executors: DataFrame) -> DataFrame:
    """named: type, id, ts, context... -> the context filled in: of the stage or executor of that id which was there then, else of the only one of that id."""
    owners = stages.select(F.lit("stage").alias("type"), F.col("stage_id").cast("string").alias("id"), F.col("context").alias("__c"), (F.col("start_ms") - OPEN_MS).alias("__from"), (F.col("end_ms") + OPEN_MS).alias("__to"))
    owners = owners.unionByName(executors.select(F.lit("executor").alias("type"), F.col("executor_id").alias("id"), F.col("context").alias("__c"), F.col("added_ms").alias("__from"), F.col("removed_ms").alias("__to")))
    asked = named.filter("context IS NULL AND type IN ('stage', 'executor')").select("type", "id", "ts").distinct()
    here = F.col("ts").between(F.coalesce("__from", "ts"), F.coalesce("__to", "ts"))
    known = asked.join(owners, ["type", "id"]).groupBy("type", "id", "ts").agg(F.min(F.when(here, F.col("__c"))).alias("__then"), F.min("__c").alias("__least"), F.max("__c").alias("__most"))
    known = known.select("type", "id", F.col("ts").alias("__t"), F.coalesce("__then", F.when(F.col("__least") == F.col("__most"), F.col("__least"))).alias("__known"))
    out = named.join(known.withColumnsRenamed({"type": "__type", "id": "__id"}), (F.col("type") == F.col("__type")) & (F.col("id") == F.col("__id")) & F.col("ts").eqNullSafe(F.col("__t")), "left")
    return out.withColumn("context", F.coalesce("context", "__known")).drop("__type", "__id", "__t", "__known")


def key_of(*parts: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("?")) for p in parts])


def finding_scopes(findings: DataFrame, stages: DataFrame, executors: DataFrame, tasks: DataFrame, lines: DataFrame, errors: DataFrame, width: int = 3_600_000, infer: Sequence[str] | None = None) -> DataFrame:
    """finding_id, event (null, or the number of the finding's line or error), ts, type, key, inferred: all that each finding is about.

    infer: only findings of these kinds take the stages that ran on their executor then (all: null). Problems by themselves need them for ERRORS alone; there are as many
    such rows as tasks ran at each finding's time.

    findings are those of finding_kinds. Types: stage, executor, host, fetch_host, query, text, call, run.
    """
    base = findings.select("finding_id", F.lit(None).cast("long").alias("event"), "ts", "context", "kind", "category", "stage_id", "stage_attempt", "executor_id", "sql_execution_id", "evidence", "run_key")
    behind_lines = findings.filter("signal IS NOT NULL").select("finding_id", "kind", "signal").join(lines.select("signal", "line", F.col("ts"), "context", "executor_id"), "signal")
    behind_errors = findings.filter("fingerprint IS NOT NULL").select("finding_id", "kind", "fingerprint").join(errors.select("fingerprint", F.col("message").alias("line"), "ts", "context", "executor_id", "user_frame"), "fingerprint")
    behind = behind_lines.select("finding_id", F.xxhash64("line", "ts", "executor_id").alias("event"), "ts", "context", "kind", "executor_id", "line")
    # errors belong to the finding as a whole: their times stay with them
    whole = behind_errors.select("finding_id", F.lit(None).cast("long").alias("event"), "ts", "context", "kind", "executor_id", "line")
    thing = lambda kind, ident, attempt=None: F.when(ident.isNotNull(), F.struct(F.lit(kind).alias("type"), ident.cast("string").alias("id"), (F.lit(None) if attempt is None else attempt).cast("string").alias("attempt")))
    own = F.array_compact(F.array(thing("stage", F.col("stage_id"), F.coalesce("stage_attempt", F.lit(0))), thing("executor", F.col("executor_id")), thing("query", F.col("sql_execution_id")), thing("run", F.col("run_key"))))
    autoscaled = F.when(F.col("kind") == "autoscale", F.transform(F.split(F.regexp_replace(F.regexp_extract("evidence", r"removed \d+ executors? \(([\w, ]+)\)", 1), " ", ""), ","), lambda x: thing("executor", x)))
    rows = base.withColumn("__n", F.concat(own, named_in(F.coalesce("evidence", F.lit(""))), F.coalesce(autoscaled, F.array().cast("array<struct<type:string,id:string,attempt:string>>")))).select("finding_id", "event", "ts", "context", "kind", F.explode("__n").alias("__n"))
    more = behind.unionByName(whole).withColumn("__n", F.concat(named_in(F.coalesce("line", F.lit(""))), F.array_compact(F.array(thing("executor", F.col("executor_id")))))).select("finding_id", "event", "ts", "context", "kind", F.explode("__n").alias("__n"))
    named = with_context(rows.unionByName(more).select("finding_id", "event", "ts", "context", "kind", "__n.*").filter("id <> ''"), stages, executors)
    key = F.when(F.col("type") == "stage", key_of("context", "id", "attempt")).when(F.col("type").isin("executor", "query"), key_of("context", "id")).otherwise(F.col("id"))
    named = named.withColumn("key", key).withColumn("inferred", F.lit(False)).select("finding_id", "event", "ts", "kind", "type", "key", "inferred")
    named = written(named)
    # a failed query stands for its stages
    stage_key = stages.select(key_of("context", "stage_id", "stage_attempt").alias("__stage"), F.when(F.col("sql_execution_id").isNotNull(), key_of("context", "sql_execution_id")).alias("__query"))
    of_query = named.filter("type = 'query' AND kind = 'query_failed'").join(stage_key, F.col("key") == F.col("__query")).select("finding_id", "event", "ts", "kind", F.lit("stage").alias("type"), F.col("__stage").alias("key"), "inferred")
    # the stages whose tasks ran on the executor then
    at = named.filter(~F.col("kind").isin(*PERFORMANCE, "stage_failed", "query_failed", "retries") & (F.col("type") == "executor") & F.col("ts").isNotNull())
    at = at if infer is None else at.filter(F.col("kind").isin(*infer))
    at = at.select("finding_id", "event", "ts", "kind", F.col("key").alias("__e"), (F.col("ts") - RUNNING_MS).alias("l_start"), (F.col("ts") + RUNNING_MS).alias("l_end"))
    ran = tasks.filter("executor_id IS NOT NULL AND launch_ms IS NOT NULL").select(key_of("context", "executor_id").alias("__e"), key_of("context", "stage_id", "stage_attempt").alias("key"), F.col("launch_ms").alias("r_start"), F.coalesce("finish_ms", "launch_ms").alias("r_end"))
    inferred = overlap_join(at, ran, ["__e"], width, closed=True).select("finding_id", "event", "ts", "kind", F.lit("stage").alias("type"), "key", F.lit(True).alias("inferred"))
    text = F.array(normal(F.col("line")), normal(F.col("user_frame")))
    texts = behind_errors.select("finding_id", F.lit(None).cast("long").alias("event"), "ts", "kind", F.explode(text).alias("key"))
    texts = texts.unionByName(findings.filter("category IN ('stage_failed', 'query_failed')").select("finding_id", F.lit(None).cast("long").alias("event"), "ts", "kind", normal(F.col("evidence")).alias("key")))
    texts = texts.filter("key IS NOT NULL").select("finding_id", "event", "ts", "kind", F.lit("text").alias("type"), "key", F.lit(False).alias("inferred"))
    rows = named.unionByName(of_query).unionByName(inferred).unionByName(texts)
    # a stage that is named is not inferred too
    rows = written(rows.groupBy("finding_id", "event", "ts", "kind", "type", "key").agg(F.bool_and("inferred").alias("inferred")))
    hosts = executors.filter("host IS NOT NULL").select(key_of("context", "executor_id").alias("__k"), F.col("host").alias("__v"))
    hosts = rows.filter("type = 'executor'").join(hosts, F.col("key") == F.col("__k")).select("finding_id", "event", "ts", "kind", F.lit("host").alias("type"), F.col("__v").alias("key"), "inferred")
    queries = rows.filter("type = 'stage'").join(stage_key.filter("__query IS NOT NULL"), F.col("key") == F.col("__stage")).select("finding_id", "event", "ts", "kind", F.lit("query").alias("type"), F.col("__query").alias("key"), "inferred")
    return rows.unionByName(hosts).unionByName(queries).groupBy("finding_id", "event", "ts", "kind", "type", "key").agg(F.bool_and("inferred").alias("inferred"))


def _star(rows: DataFrame, keys: Sequence[str], hub: Column | None = None) -> DataFrame:
    """u, v: each finding and the least one (of those that hub marks) with its keys."""
    least = rows.groupBy(*keys).agg(F.min("finding_id" if hub is None else F.when(hub, F.col("finding_id"))).alias("v")).filter("v IS NOT NULL")
    return rows.join(least, list(keys)).select(F.col("finding_id").alias("u"), "v")


def _chain(rows: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """u, v: findings whose times are within gap of the one before them with their keys. A finding without a time is near all."""
    w = Window.partitionBy(*keys).orderBy("ts", "finding_id")
    timed = rows.filter("ts IS NOT NULL").withColumn("v", F.lag("finding_id").over(w)).withColumn("__d", F.col("ts") - F.lag("ts").over(w))
    timeless = rows.join(rows.filter("ts IS NULL").select(*keys).distinct(), list(keys), "left_semi")
    return timed.filter(F.col("__d") <= gap).select(F.col("finding_id").alias("u"), "v").unionByName(_star(timeless, keys))


def problem_members(findings: DataFrame, scopes: DataFrame, same_ms: int = SAME_MS, error_ms: int = ERROR_MS) -> DataFrame:
    """finding_id, problem (the least finding of it).

    Performance problems of one kind are one if they share a stage; failures, if they share a named stage, an executor within same_ms, or a text (on executors that
    agree); errors, if they share a text, a named stage, or an executor (or none) within error_ms. A finding of several lines joins the one problem that most
    of its lines match, and links none.
    """
    several = scopes.filter("event IS NOT NULL").groupBy("finding_id").agg(F.countDistinct("event").alias("__n")).filter("__n > 1").select("finding_id")
    # mostly no finding is of several lines: then nothing is set apart for them, and nothing voted on
    some = not several.isEmpty()
    without = lambda df: df.join(several, "finding_id", "left_anti") if some else df
    one = without(scopes)
    performance, error = F.col("kind").isin(*PERFORMANCE), F.col("kind").isin(*ERRORS)
    failure = ~performance & ~error & ~F.col("kind").isin("stage_failed", "query_failed", "retries")
    stage, executor, text = (one.filter(F.col("type") == t) for t in ("stage", "executor", "text"))
    placed = executor.groupBy("finding_id").agg(F.min("key").alias("__e"))
    where = text.filter(failure).join(placed, "finding_id", "left")
    free = where.filter("__e IS NULL").select("kind", "key").distinct().withColumn("__free", F.lit(True))
    where = where.join(free, ["kind", "key"], "left").withColumn("__e", F.when(F.col("__free"), F.lit("")).otherwise(F.col("__e")))
    alone = without(findings.filter(error & F.col("ts").isNotNull())).join(executor.select("finding_id").distinct(), "finding_id", "left_anti").select("finding_id", "ts")
    before = asof_join(alone, alone.select(F.col("ts").alias("__before"), F.col("finding_id").alias("v")), [], "ts", "__before", ["v", "__before"], strict=True, width=WIDTH).filter(F.col("ts") - F.col("__before") <= error_ms)
    edges = [
        _star(stage.filter(performance), ["kind", "key"]),
        _star(stage.filter(failure & ~F.col("inferred")), ["kind", "key"]),
        _star(stage.filter(error), ["kind", "key"], ~F.col("inferred")),
        _chain(executor.filter(failure), ["kind", "key"], same_ms),
        _chain(executor.filter(error), ["key"], error_ms),
        _star(where, ["kind", "key", "__e"]),
        _star(text.filter(error), ["key"]),
        _star(text.filter("kind IN ('stage_failed', 'job_aborted')"), ["key"]),
        _star(alone, ["ts"]),
        before.select(F.col("finding_id").alias("u"), "v"),
    ]
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    singles = without(findings).select(F.col("finding_id").alias("u"), F.col("finding_id").alias("v"))
    members = connected_components(found.unionByName(singles), "u", "v").select(F.col("node").alias("finding_id"), F.col("component").alias("problem"))
    if not some:
        return members
    # findings of several lines: each line asks for the problems of its kind on its executor then, or on its stage
    asked = matching_lines(findings, scopes, several, members, same_ms, error_ms)
    begun = members.join(findings.select("finding_id", "ts"), "finding_id").groupBy("problem").agg(F.min("ts").alias("__ts"))
    votes = asked.groupBy("finding_id", "problem").agg(F.countDistinct("event").alias("__n")).join(begun, "problem")
    joined = votes.groupBy("finding_id").agg(F.max_by("problem", F.struct("__n", -F.coalesce("__ts", F.lit(0)), "problem")).alias("problem"))
    lone = findings.join(several, "finding_id", "left_semi").join(joined, "finding_id", "left_anti").select("finding_id", F.col("finding_id").alias("problem"))
    return members.unionByName(joined).unionByName(lone)


def matching_lines(findings: DataFrame, scopes: DataFrame, several: DataFrame, members: DataFrame, same_ms: int, error_ms: int) -> DataFrame:
    """finding_id, event, problem: lines of findings of several lines, and the problems of their kind that they match."""
    lines = scopes.join(several, "finding_id", "left_semi").filter("event IS NOT NULL")
    known = scopes.join(several, "finding_id", "left_anti").join(members, "finding_id").select("problem", "kind", "type", "key", F.col("ts").alias("__t"), F.col("inferred").alias("__i")).distinct()
    named = lines.filter("type = 'stage'").join(known, ["kind", "type", "key"]).filter(F.when(F.col("kind").isin(*PERFORMANCE), True).otherwise(~F.col("inferred") & ~F.col("__i")))
    near = F.when(F.col("kind").isin(*ERRORS), F.lit(error_ms)).otherwise(F.lit(same_ms))
    on = lines.filter("type = 'executor' AND ts IS NOT NULL").withColumns({"l_start": F.col("ts") - near, "l_end": F.col("ts") + near})
    then = known.filter("type = 'executor' AND __t IS NOT NULL").drop("type").withColumns({"r_start": F.col("__t"), "r_end": F.col("__t")})
    placed = overlap_join(on.filter(~F.col("kind").isin(*PERFORMANCE)), then, ["kind", "key"], 2 * same_ms, closed=True)
    return named.select("finding_id", "event", "problem").unionByName(placed.select("finding_id", "event", "problem")).distinct()


def problems_of(findings: DataFrame, scopes: DataFrame, members: DataFrame, same_ms: int = SAME_MS, error_ms: int = ERROR_MS) -> tuple[DataFrame, DataFrame]:
    """problem, kind, label, level, ts, until, severity, lead, n; and problem, type, key, inferred. Of a finding of several lines only those count that match its problem, else its earliest."""
    several = scopes.filter("event IS NOT NULL").groupBy("finding_id").agg(F.countDistinct("event").alias("__n"), F.min("ts").alias("__first")).filter("__n > 1")
    kept = scopes
    if not several.isEmpty():
        matched = matching_lines(findings, scopes, several.select("finding_id"), members.join(several, "finding_id", "left_anti"), same_ms, error_ms).join(members, ["finding_id", "problem"], "left_semi").select("finding_id", "event")
        has = matched.select("finding_id").distinct().withColumn("__has", F.lit(True))
        of_lines = scopes.join(several, "finding_id").join(has, "finding_id", "left").join(matched.withColumn("__hit", F.lit(True)), ["finding_id", "event"], "left")
        early = F.coalesce(F.col("ts") - F.col("__first") <= error_ms, F.col("__first").isNull())
        of_lines = of_lines.filter(F.col("event").isNull() | F.when(F.col("__has"), F.col("__hit")).otherwise(early)).select(*scopes.columns)
        kept = scopes.join(several, "finding_id", "left_anti").unionByName(of_lines)
    about = kept.join(members, "finding_id").groupBy("problem", "type", "key").agg(F.bool_and("inferred").alias("inferred"))
    framed = findings.filter("category = 'exception'").select("finding_id").join(scopes.filter("type = 'text'").select("finding_id").distinct(), "finding_id", "left_semi").withColumn("__framed", F.lit(True))
    f = findings.join(members, "finding_id").join(framed, "finding_id", "left")
    tells = F.struct(F.col("__framed").isNull() | (F.col("kind") == "reported"), F.coalesce("severity", F.lit(9)), F.col("category").startswith("log:"), F.col("category") == "exception", "finding_id")
    first = F.struct("level", F.col("kind") == "reported", F.col("kind") == "driver_error", "kind", "label")
    top = f.groupBy("problem").agg(F.min(first).alias("__k"), F.min("ts").alias("ts"), F.max("ts").alias("until"), F.min(F.coalesce("severity", F.lit(9))).alias("severity"), F.min_by("finding_id", tells).alias("lead"), F.count("*").alias("n"))
    return top.select("problem", F.col("__k.kind").alias("kind"), F.col("__k.label").alias("label"), F.col("__k.level").alias("level"), "ts", "until", "severity", "lead", "n"), about


def ran_on(effects: DataFrame, ran: DataFrame) -> DataFrame:
    """effect, effect_kind, ts, __hosts, __e: each executor that ran one of an effect's stages, once. ran: key, __es (the sorted executors of a stage).

    Stages that ran on the same executors are one set, and an effect takes a set once: it has many stages, but mostly few sets of them.
    """
    ran = written(ran)
    sets = written(ran.groupBy("__es").agg(F.min("key").alias("__set")))
    of = ["effect", "effect_kind", "ts", "__hosts"]
    taken = effects.join(ran.join(sets, "__es").select("key", "__set"), "key").groupBy(*of).agg(F.collect_set("__set").alias("__sets"))
    return taken.select(*of, F.explode("__sets").alias("__set")).join(sets, "__set").select(*of, F.explode("__es").alias("__e")).distinct()


def best_links(problems: DataFrame, about: DataFrame, tasks: DataFrame, stages: DataFrame, retry_categories: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """effect, cause, score (3 strong, 2 likely, 1 by time alone), because: the best cause of each problem that has one.

    retry_categories: context, stage_id, stage_attempt, category (why first attempts failed): where all say source_db, only that causes retries.
    """
    # kinds are a fixed list; what no problem is cannot be a cause
    present = {r[0] for r in problems.select("kind").distinct().collect()}
    rules = [(c, e) for e, cs in CAUSES.items() for c in cs if KINDS[c][1] < KINDS[e][1] and {c, e} <= present]
    flags = about.groupBy("problem").agg(F.bool_or(F.col("type") == "fetch_host").alias("__hosts"), F.bool_or(F.col("type") == "text").alias("__framed"))
    p = problems.select("problem", "kind", "ts", "until").join(flags, "problem", "left").withColumn("__flat", F.lit(False))
    if ("skew", "gc") in rules:
        slowest = tasks.groupBy(key_of("context", "stage_id", "stage_attempt").alias("key")).agg(F.max_by(key_of("context", "executor_id"), F.struct(F.coalesce("finish_ms", "launch_ms") - F.col("launch_ms"), "executor_id")).alias("__e"))
        stuck = about.filter("type = 'executor'").join(problems.filter("kind = 'gc'").select("problem"), "problem", "left_semi").select(F.col("key").alias("__e")).distinct()
        not_skewed = about.filter("type = 'stage'").join(slowest, "key").join(stuck, "__e", "left_semi").join(problems.filter("kind = 'skew'").select("problem"), "problem", "left_semi").select("problem").distinct()
        p = p.drop("__flat").join(not_skewed.withColumn("__flat", F.lit(True)), "problem", "left")
    p = written(p)
    rows = written(about.join(p, "problem"))
    of_cause = ["until", "__flat", "__framed"]
    causes = rows.select(F.col("problem").alias("cause"), F.col("kind").alias("cause_kind"), "type", "key", F.col("inferred").alias("__ci"), F.coalesce("ts", F.lit(-(1 << 62))).alias("__began"), *of_cause)
    effects = rows.select(F.col("problem").alias("effect"), F.col("kind").alias("effect_kind"), "type", "key", F.col("inferred").alias("__ei"), "ts", "__hosts")
    # what nothing may cause does not ask
    causes, effects = causes.filter(F.col("cause_kind").isin(*{c for c, _ in rules})), effects.filter(F.col("effect_kind").isin(*{e for _, e in rules}))
    # stages stand for the executors that ran them; fetch hosts for hosts; calls for the stages of that name
    ran = tasks.filter("executor_id IS NOT NULL").select(key_of("context", "stage_id", "stage_attempt").alias("key"), key_of("context", "executor_id").alias("__e")).distinct()
    ran = ran.groupBy("key").agg(F.sort_array(F.collect_list("__e")).alias("__es"))
    asks = [(effects.filter("type = 'stage'"), "stage"), (effects.filter("type = 'executor'"), "executor"), (effects.filter("type = 'run' AND effect_kind IN ('spill', 'gc', 'oom', 'killed')"), "run")]
    asks.append((ran_on(effects.filter("type = 'stage'"), ran).select("effect", "effect_kind", F.lit("ran_on").alias("type"), F.col("__e").alias("key"), F.lit(False).alias("__ei"), "ts", "__hosts"), "ran_on"))
    asks.append((effects.filter("type = 'fetch_host'").withColumn("type", F.lit("host")), "host"))
    asks.append((effects.filter("type = 'call' AND effect_kind = 'reported'"), "call"))
    gives = {t: causes.filter(F.col("type") == t) for t in ("stage", "executor", "host", "run")}
    gives["ran_on"] = gives["executor"].filter("cause_kind IN ('oom', 'killed', 'lost', 'disk_full')").withColumn("type", F.lit("ran_on"))
    words = stages.select(key_of("context", "stage_id", "stage_attempt").alias("key"), F.explode(F.split(F.lower("stage_name"), r"\W+")).alias("__w")).distinct()
    gives["call"] = gives["stage"].filter("cause_kind IN ('query_failed', 'job_aborted')").join(words, "key").select("cause", "cause_kind", F.lit("call").alias("type"), F.col("__w").alias("key"), "__ci", "__began", *of_cause).distinct()
    gives["run"] = gives["run"].filter("cause_kind = 'cache'")
    near_query = p.filter("kind IN ('driver_error', 'other_error', 'task_error') AND ts IS NOT NULL")
    gives["time"] = near_query.select(F.col("problem").alias("cause"), F.col("kind").alias("cause_kind"), F.lit("time").alias("type"), F.lit("").alias("key"), F.lit(False).alias("__ci"), F.col("ts").alias("__began"), *of_cause)
    asks.append((p.filter("kind = 'query_failed' AND ts IS NOT NULL").select(F.col("problem").alias("effect"), F.col("kind").alias("effect_kind"), F.lit("time").alias("type"), F.lit("").alias("key"), F.lit(False).alias("__ei"), "ts", "__hosts"), "time"))
    gives["weak"] = p.filter("kind IN ('query_failed', 'job_aborted')").select(F.col("problem").alias("cause"), F.col("kind").alias("cause_kind"), F.lit("weak").alias("type"), F.lit("").alias("key"), F.lit(False).alias("__ci"), F.coalesce("ts", F.lit(-(1 << 62))).alias("__began"), *of_cause)
    asks.append((p.filter("kind = 'reported'").select(F.col("problem").alias("effect"), F.col("kind").alias("effect_kind"), F.lit("weak").alias("type"), F.lit("").alias("key"), F.lit(False).alias("__ei"), "ts", "__hosts"), "weak"))

    only_db = None
    if retry_categories is not None:
        why = retry_categories.select(key_of("context", "stage_id", "stage_attempt").alias("key"), "category")
        only_db = effects.filter("type = 'stage'").join(why, "key").groupBy("effect").agg((F.bool_and(F.col("category") == "source_db")).alias("__db")).filter("__db").select("effect")
    both, given = None, None
    for rows_of, kind in asks:
        rows_of = rows_of.select("effect", "effect_kind", "type", "key", "__ei", "ts", "__hosts")
        both = rows_of if both is None else both.unionByName(rows_of)
        given = gives[kind] if given is None else given.unionByName(gives[kind])
    probes = both.withColumn("__by", F.coalesce(F.col("ts") + LATE_MS, F.lit((1 << 62))))
    # a cause that is named for the row, and one that is inferred, are looked up apart: they score differently
    given = given.withColumn("__ci", F.when(F.col("type") == "stage", F.coalesce("__ci", F.lit(False))).otherwise(False))
    marks = {f"__{k}_{int(ci)}": (F.col("cause_kind") == k) & (F.col("__ci") == ci) for k in sorted({c for c, _ in rules}) for ci in (False, True)}
    if not marks:
        return problems.limit(0).select(F.col("problem").alias("effect"), F.col("problem").alias("cause"), F.lit(0).alias("score"), F.lit("").alias("because"))
    found = asof_each(probes, given, ["type", "key"], "__by", "__began", ["cause", "until", "__began", "cause_kind", "__ci", "__flat", "__framed"], marks, width)
    may = F.concat("effect_kind", F.lit("<"), F.col("__c.cause_kind")).isin(*[f"{e}<{c}" for c, e in rules])
    found = found.select("effect", "effect_kind", "type", "__ei", "ts", "__hosts", F.explode("found").alias("__c")).filter(may).select("effect", "effect_kind", "type", "__ei", "ts", "__hosts", "__c.*")
    found = found.withColumn("__level", F.element_at(_map({k: v[1] for k, v in KINDS.items()}), F.col("cause_kind")))
    if "gc" in present:
        executors_of = about.filter("type = 'executor'").join(problems.filter("kind IN ('gc', 'oom', 'killed')"), "problem", "left_semi").groupBy("problem").agg(F.collect_set("key").alias("__es"))
        found = found.join(executors_of.select(F.col("problem").alias("effect"), F.col("__es").alias("__ee")), "effect", "left").join(executors_of.select(F.col("problem").alias("cause"), F.col("__es").alias("__ce")), "cause", "left")
    else:
        found = found.withColumns({c: F.lit(None).cast("array<string>") for c in ("__ee", "__ce")})
    near = F.col("until").isNull() | F.col("ts").isNull() | (F.col("ts") - F.col("until") <= LINK_MS)
    score = (
        F.when((F.col("cause_kind") == "cache") & (F.col("type") != "run"), 0).when(F.col("type") == "run", 2)
        .when((F.col("cause_kind") == "gc") & F.col("effect_kind").isin("oom", "killed") & ~F.coalesce(F.arrays_overlap("__ee", "__ce"), F.lit(True)), 0)
        .when((F.col("cause_kind") == "skew") & (F.col("effect_kind") == "gc") & F.coalesce("__flat", F.lit(False)), 0)
        .when((F.col("effect_kind") == "fetch") & F.coalesce("__hosts", F.lit(False)), F.when((F.col("type") == "host") & near, 3).otherwise(0))
        .when(F.col("type") == "stage", F.when(F.col("__ei") & F.col("__ci"), 2).otherwise(3)).when(F.col("type") == "host", F.when(near, 3).otherwise(0))
        .when(F.col("type") == "time", F.when(F.abs(F.col("ts") - F.col("__began")) <= QUERY_ERROR_MS, 2).otherwise(0)).when(F.col("type") == "weak", 1).when(F.col("type") == "call", 2).otherwise(F.when(near, 2).otherwise(0))
    )
    found = found.withColumn("score", score).filter("score > 0 AND cause <> effect")
    if only_db is not None:
        found = found.join(only_db.withColumn("__only", F.lit(True)), "effect", "left").filter("__only IS NULL OR cause_kind = 'source_db' OR effect_kind NOT IN ('retries', 'stage_failed')").drop("__only")
    rank = F.struct("score", "__level", (F.col("cause_kind") == "task_error") & F.coalesce("__framed", F.lit(False)), "__began", "cause")
    best = found.groupBy("effect").agg(F.max_by(F.struct("cause", "score", "cause_kind", "effect_kind", "type"), rank).alias("b")).select("effect", "b.*")
    why = F.try_element_at(_map({f"{a}>{b}": t for (a, b), t in BECAUSE.items()}), F.concat("cause_kind", F.lit(">"), "effect_kind"))
    label = F.element_at(_map({k: v[0] for k, v in KINDS.items()}), F.col("cause_kind"))
    shared = F.when(F.col("type") == "stage", "the same stage").when(F.col("type").isin("executor", "ran_on", "host"), "the same executor").otherwise("the same query")
    because = F.coalesce(why, F.concat(label, F.lit(" came first on "), shared))
    return best.select("effect", "cause", "score", F.when(F.col("score") == 1, F.concat(because, F.lit(" (matched by time only)"))).otherwise(because).alias("because"))


def incident_groups(problems: DataFrame, about: DataFrame, links: DataFrame) -> DataFrame:
    """problem, incident (the least problem of it): linked problems, one query's performance problems that nothing links, and repeats of one cause in many stages."""
    linked = links.select(F.explode(F.array("effect", "cause")).alias("problem")).distinct()
    lone = problems.filter(F.col("kind").isin(*PERFORMANCE)).join(linked, "problem", "left_anti").select("problem")
    query = about.filter("type = 'query'").join(lone, "problem", "left_semi").groupBy("problem").agg(F.min("key").alias("key"), F.countDistinct("key").alias("__n")).filter("__n = 1")
    least = query.groupBy("key").agg(F.min("problem").alias("v"))
    edges = links.select(F.col("effect").alias("u"), F.col("cause").alias("v")).unionByName(query.join(least, "key").select(F.col("problem").alias("u"), "v")).unionByName(problems.select(F.col("problem").alias("u"), F.col("problem").alias("v")))
    groups = connected_components(edges, "u", "v").select(F.col("node").alias("problem"), F.col("component").alias("incident"))
    kinds = groups.join(problems.select("problem", "kind"), "problem").groupBy("incident").agg(F.sort_array(F.collect_set("kind")).alias("__kinds"))
    alike = F.lit(False)
    for some in (("large", "spill"), ("big_read", "spill"), ("source_db", "retries")):
        alike = alike | (F.size(F.array_except("__kinds", F.array(*[F.lit(s) for s in some]))) == 0)
    merged = kinds.filter(alike)
    into = merged.groupBy("__kinds").agg(F.min("incident").alias("__into"))
    merged = merged.join(into, "__kinds").select("incident", "__into")
    return groups.join(merged, "incident", "left").select("problem", F.coalesce("__into", "incident").alias("incident"))


def incident_roles(problems: DataFrame, about: DataFrame, links: DataFrame) -> DataFrame:
    """problem, incident, kind, label, level, ts, role, cause, because, confidence, top, root, path (from the top down), steps.

    The root is where the causes of the highest problem end (worst first where nothing is linked); others are effects, contributing (start points of their own) or
    related (performance beside a failure).
    """
    p = problems.join(incident_groups(problems, about, links), "problem").join(links.withColumnRenamed("effect", "problem"), "problem", "left")
    height = F.when(F.col("kind") == "reported", 7.5).otherwise(F.col("level").cast("double"))
    ahead = F.struct(height.alias("h"), (-F.coalesce("ts", F.lit(0))).alias("t"), "problem")
    worst = F.struct("severity", "level", F.coalesce("ts", F.lit(0)).alias("t"), "problem")
    tops = p.groupBy("incident").agg(F.max_by("problem", ahead).alias("top"), F.bool_and(F.col("cause").isNull()).alias("__unlinked"), F.min_by("problem", worst).alias("__worst"), F.bool_or(F.col("kind").isin(*FAILURES)).alias("failed"))
    paths = follow_paths(links, "effect", "cause")
    tops = tops.join(paths.withColumnRenamed("effect", "top"), "top", "left")
    tops = tops.select("incident", "top", "failed", F.when(F.col("__unlinked"), F.col("__worst")).otherwise(F.coalesce("root", "top")).alias("root"), F.coalesce("path", F.array("top")).alias("path"), F.coalesce("steps", F.lit(0)).alias("steps"))
    role = (
        F.when(F.col("problem") == F.col("root"), "root").when(F.col("cause").isNotNull(), "effect")
        .when(~F.col("kind").isin(*PERFORMANCE) | ~F.col("failed"), "contributing").otherwise("related")
    )
    sure = F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("score"))
    return p.join(tops, "incident").select("problem", "incident", "kind", "label", "level", "severity", "ts", "until", "lead", role.alias("role"), "cause", "because", sure.alias("confidence"), "top", "root", "path", "steps", "failed")


def ranked_incidents(roles: DataFrame, about: DataFrame) -> DataFrame:
    """incident, rank, title, severity, start, end, problems: failures first, mere reports after, then by severity, level and time. One row an incident: the ranks come last."""
    top = F.col("problem") == F.col("top")
    real = F.col("kind") != "reported"
    g = roles.groupBy("incident").agg(
        F.bool_or("failed").alias("failed"), (~F.bool_or(real)).alias("only_reported"), F.min("severity").alias("severity"), F.max(F.when(real, F.col("level")).otherwise(0)).alias("level"), F.min("ts").alias("start"), F.max("until").alias("end"),
        F.count("*").alias("problems"), F.max(F.when(top, F.struct("problem", "kind", "label"))).alias("__top"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("level", "label"))), lambda x: x["label"])).alias("__labels"),
        F.bool_and(F.col("kind").isin(*PERFORMANCE)).alias("__slow"),
    )
    of = about.join(roles.select("problem", "incident", "top"), "problem")
    ident = F.element_at(F.split("key", r"\|"), 2)
    numbers = lambda x: F.array_join(F.transform(F.array_sort(F.collect_set(x)), lambda s: s["t"]), ", ")
    own = F.col("problem") == F.col("top")
    stage_text = F.struct(ident.cast("long").alias("n"), F.concat_ws(".", ident, F.element_at(F.split("key", r"\|"), 3)).alias("t"))
    names = of.groupBy("incident").agg(
        numbers(F.when((F.col("type") == "stage") & own & ~F.col("inferred"), stage_text)).alias("__stages"), numbers(F.when((F.col("type") == "executor") & own, F.struct(F.length(ident).alias("n"), ident.alias("t")))).alias("__executors"),
        F.max(F.when((F.col("type") == "query") & own, ident.cast("long"))).alias("__query"), F.max(F.when(F.col("type") == "query", ident.cast("long"))).alias("__any_query"),
    )
    g = g.join(names, "incident", "left")
    query = F.coalesce("__query", "__any_query")
    kinds = F.array_join("__labels", ", ")
    title = (
        F.when(F.col("__top.kind").isin("query_failed", "reported", "job_aborted") & query.isNotNull(), F.format_string("Query %d failed", query))
        .when((F.col("__top.kind") == "stage_failed") & (F.col("__stages") != ""), F.concat(F.lit("Stage "), "__stages", F.lit(" failed")))
        .when(F.col("__top.kind").isin("lost", "oom", "killed") & (F.col("__executors") != ""), F.concat(F.lit("Executor "), "__executors", F.lit(": "), F.col("__top.label")))
        .when(F.col("__slow") & query.isNotNull(), F.concat(F.format_string("Query %d ran slow: ", query), kinds))
        .when(F.col("__stages") != "", F.concat(F.lit("Stage "), "__stages", F.lit(": "), kinds))
        .when(F.col("__executors") != "", F.concat(F.lit("Executor "), "__executors", F.lit(": "), kinds))
        .otherwise(F.concat(F.upper(F.substring(F.col("__top.label"), 1, 1)), F.expr("substring(__top.label, 2)")))
    )
    order = [~F.col("failed"), F.col("only_reported"), F.col("severity"), F.desc("level"), F.coalesce("start", F.lit(0)), F.col("incident")]
    return numbered(g.withColumn("title", title), order, "rank").select("incident", "rank", "title", "severity", "start", "end", "problems")


def build_incidents(findings: DataFrame, stages: DataFrame, executors: DataFrame, tasks: DataFrame, lines: DataFrame, errors: DataFrame, retry_categories: DataFrame | None = None) -> DataFrame:
    """A row for each finding that takes part: finding_id, incident, rank, title, problem, kind, role (same: seen another way), caused_by (a finding), because, confidence.

    findings: finding_id, category, severity (0 high), ts, context, stage_id, stage_attempt, executor_id, sql_execution_id, run_key, entity, evidence, signal, fingerprint.
    Times are epoch milliseconds.
    """
    kinds = written(finding_kinds(findings, errors))
    scopes = written(finding_scopes(kinds, stages, executors, tasks, lines, errors))
    members = written(problem_members(kinds, scopes))
    problems, about = (written(x) for x in problems_of(kinds, scopes, members))
    links = written(best_links(problems, about, tasks, stages, retry_categories))
    roles = written(incident_roles(problems, about, links))
    ranks = ranked_incidents(roles, about)
    cause_lead = problems.select(F.col("problem").alias("cause"), F.col("lead").alias("__cause_lead"))
    rows = kinds.select("finding_id").join(members, "finding_id").join(roles.join(cause_lead, "cause", "left"), "problem").join(ranks.select("incident", "rank", "title"), "incident")
    lead = F.col("finding_id") == F.col("lead")
    return rows.select(
        "finding_id", "incident", "rank", "title", "problem", F.col("label").alias("kind"), F.when(lead, F.col("role")).otherwise("same").alias("role"), F.when(lead, F.col("__cause_lead")).otherwise(F.col("lead")).alias("caused_by"),
        F.when(lead, F.col("because")).otherwise("the same problem, seen another way").alias("because"), F.when(lead, F.col("confidence")).otherwise("strong").alias("confidence"),
    )
