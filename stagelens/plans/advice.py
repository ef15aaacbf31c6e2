"""R2: settings and habits to change, each with what the data shows for it, ranked by the time that the problem cost. Times are epoch milliseconds.

Every rule is an aggregate of stages, queries, runs, executors or findings by context; a context's settings are one row, so rules read them by a join of small sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.functions import text as T
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators.findings import HIGH, MEDIUM
from stagelens.operators.graph import written

INFO = 2
MB, GB = 1 << 20, 1 << 30
PARTITIONS, AUTO, ADAPTIVE, SKEW_JOIN = "spark.sql.shuffle.partitions", "spark.databricks.adaptive.autoOptimizeShuffle.enabled", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"
SPLIT, MEMORY, SCHEDULER, SPECULATION, MASTER = "spark.sql.files.maxPartitionBytes", "spark.executor.memory", "spark.scheduler.mode", "spark.speculation", "spark.master"
WORKERS, ENGINE, SNAPSHOT = "clusterWorkers", "runtimeEngine", "spark.databricks.delta.snapshotPartitions"
#: what a context without the setting runs with
DEFAULTS = {PARTITIONS: "200", AUTO: "false", ADAPTIVE: "true", SKEW_JOIN: "true", SPLIT: "128m", SCHEDULER: "FIFO", SPECULATION: "false", MASTER: "", ENGINE: ""}
#: category of a finding -> rule, setting, whether its cost is shared by the runs that go at once
BY_FINDING = {
    "dataframe_cache": ("cache larger than memory", MEMORY, False), "cores_full": ("runs waited for cores", WORKERS, True), "merge_rewrite": ("merge reads more than it merges", None, False),
    "no_spark_work": ("time outside Spark", None, True), "count_only": ("counts run the query again", None, False), "jdbc_one_partition": ("one connection reads all", None, False),
    "empty_input": ("nothing new to read", None, True), "tiny_task_stages": ("tiny tasks", SNAPSHOT, False),
}
FIRST = ("fifo stage", "merge reads more than it merges")
COLUMNS = ["context", "rule", "setting", "subject", "severity", "n", "suggest", "cost_ms"]


def settings_row(contexts: DataFrame, settings: DataFrame) -> DataFrame:
    """context and a column for each setting of DEFAULTS (dots as underscores): the value set, else the default. A context has one value a setting (see settings_merge)."""
    name = lambda s: s.replace(".", "_")
    set_ = settings.groupBy("context").agg(*[F.max(F.when(F.col("setting") == s, F.col("value"))).alias(name(s)) for s in DEFAULTS])
    return contexts.join(set_, "context", "left").select("context", *[F.coalesce(name(s), F.lit(v)).alias(name(s)) for s, v in DEFAULTS.items()])


def _row(rule: str, setting: str | None, severity: Column | int, n: Column, cost: Column | None = None, suggest: Column | None = None, subject: Column | None = None) -> list[Column]:
    null = F.lit(None)
    text, number = (lambda c: (null if c is None else c).cast("string")), (lambda c: (null if c is None else c).cast("long"))
    return [F.col("context"), F.lit(rule).alias("rule"), F.lit(setting).cast("string").alias("setting"), text(subject).alias("subject"), (F.lit(severity) if isinstance(severity, int) else severity).cast("int").alias("severity"), number(n).alias("n"), number(suggest).alias("suggest"), number(cost).alias("cost_ms")]


def _rows(df: DataFrame, rules: list[tuple[Column, list[Column]]]) -> DataFrame:
    """The rows of all rules whose condition holds, in one pass over df."""
    return df.select(F.inline(F.array_compact(F.array(*[F.when(cond, F.struct(*cells)) for cond, cells in rules]))))


def stage_rules(stages: DataFrame, now: DataFrame) -> DataFrame:
    """Rules over stages. stages: context, stage_id, stage_attempt, tasks, shuffle_read, input_bytes, input_records, df_cache_bytes, wmed_bytes (weighted median read of a task), p50_bytes, max_bytes,
    p50_task_ms, max_task_ms, disk_spill, first_ms, end_ms, duration_ms."""
    zero = F.lit(0)
    s = stages.fillna(0, ["shuffle_read", "input_bytes", "input_records", "df_cache_bytes", "wmed_bytes", "p50_bytes", "max_bytes", "disk_spill", "duration_ms"]).join(now, "context")
    on = lambda c: F.lower(c) == "true"
    n = F.col("spark_sql_shuffle_partitions").try_cast("long")
    manual = ~on("spark_databricks_adaptive_autoOptimizeShuffle_enabled") & n.isNotNull()
    at_n = manual & (F.col("tasks") == n) & (F.col("shuffle_read") > 0) & (F.greatest("wmed_bytes", "p50_bytes") >= 128 * MB)
    storage = F.col("input_bytes")
    unsplit = (storage > 0) & (F.col("shuffle_read") == 0) & (F.col("df_cache_bytes") < storage) & (F.col("wmed_bytes") >= 2 * F.coalesce(T.parse_size(F.col("spark_sql_files_maxPartitionBytes")), F.lit(128 * MB)))
    skewed = (F.lower("spark_sql_adaptive_skewJoin_enabled") == "false") & (F.col("max_bytes") >= 5 * F.greatest("p50_bytes", F.lit(1))) & (F.col("max_bytes") >= 256 * MB)
    by_jdbc = (storage == 0) & (F.col("shuffle_read") == 0) & (F.col("input_records") > 0)
    slow = (F.lower("spark_speculation") == "false") & (F.col("max_task_ms") >= 300_000) & (F.col("p50_task_ms") > 0) & (F.col("max_task_ms") >= 10 * F.col("p50_task_ms")) & ((F.col("max_bytes") == 0) | (F.col("p50_bytes") == 0) | (F.col("max_bytes") < 2 * F.col("p50_bytes"))) & ~by_jdbc
    held = F.col("end_ms") - F.coalesce("first_ms", "end_ms")
    hits = {"p": at_n, "u": unsplit, "k": skewed, "s": slow, "d": F.col("disk_spill") > 0}
    of = lambda h, c: F.sum(F.when(hits[h], c))
    worst = F.col("__spilled") & (F.row_number().over(Window.partitionBy("context", "__spilled").orderBy(F.desc("disk_spill"), "stage_id", "stage_attempt")) <= 3)
    s = s.withColumn("__spilled", hits["d"]).withColumn("__worst", worst)
    g = s.groupBy("context").agg(*[F.count_if(c).alias(f"n_{k}") for k, c in hits.items()], of("p", F.col("duration_ms")).alias("p_ms"), of("p", F.col("disk_spill")).alias("p_spill"), F.max(F.when(at_n, F.col("shuffle_read"))).alias("p_most"), F.max(n).alias("__n"), F.sum("disk_spill").alias("spill"), F.sum(F.when(F.col("__worst"), held)).alias("worst_ms"))
    need = F.greatest(F.col("__n"), F.ceil(F.col("p_most") / (128 * MB)))
    per_stage = _rows(g, [
        (F.col("n_p") > 0, _row("too few shuffle partitions", PARTITIONS, F.when(F.col("p_spill") >= GB, HIGH).otherwise(MEDIUM), F.col("n_p"), F.col("p_ms"), need)),
        (F.col("n_k") > 0, _row("skew joins are not split", SKEW_JOIN, HIGH, F.col("n_k"))),
        (F.col("n_u") > 0, _row("files cannot be split", SPLIT, MEDIUM, F.col("n_u"))),
        (F.col("n_s") > 0, _row("slow tasks without more data", SPECULATION, INFO, F.col("n_s"))),
        (F.col("spill") >= GB, _row("spill", MEMORY, F.when(F.col("spill") >= 50 * GB, HIGH).otherwise(MEDIUM), F.col("n_d"), F.coalesce("worst_ms", zero))),
    ])
    off = now.filter(F.lower("spark_sql_adaptive_enabled") == "false").select(*_row("adaptive execution is off", ADAPTIVE, F.when(F.col("spark_master").startswith("local"), INFO).otherwise(HIGH), F.lit(1)))
    return per_stage.unionByName(off)


def run_rules(runs: DataFrame, executors: DataFrame, gap: int = 120_000, at_least: int = 5, at_once: int = 3, long_ms: int = 300_000, width: int = 3_600_000) -> list[DataFrame]:
    """Runs that share executors, and bursts of starts. runs: context, run_key, start_ms, end_ms, status; executors: context, cores, added_ms, removed_ms, removal_category."""
    runs = runs.filter("start_ms IS NOT NULL").withColumn("__end", F.coalesce("end_ms", "start_ms"))
    day = 24 * width  # a context may have too many runs for one task: sweeps are taken in two levels
    sharing = I.peak(runs, ["context"], "start_ms", "__end", width=day).filter("peak > 1")
    groups = I.bursts(runs, ["context"], "start_ms", gap, at_least, width=day).select("context", F.col("start").alias("first"), F.col("end").alias("last"))
    inside = J.asof_join(runs, groups.select("context", "first", "last", F.col("first").alias("__at")), ["context"], "start_ms", "__at", ["first", "last"], width=day).filter(F.col("start_ms") <= F.col("last"))
    keys = ["context", "first"]
    took = F.col("__end") - F.col("start_ms")
    b = inside.groupBy(*keys, "last").agg(F.count("*").alias("runs"), F.count_if(took >= long_ms).alias("long"), F.count_if(F.col("status") == "failed").alias("failed"))
    b = b.join(I.peak(inside, keys, "start_ms", "__end", width=day).filter(F.col("peak") >= at_once).select(*keys), keys)
    up = executors.select("context", F.coalesce("cores", F.lit(0)).alias("cores"), "added_ms", "removed_ms", "removal_category", F.col("added_ms").alias("r_start"), F.coalesce("removed_ms", F.lit(1 << 60)).alias("r_end"))
    near = I.overlap_join(b.select(*keys, F.col("first").alias("l_start"), F.col("first").alias("l_end")), up.filter("r_end > r_start").withColumn("r_end", F.least("r_end", F.lit(1 << 52))), ["context"], width, closed=True)
    cores = near.filter("removed_ms IS NULL OR removed_ms > first").groupBy(*keys).agg(F.sum("cores").alias("cores"))
    gone = up.filter("removal_category = 'autoscale' AND removed_ms IS NOT NULL").select("context", F.col("removed_ms").alias("r_start"), F.col("removed_ms").alias("r_end"))
    went = I.overlap_join(b.select(*keys, (F.col("first") - gap).alias("l_start"), (F.col("last") + gap).alias("l_end")), gone, ["context"], width, closed=True).groupBy(*keys).agg(F.count("*").alias("gone"))
    b = b.join(cores, keys, "left").join(went, keys, "left").fillna(0, ["cores", "gone"])
    heavy = (F.col("long") >= 5) & ((F.col("cores") == 0) | (F.col("long") * 2 > F.col("cores")))
    severity = F.when(heavy & ((F.col("failed") > 0) | (F.col("gone") > 0)), HIGH).when(heavy, MEDIUM).otherwise(INFO)
    return [sharing.select(*_row("runs share the executors", SCHEDULER, INFO, F.col("peak"))), b.select(*_row("burst of starts", None, severity, F.col("runs"), subject=F.col("first")))]


def query_rules(queries: DataFrame, now: DataFrame, runs: int = 5, took_ms: int = 120_000, high_ms: int = 600_000, most: int = 3) -> list[DataFrame]:
    """Lookups that many runs read again (no query writes them; the three that cost most), and large queries without the vectorised engine.

    queries: context, run_key, duration_ms, input_bytes, shuffle_read, engine_share, tables_read and tables_written (arrays)."""
    written = queries.select("context", F.explode("tables_written").alias("t")).distinct()
    read = queries.select("context", "run_key", "duration_ms", F.explode(F.array_distinct("tables_read")).alias("t")).filter(~F.col("t").rlike("_delta_log|^jdbc:|/")).join(written, ["context", "t"], "left_anti")
    again = read.groupBy("context", "t").agg(F.count_distinct("run_key").alias("runs"), F.sum("duration_ms").alias("took")).filter((F.col("runs") >= runs) & (F.col("took") >= took_ms))
    again = again.withColumn("__r", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("took"), "t"))).filter(F.col("__r") <= most)
    large = F.coalesce("input_bytes", F.lit(0)) + F.coalesce("shuffle_read", F.lit(0)) >= 10 * GB
    engine = queries.groupBy("context").agg(F.max("engine_share").alias("share"), F.count_if(large).alias("large")).join(now, "context")
    engine = engine.filter((F.upper("runtimeEngine") != "PHOTON") & (F.coalesce("share", F.lit(0)) == 0) & ~F.col("spark_master").startswith("local") & (F.col("large") > 0))
    return [again.select(*_row("lookup read again", None, F.when(F.col("took") >= high_ms, MEDIUM).otherwise(INFO), F.col("runs"), subject=F.col("t"))), engine.select(*_row("vectorised engine not used", ENGINE, INFO, F.col("large")))]


def runs_at_once(runs: DataFrame, width: int = 86_400_000) -> DataFrame:
    """context, at_once: the runs' summed time over the time with at least one of them, at least 1."""
    spans = runs.filter("start_ms IS NOT NULL").select("context", "start_ms", F.coalesce("end_ms", "start_ms").alias("__end"))
    busy = I.merge_intervals(spans, ["context"], "start_ms", "__end", width=width).groupBy("context").agg(F.sum(F.col("__end") - F.col("start_ms")).alias("busy"))
    took = spans.groupBy("context").agg(F.sum(F.col("__end") - F.col("start_ms")).alias("took"))
    return took.join(busy, "context").select("context", F.coalesce(F.greatest(F.lit(1.0), F.col("took") / F.nullif("busy", F.lit(0))), F.lit(1.0)).alias("at_once"))


def finding_rules(findings: DataFrame, runs: DataFrame, now: DataFrame) -> DataFrame:
    """One piece of advice for each category of findings of a context, as severe as the worst. findings: context, category, severity, cost_ms.

    A cost summed over runs that overlap is divided by the runs going at once. A stage that held all cores counts only under FIFO, and the costliest speaks for all."""
    g = findings.groupBy("context", "category").agg(F.min("severity").alias("worst"), F.count("*").alias("found"), F.sum("cost_ms").alias("cost"), F.max("cost_ms").alias("most")).join(runs_at_once(runs), "context", "left")
    shared = F.col("cost") / F.coalesce("at_once", F.lit(1.0))
    rules = [(F.col("category") == c, _row(rule, setting, F.col("worst"), F.col("found"), shared if over else F.col("cost"))) for c, (rule, setting, over) in BY_FINDING.items()]
    fifo = (F.col("category") == "core_hog") & (F.upper("spark_scheduler_mode") == "FIFO")
    return _rows(g.join(now, "context"), [*rules, (fifo, _row("fifo stage", SCHEDULER, HIGH, F.col("found"), F.col("most")))])


def idle_rule(compute: DataFrame, now: DataFrame, share: float = 0.3, high: float = 0.5) -> DataFrame:
    """Executors that ran nothing. compute: context, core_ms_up, core_ms_used, cores (of all workers)."""
    idle = 1 - F.col("core_ms_used") / F.nullif("core_ms_up", F.lit(0))
    c = compute.join(now.filter(~F.col("spark_master").startswith("local")).select("context"), "context").withColumn("idle", idle).filter(F.col("idle") >= share)
    return c.select(*_row("executors ran nothing", WORKERS, F.when(F.col("idle") >= high, HIGH).otherwise(MEDIUM), F.col("cores"), (F.col("core_ms_up") - F.col("core_ms_used")) / F.greatest("cores", F.lit(1))))


def advice(stages: DataFrame, settings: DataFrame, queries: DataFrame, runs: DataFrame, executors: DataFrame, findings: DataFrame, compute: DataFrame, gap: int = 120_000) -> DataFrame:
    """All rules: context, rank, rule, setting, subject, severity, n (stages, runs, queries or findings behind it), suggest, cost_ms, also (what the piece takes in).

    Where runs waited for cores, that item takes in the bursts and the sharing of its context and is as severe as the worst of them. Notes rank last; a stage that holds all cores and MERGEs come before
    what they cause, a cache larger than memory before everything; then by cost. The stages' figures and the settings in force are written once, as several rules read them.
    """
    stages = written(stages)
    contexts = stages.select("context").union(runs.select("context")).union(settings.select("context")).union(findings.select("context")).union(compute.select("context")).filter("context IS NOT NULL").distinct()
    now = written(settings_row(contexts, settings))
    parts = [stage_rules(stages, now), *run_rules(runs, executors, gap), *query_rules(queries, now), finding_rules(findings, runs, now), idle_rule(compute, now)]
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    taken = F.col("rule").isin("burst of starts", "runs share the executors")
    at = Window.partitionBy("context")
    waited = F.bool_or(F.col("rule") == "runs waited for cores").over(at)
    out = out.withColumns({"__waited": waited, "__also": F.sum(F.when(taken, 1).otherwise(0)).over(at), "__worst": F.min(F.when(taken, F.col("severity"))).over(at)}).filter(~(taken & F.col("__waited")))
    item = F.col("rule") == "runs waited for cores"
    out = out.withColumns({"severity": F.when(item, F.least("severity", "__worst")).otherwise(F.col("severity")), "also": F.when(item, F.col("__also")).otherwise(0).cast("long")})
    order = [F.col("rule") != "cache larger than memory", F.col("severity") == INFO, ~F.col("rule").isin(*FIRST), F.desc(F.coalesce("cost_ms", F.lit(0))), F.col("severity"), F.col("rule"), F.col("subject")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(*order))).select("context", "rank", *COLUMNS[1:], "also")
