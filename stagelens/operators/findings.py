"""Findings: rules as filters over finished tables, with severity, measure, evidence and fix; their union, ranks and post-rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW = 0, 1, 2
GB, MB = 1 << 30, 1 << 20


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the rules below; fixed values."""

    skew_ratio: float = 10.0
    skew_min_task_ms: int = 60_000
    skew_high_task_ms: int = 300_000
    spill_bytes: int = 1 * GB
    spill_high_bytes: int = 50 * GB
    gc_share: float = 0.2
    gc_min_ms: int = 10_000
    gc_medium_ms: int = 60_000
    tiny_tasks: int = 2000
    tiny_tasks_p50_ms: int = 200
    full_gcs: int = 3
    gc_pause_share: float = 0.1
    stuck_full_per_min: float = 60
    stuck_share: float = 0.5
    idle_share: float = 0.6
    idle_core_min: float = 30
    large_task_bytes: int = 256 * MB
    large_task_min_ms: int = 60_000
    partition_bytes: int = 128 * MB
    big_read_bytes: int = 20 * GB
    big_read_high_bytes: int = 100 * GB
    wait_ms: int = 300_000
    wait_share: float = 0.25
    own_wait_share: float = 0.5
    full_cores_wait_ms: int = 1_800_000
    full_cores_share: float = 0.2
    merge_read_bytes: int = 10 * GB
    merge_read_ratio: float = 5
    no_work_ms: int = 120_000
    no_work_share: float = 0.5
    ddl_loop: int = 10
    dedup_rows: int = 10_000_000
    cache_write_bytes: int = 10 * GB
    cache_hit_share: float = 0.1
    one_partition_ms: int = 600_000
    count_only_ms: int = 60_000
    count_only_share: float = 0.1
    shuffle_heavy_bytes: int = 1 * GB

    def with_overrides(self, **values: object) -> Thresholds:
        """Some thresholds replaced; unknown names are an error."""
        return replace(self, **values)


@dataclass(frozen=True)
class Rule:
    category: str
    when: Column
    severity: Column
    measure: Column = field(default_factory=lambda: F.lit(None))
    evidence: Column = field(default_factory=lambda: F.lit(None))
    fix: str | None = None


def detect(table: DataFrame, rules: Sequence[Rule], entity: Column, keep: Sequence[str] = ()) -> DataFrame:
    """category, entity, severity, measure, evidence, fix and kept columns of every rule that holds, from one pass over the table."""
    found = F.array_compact(F.array(*[F.when(r.when, F.struct(F.lit(r.category).alias("category"), r.severity.cast("int").alias("severity"), r.measure.cast("double").alias("measure"), r.evidence.cast("string").alias("evidence"), F.lit(r.fix).cast("string").alias("fix"))) for r in rules]))
    return table.select(entity.alias("entity"), *keep, F.explode(found).alias("f")).select("f.category", "entity", "f.severity", "f.measure", "f.evidence", "f.fix", *keep)


def stage_rules(t: Thresholds) -> list[Rule]:
    """Over a table of stages (see the columns used)."""
    c = F.col
    gc = c("gc_ms") / F.greatest(c("task_ms"), F.lit(1))
    return [
        Rule("stage_failed", c("failure_reason").isNotNull() & ~F.coalesce(c("replanned"), F.lit(False)), F.lit(HIGH), evidence=c("failure_reason")),
        Rule("task_skew", (c("skew") >= t.skew_ratio) & (c("max_task_ms") >= t.skew_min_task_ms), F.when(c("max_task_ms") >= t.skew_high_task_ms, HIGH).otherwise(MEDIUM), c("skew"), F.format_string("slowest task %.1f x the median", c("skew")), "Salt the key, or let AQE split the skewed partition."),
        Rule("disk_spill", c("disk_spill") >= t.spill_bytes, F.when(c("disk_spill") >= t.spill_high_bytes, HIGH).otherwise(MEDIUM), c("disk_spill"), fix="More shuffle partitions, or more memory a core."),
        Rule("gc_pressure", (gc >= t.gc_share) & (c("gc_ms") >= t.gc_min_ms), F.when(c("gc_ms") >= t.gc_medium_ms, MEDIUM).otherwise(LOW), gc, fix="Less cached data, or more memory a core."),
        Rule("task_retries", (c("failed_tasks") > 0) & c("failure_reason").isNull(), F.lit(MEDIUM), c("failed_tasks")),
        Rule("tiny_tasks", (c("tasks") >= t.tiny_tasks) & (c("p50_task_ms") < t.tiny_tasks_p50_ms), F.lit(LOW), c("tasks"), fix="Fewer partitions, or larger files."),
        Rule("large_tasks", (c("p50_read_bytes") >= t.large_task_bytes) & (c("duration_ms") >= t.large_task_min_ms), F.lit(MEDIUM), F.ceil(c("shuffle_read") / t.partition_bytes), fix="More partitions."),
        Rule("big_read", c("input_bytes") >= t.big_read_bytes, F.when(c("input_bytes") >= t.big_read_high_bytes, HIGH).otherwise(MEDIUM), c("input_bytes"), fix="Filter on partition or clustering columns."),
    ]


def executor_rules(t: Thresholds) -> list[Rule]:
    """Over a table of executors with their GC and idle figures."""
    c = F.col
    stuck = (c("full_gcs") / F.greatest(c("gc_minutes"), F.lit(1.0)) > t.stuck_full_per_min) & (c("stuck_full_gcs") / F.greatest(c("full_gcs"), F.lit(1)) > t.stuck_share)
    return [
        Rule("executor_oom", c("removal_category") == "oom", F.lit(HIGH), evidence=c("removed_reason")),
        Rule("executor_lost", c("removal_category") == "lost", F.lit(MEDIUM), evidence=c("removed_reason")),
        Rule("executor_killed", c("removal_category") == "killed", F.lit(MEDIUM), evidence=c("removed_reason")),
        Rule("gc_stuck", stuck, F.lit(HIGH), c("full_gcs"), fix="The heap is full: less cached data, or fewer cores an executor."),
        Rule("jvm_full_gc", ~F.coalesce(stuck, F.lit(False)) & ((c("full_gcs") >= t.full_gcs) | (c("gc_pause_share") >= t.gc_pause_share)), F.lit(MEDIUM), c("full_gcs")),
        Rule("executors_idle", (c("idle_share") >= t.idle_share) & (c("idle_core_min") >= t.idle_core_min), F.lit(LOW), c("idle_share")),
    ]


def run_rules(t: Thresholds) -> list[Rule]:
    """Over a table of runs with waits and reads. own_share: how much of a run's queueing was behind its own tasks (null: all). Only that makes a finding high, as behind
    other runs it is the cluster's story."""
    c = F.col
    part = lambda x: c(x) / F.greatest(c("duration_ms"), F.lit(1))
    own = (part("queued_wall_ms") >= t.own_wait_share) & (F.coalesce(c("own_share"), F.lit(1.0)) >= t.own_wait_share)
    return [
        Rule("waited_for_cores", (c("wait_ms") >= t.wait_ms) & (part("wait_ms") >= t.wait_share), F.lit(MEDIUM), c("wait_ms")),
        Rule("capacity_bound", (c("queued_wall_ms") >= t.wait_ms) & (part("queued_wall_ms") >= t.wait_share), F.when(own, HIGH).otherwise(MEDIUM), c("queued_wall_ms")),
        Rule("no_spark_work", (c("no_stage_ms") >= t.no_work_ms) & (part("no_stage_ms") >= t.no_work_share), F.lit(MEDIUM), c("no_stage_ms")),
        Rule("count_only", (c("count_only_ms") >= t.count_only_ms) & (part("count_only_ms") >= t.count_only_share), F.lit(LOW), c("count_only_ms")),
        Rule("ddl_loop", c("ddl_repeats") > t.ddl_loop, F.lit(LOW), c("ddl_repeats")),
    ]


def query_rules(t: Thresholds) -> list[Rule]:
    """Over a table of queries with merge, cache and source facts."""
    c = F.col
    return [
        Rule("query_failed", c("error").isNotNull(), F.lit(HIGH), evidence=F.substring("error", 1, 500)),
        Rule("merge_rewrite", (c("target_read") >= t.merge_read_bytes) & (c("target_read") >= t.merge_read_ratio * F.coalesce("source_read", F.lit(0))), F.lit(MEDIUM), c("target_read")),
        Rule("dedup_noop", c("dedup") & (c("rows_in") == c("rows_out")) & (c("rows_in") >= t.dedup_rows), F.lit(LOW), c("rows_in")),
        Rule("disk_cache", (c("cache_written") >= t.cache_write_bytes) & (c("cache_hit_share") < t.cache_hit_share), F.lit(LOW), c("cache_written")),
        Rule("jdbc_one_partition", (c("jdbc_partitions") == 1) & (c("jdbc_ms") >= t.one_partition_ms), F.lit(MEDIUM), c("jdbc_ms")),
    ]


def merged(parts: Sequence[DataFrame], replaced: Sequence[str] = ()) -> DataFrame:
    """All findings; of the replaced categories only those of the last part that has them."""
    out = parts[0]
    for p in parts[1:]:
        if replaced:
            out = out.join(p.filter(F.col("category").isin(*replaced)).select("category", "entity").distinct(), ["category", "entity"], "left_anti")
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def one_high_per_problem(findings: DataFrame, problem: Sequence[str]) -> DataFrame:
    """Of a problem's high findings the first by category and entity stays high; the others are medium."""
    first = findings.filter(F.col("severity") == HIGH).groupBy(*problem).agg(F.min(F.struct("category", "entity")).alias("__first"))
    out = findings.join(first, list(problem), "left")
    return out.withColumn("severity", F.when((F.col("severity") == HIGH) & (F.struct("category", "entity") != F.col("__first")), MEDIUM).otherwise(F.col("severity"))).drop("__first")


def counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, high, medium, low."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(n) for n, s in (("high", HIGH), ("medium", MEDIUM), ("low", LOW))])


def stage_flags(stages: DataFrame, t: Thresholds) -> DataFrame:
    """stages with boolean flags failed, retried, spill, skewed, gc, shuffle_heavy."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    return stages.withColumns({
        "failed": c("failure_reason").isNotNull(), "retried": yes(c("failed_tasks") > 0), "spill": yes(c("disk_spill") >= t.spill_bytes), "skewed": yes((c("skew") >= t.skew_ratio) & (c("max_task_ms") >= t.skew_min_task_ms)),
        "gc": yes((c("gc_ms") / F.greatest(c("task_ms"), F.lit(1)) >= t.gc_share) & (c("gc_ms") >= t.gc_min_ms)), "shuffle_heavy": yes(F.coalesce("shuffle_read", F.lit(0)) + F.coalesce("shuffle_write", F.lit(0)) >= t.shuffle_heavy_bytes),
    })
