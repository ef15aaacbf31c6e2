"""The advice on the log-shaped tables, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.operators import aggregates as A
from stagelens.plans import advice as AD
from stagelens.plans import views as V
from stagelens.plans.bound import bound, cte
from stagelens.plans.log_queries import STAGE_KEYS, STAGE_TABLE, _stage_table
from stagelens.plans.queries import query

#: runs stand for orders, whose starts lie hours apart, so a burst's gap is six hours here
GAP = 21_600_000
SETTINGS = [("app-0", "spark.sql.shuffle.partitions", "299"), ("app-0", "spark.master", "local[8]"), ("app-1", "spark.sql.adaptive.enabled", "FALSE"), ("app-1", "spark.sql.adaptive.skewJoin.enabled", "false"), ("app-1", "spark.sql.files.maxPartitionBytes", "64 MB"), ("app-2", "spark.scheduler.mode", "FAIR"), ("app-2", "spark.speculation", "true")]
FOUND = ["dataframe_cache", "merge_rewrite", "no_spark_work", "count_only", "jdbc_one_partition", "empty_input", "tiny_task_stages", "core_hog", "cores_full"]
MB, GB = AD.MB, AD.GB
_set = "(VALUES " + ", ".join(f"('{c}', '{s}', '{v}')" for c, s, v in SETTINGS) + ") AS v(context, setting, value)"
_value = lambda s, default: f"coalesce((SELECT value FROM {_set} WHERE v.context = c.context AND setting = '{s}'), '{default}')"
_rules = " ".join(f"WHEN '{c}' THEN '{r}'" for c, (r, _, _) in AD.BY_FINDING.items())
_settings = " ".join(f"WHEN '{c}' THEN '{s}'" for c, (_, s, _) in AD.BY_FINDING.items() if s)
_shared = ", ".join(f"'{c}'" for c, (_, _, over) in AD.BY_FINDING.items() if over)


@query(f"""WITH {cte("tasks", "stages", "queries", "runs", "executors")}, {STAGE_TABLE},
 c AS (SELECT DISTINCT context FROM stages UNION SELECT DISTINCT context FROM runs),
 now AS (SELECT context, TRY_CAST({_value(AD.PARTITIONS, "200")} AS BIGINT) AS parts, lower({_value(AD.ADAPTIVE, "true")}) AS adaptive, lower({_value(AD.SKEW_JOIN, "true")}) AS skewjoin, CASE {_value(AD.SPLIT, "128m")} WHEN '64 MB' THEN 64 ELSE 128 END * {MB} AS split, upper({_value(AD.SCHEDULER, "FIFO")}) AS mode, lower({_value(AD.SPECULATION, "false")}) AS spec, {_value(AD.MASTER, "")} LIKE 'local%' AS loc FROM c),
 w1 AS (SELECT {STAGE_KEYS}, input_bytes + shuffle_read AS b, sum(input_bytes + shuffle_read) AS m FROM tasks WHERE NOT failed GROUP BY ALL), w2 AS (SELECT *, sum(m) OVER (PARTITION BY {STAGE_KEYS} ORDER BY b) AS run, sum(m) OVER (PARTITION BY {STAGE_KEYS}) AS tot FROM w1),
 wm AS (SELECT {STAGE_KEYS}, min(b) FILTER (run >= 0.5 * tot) AS wmed, max(b) AS mb FROM w2 GROUP BY ALL), s AS (SELECT st.*, now.*, wmed, mb, x.end_ms - x.start_ms AS d, x.end_ms - x.first_ms AS held FROM st JOIN wm USING ({STAGE_KEYS}) JOIN stages x USING ({STAGE_KEYS}) JOIN now USING (context)),
 h AS (SELECT *, tasks = parts AND shuffle_read > 0 AND greatest(wmed, p50_read_bytes) >= {128 * MB} AS p, input_bytes > 0 AND shuffle_read = 0 AND wmed >= 2 * split AS u, skewjoin = 'false' AND mb >= 5 * p50_read_bytes AND mb >= {256 * MB} AS k,
   spec = 'false' AND max_task_ms >= 300000 AND p50_task_ms > 0 AND max_task_ms >= 10 * p50_task_ms AND mb < 2 * p50_read_bytes AS l, row_number() OVER (PARTITION BY context ORDER BY disk_spill DESC, stage_id, stage_attempt) AS sr FROM s),
 spans AS (SELECT context, run_key, start_ms, end_ms, status FROM runs), ev AS (SELECT context, t, sum(x) AS x FROM (SELECT context, start_ms AS t, 1 AS x FROM spans UNION ALL SELECT context, end_ms, -1 FROM spans) GROUP BY ALL),
 pk AS (SELECT context, max(n) AS peak FROM (SELECT context, sum(x) OVER (PARTITION BY context ORDER BY t) AS n FROM ev) GROUP BY context),
 b0 AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY context ORDER BY start_ms, run_key) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM spans), b1 AS (SELECT *, sum(fresh) OVER (PARTITION BY context ORDER BY start_ms, run_key) AS grp FROM b0),
 b2 AS (SELECT context, grp, min(start_ms) AS first, max(start_ms) AS last, count(*) AS n, count(*) FILTER (end_ms - start_ms >= 300000) AS long, count(*) FILTER (status = 'failed') AS failed FROM b1 GROUP BY ALL HAVING count(*) >= 5),
 be AS (SELECT context, grp, t, sum(x) AS x FROM (SELECT context, grp, start_ms AS t, 1 AS x FROM b1 UNION ALL SELECT context, grp, end_ms, -1 FROM b1) GROUP BY ALL), bp AS (SELECT context, grp, max(n) AS peak FROM (SELECT context, grp, sum(x) OVER (PARTITION BY context, grp ORDER BY t) AS n FROM be) GROUP BY ALL),
 b AS (SELECT b2.*, coalesce((SELECT sum(cores) FROM executors e WHERE e.context = b2.context AND added_ms <= first AND (removed_ms IS NULL OR removed_ms > first)), 0) AS cores, (SELECT count(*) FROM executors e WHERE e.context = b2.context AND removal_category = 'autoscale' AND removed_ms BETWEEN first - {GAP} AND last + {GAP}) AS gone FROM b2 JOIN bp USING (context, grp) WHERE peak >= 3),
 rd AS (SELECT context, concat('lookup', sql_execution_id % 4) AS t, run_key, duration_ms FROM queries UNION ALL SELECT context, tables_read, run_key, duration_ms FROM queries), ag AS (SELECT context, t, count(DISTINCT run_key) AS runs, sum(duration_ms) AS took FROM rd WHERE (context, t) NOT IN (SELECT (context, table_written) FROM queries WHERE table_written IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT run_key) >= 5 AND sum(duration_ms) >= 120000),
 ar AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY took DESC, t) AS r FROM ag), en AS (SELECT context, count(*) FILTER (2 * input_bytes >= {10 * GB}) AS large FROM queries GROUP BY context),
 mg AS (SELECT *, max(end_ms) OVER (PARTITION BY context ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), bz AS (SELECT context, sum(greatest(0, end_ms - greatest(start_ms, coalesce(reach, start_ms)))) AS busy, sum(end_ms - start_ms) AS took FROM mg GROUP BY context),
 fd AS (SELECT context, [{", ".join(f"'{c}'" for c in FOUND)}][sql_execution_id % {len(FOUND)} + 1] AS category, CASE status WHEN 'failed' THEN 0 WHEN 'open' THEN 1 ELSE 2 END AS severity, duration_ms AS cost FROM queries WHERE NOT (context = 'app-2' AND sql_execution_id % {len(FOUND)} = 8)),
 fg AS (SELECT context, category, min(severity) AS sev, count(*) AS n, sum(cost) AS cost, max(cost) AS most FROM fd GROUP BY ALL),
 span AS (SELECT context, max(end_ms) AS last FROM stages GROUP BY context), cu AS (SELECT context, sum(greatest(0, (coalesce(removed_ms, last) - added_ms) * cores)) AS up, sum(cores) AS cores FROM executors JOIN span USING (context) GROUP BY context), us AS (SELECT context, sum(task_ms) FILTER (NOT failed) AS used FROM tasks GROUP BY context), ix AS (SELECT *, 1 - used / up AS idle FROM cu JOIN us USING (context) JOIN now USING (context)),
 a AS (SELECT context, 'too few shuffle partitions' AS rule, '{AD.PARTITIONS}' AS setting, NULL AS subject, CASE WHEN sum(disk_spill) >= {GB} THEN 0 ELSE 1 END AS severity, count(*) AS n, greatest(max(parts), ceil(max(shuffle_read) / {128 * MB})) AS suggest, sum(d) AS cost FROM h WHERE p GROUP BY context
  UNION ALL SELECT context, 'skew joins are not split', '{AD.SKEW_JOIN}', NULL, 0, count(*), NULL, NULL FROM h WHERE k GROUP BY context UNION ALL SELECT context, 'files cannot be split', '{AD.SPLIT}', NULL, 1, count(*), NULL, NULL FROM h WHERE u GROUP BY context
  UNION ALL SELECT context, 'slow tasks without more data', '{AD.SPECULATION}', NULL, 2, count(*), NULL, NULL FROM h WHERE l GROUP BY context
  UNION ALL SELECT context, 'spill', '{AD.MEMORY}', NULL, CASE WHEN sum(disk_spill) >= {50 * GB} THEN 0 ELSE 1 END, count(*) FILTER (disk_spill > 0), NULL, sum(held) FILTER (sr <= 3 AND disk_spill > 0) FROM h GROUP BY context HAVING sum(disk_spill) >= {GB}
  UNION ALL SELECT context, 'adaptive execution is off', '{AD.ADAPTIVE}', NULL, CASE WHEN loc THEN 2 ELSE 0 END, 1, NULL, NULL FROM now WHERE adaptive = 'false' UNION ALL SELECT context, 'runs share the executors', '{AD.SCHEDULER}', NULL, 2, peak, NULL, NULL FROM pk WHERE peak > 1
  UNION ALL SELECT context, 'burst of starts', NULL, CAST(first AS VARCHAR), CASE WHEN long >= 5 AND (cores = 0 OR long * 2 > cores) THEN CASE WHEN failed > 0 OR gone > 0 THEN 0 ELSE 1 END ELSE 2 END, n, NULL, NULL FROM b
  UNION ALL SELECT context, 'lookup read again', NULL, t, CASE WHEN took >= 600000 THEN 1 ELSE 2 END, runs, NULL, NULL FROM ar WHERE r <= 3 UNION ALL SELECT context, 'vectorised engine not used', '{AD.ENGINE}', NULL, 2, large, NULL, NULL FROM en JOIN now USING (context) WHERE NOT loc AND large > 0
  UNION ALL SELECT context, CASE category {_rules} END, CASE category {_settings} END, NULL, sev, n, NULL, floor(CASE WHEN category IN ({_shared}) THEN cost / greatest(1.0, took / busy) ELSE cost END) FROM fg JOIN bz USING (context) WHERE category <> 'core_hog'
  UNION ALL SELECT context, 'fifo stage', '{AD.SCHEDULER}', NULL, 0, n, NULL, most FROM fg JOIN now USING (context) WHERE category = 'core_hog' AND mode = 'FIFO'
  UNION ALL SELECT context, 'executors ran nothing', '{AD.WORKERS}', NULL, CASE WHEN idle >= 0.5 THEN 0 ELSE 1 END, cores, NULL, floor((up - used) / cores) FROM ix WHERE idle >= 0.3 AND NOT loc),
 f AS (SELECT *, rule IN ('burst of starts', 'runs share the executors') AS tk, bool_or(rule = 'runs waited for cores') OVER (PARTITION BY context) AS waited FROM a), g2 AS (SELECT *, count(*) FILTER (tk) OVER (PARTITION BY context) AS nt, min(severity) FILTER (tk) OVER (PARTITION BY context) AS worst FROM f),
 o AS (SELECT context, rule, setting, subject, CASE WHEN rule = 'runs waited for cores' THEN least(severity, worst) ELSE severity END AS severity, n, suggest, cost, CASE WHEN rule = 'runs waited for cores' THEN nt ELSE 0 END AS also FROM g2 WHERE NOT (tk AND waited))
SELECT context, row_number() OVER (PARTITION BY context ORDER BY rule <> 'cache larger than memory', severity = 2, rule NOT IN ('fifo stage', 'merge reads more than it merges'), coalesce(cost, 0) DESC, severity, rule, subject NULLS FIRST) AS rank, rule, setting, subject, CAST(severity AS INTEGER) AS severity, CAST(n AS BIGINT) AS n, CAST(suggest AS BIGINT) AS suggest, CAST(cost AS BIGINT) AS cost_ms, CAST(also AS BIGINT) AS also FROM o""")
def cluster_advice(spark: SparkSession, d: str) -> DataFrame:
    """R2: all rules at their own thresholds, over whole tables. Findings and settings are stand-ins (kinds dealt to queries by their number; app-2 has no finding of full cores, so its bursts and sharing stand alone)."""
    tasks, stages, q, runs, ex = (bound(spark, d, n) for n in ("tasks", "stages", "queries", "runs", "executors"))
    st = _stage_table(spark, d).join(stages.select(*V.STAGE, "first_ms"), V.STAGE)
    wmed = A.weighted_quantile(tasks.filter("NOT failed").withColumn("wmed_bytes", F.col("input_bytes") + F.col("shuffle_read")).withColumn("w", F.col("wmed_bytes")), V.STAGE, "wmed_bytes", "w")
    st = st.join(wmed, V.STAGE, "left").withColumnsRenamed({"p50_read_bytes": "p50_bytes", "max_read_bytes": "max_bytes"}).withColumns({"input_records": F.lit(0).cast("long"), "df_cache_bytes": F.lit(0).cast("long")})
    kind = F.col("sql_execution_id") % len(FOUND)
    severity = F.when(F.col("status") == "failed", 0).when(F.col("status") == "open", 1).otherwise(2)
    found = q.filter(~((F.col("context") == "app-2") & (kind == 8))).select("context", F.element_at(F.array(*map(F.lit, FOUND)), (kind + 1).cast("int")).alias("category"), severity.alias("severity"), F.col("duration_ms").alias("cost_ms"))
    lookup = F.concat(F.lit("lookup"), F.col("sql_execution_id") % 4)
    qs = q.select("context", "run_key", "duration_ms", "input_bytes", F.col("input_bytes").alias("shuffle_read"), F.lit(None).cast("double").alias("engine_share"), F.array("tables_read", lookup).alias("tables_read"), F.array_compact(F.array("table_written")).alias("tables_written"))
    use = V.core_use(tasks, ex).join(ex.groupBy("context").agg(F.sum("cores").alias("cores")), "context").withColumnsRenamed({"paid_core_ms": "core_ms_up", "good_task_ms": "core_ms_used"})
    settings = spark.createDataFrame(SETTINGS, "context string, setting string, value string")
    return AD.advice(st, settings, qs, runs, ex, found, use, GAP)
