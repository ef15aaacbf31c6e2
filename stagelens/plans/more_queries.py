"""More views, links and findings on the log-shaped tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.functions import plan_text as P
from stagelens.functions import text as T
from stagelens.operators import aggregates as A
from stagelens.operators import findings as FD
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators import windows as W
from stagelens.plans import views as V
from stagelens.plans.bound import DAY, HOUR, bound, cte
from stagelens.plans.log_queries import STAGE_KEYS, STAGE_TABLE, _stage_table
from stagelens.plans.queries import millis, query, read

# links ---------------------------------------------------------------------------------------------------------------


@query("""WITH op AS (SELECT c_custkey AS op, concat('tag', c_custkey) AS tag, concat('id', c_custkey * 3) AS ident FROM customer), j AS (SELECT o_orderkey AS job, [concat('tag', o_custkey * 5), concat('tag', o_orderkey % 4000)] AS tags, concat('id', o_orderkey % 700) AS ident, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey END AS prop FROM orders),
 t AS (SELECT job, min(op) AS op FROM (SELECT job, unnest(tags) AS tag FROM j) JOIN op USING (tag) GROUP BY job) SELECT j.job, coalesce(t.op, i.op, prop) AS op FROM j LEFT JOIN t USING (job) LEFT JOIN op i ON i.ident = j.ident""")
def job_operations(spark: SparkSession, d: str) -> DataFrame:
    """By tag, else by an embedded id, else by a property."""
    op = read(spark, d, "customer").select(F.col("c_custkey").alias("op"), F.concat(F.lit("tag"), "c_custkey").alias("tag"), F.concat(F.lit("id"), F.col("c_custkey") * 3).alias("ident"))
    j = read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.concat(F.lit("tag"), F.col("o_custkey") * 5, F.lit(","), F.lit("tag"), F.col("o_orderkey") % 4000).alias("tags"), F.concat(F.lit("id"), F.col("o_orderkey") % 700).alias("ident"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).alias("op"))
    by_tag = J.lowest_parent(j.select("job", F.explode(F.split("tags", ",")).alias("tag")).join(op, "tag"), ["job"], "op")
    return J.first_of(j.select("job", "ident"), ["job"], [(by_tag, ["job"]), (op, ["ident"]), (j, ["job"])], "op").select("job", "op")


@query(f"""WITH {cte("executors")} SELECT context, executor_id, CASE WHEN CAST(executor_id AS BIGINT) < 5 THEN 8000 WHEN CAST(executor_id AS BIGINT) % 2 = 0 THEN 4000 ELSE 2000 + cores END AS heap_mb FROM executors""")
def executor_resources(spark: SparkSession, d: str) -> DataFrame:
    """A profile's, else the properties', else the block manager's."""
    e, k = bound(spark, d, "executors"), F.col("executor_id").cast("int")
    keys = ["context", "executor_id"]
    one = lambda cond, v: e.filter(cond).select(*keys, v.alias("heap_mb"))
    return J.first_of(e, keys, [(one(k < 5, F.lit(8000)), keys), (one(k % 2 == 0, F.lit(4000)), keys), (one(k >= 0, F.lit(2000) + F.col("cores")), keys)], "heap_mb").select(*keys, "heap_mb")


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS q, o_orderkey - o_orderkey % 256 + (o_orderkey % 256) // 2 AS root, CASE WHEN o_orderkey % 256 < 2 OR o_orderkey % 11 = 0 THEN concat('run-', o_custkey) END AS run_key FROM orders),
 w AS (SELECT q, q AS cur, root, run_key FROM o UNION ALL SELECT w.q, o.q, o.root, o.run_key FROM w JOIN o ON o.q = w.root WHERE w.run_key IS NULL AND w.root <> w.cur) SELECT q, max(run_key) AS run_key FROM w GROUP BY q""")
def propagated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a run take the nearest one up their chain of parents, up to eight steps here."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    q = o.select(k.alias("q"), (k - k % 256 + F.floor(k % 256 / 2)).alias("root"), F.when((k % 256 < 2) | (k % 11 == 0), F.concat(F.lit("run-"), "o_custkey")).alias("run_key"))
    return J.propagate(q, "q", "root", "run_key").select("q", "run_key")


@query(f"""WITH {cte("queries", "stages")}, j AS (SELECT context, sql_execution_id AS job, sql_execution_id % 101 AS s1, sql_execution_id % 37 AS s2 FROM queries), e AS (SELECT context, job, s1 AS stage_id FROM j UNION ALL SELECT context, job, s2 FROM j), f AS (SELECT context, stage_id, min(job) AS src FROM e GROUP BY ALL)
SELECT e.context, f.src, job AS dst, stage_id FROM e JOIN f USING (context, stage_id) WHERE job > f.src""")
def reuse_edges(spark: SparkSession, d: str) -> DataFrame:
    """J3, J14."""
    k = F.col("sql_execution_id")
    return V.reuse_edges(bound(spark, d, "queries").select("context", k.alias("job_id"), F.array(k % 101, k % 37).alias("stage_ids")))


@query(f"""WITH {cte("stages")}, c AS (SELECT context, stage_id AS child, stage_attempt AS child_attempt, start_ms, unnest([stage_id - 3, stage_id - 6]) AS parent FROM stages)
SELECT c.context, parent, child, child_attempt, coalesce(max(p.stage_attempt) FILTER (p.start_ms <= c.start_ms), max(p.stage_attempt)) AS parent_attempt FROM c JOIN stages p ON p.context = c.context AND p.stage_id = parent GROUP BY ALL""")
def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    s = bound(spark, d, "stages").withColumn("parent_ids", F.array(F.col("stage_id") - 3, F.col("stage_id") - 6))
    return V.dag_edges(s)


@query(f"""WITH {cte("lines")}, n AS (SELECT event_id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY ts_ms, event_id) AS seq, line FROM lines) SELECT file_path, seq, line FROM n WHERE file_path = '/logs/executor/app-1/13/stderr' AND seq BETWEEN 5 AND 35""")
def log_context(spark: SparkSession, d: str) -> DataFrame:
    """10 lines before and 20 after one line of a file."""
    from pyspark.sql import Window

    n = bound(spark, d, "lines").withColumn("seq", F.row_number().over(Window.partitionBy("file_path").orderBy("ts_ms", "event_id")))
    return V.log_context(n, "/logs/executor/app-1/13/stderr", 15).select("file_path", "seq", "line")


@query("""SELECT event_id, CASE WHEN event_id % 50 = user_id THEN CAST(user_id AS VARCHAR) ELSE concat(event_id % 50, ',', user_id) END AS stages, CAST(user_id AS VARCHAR) AS executors FROM events""")
def named_scopes(spark: SparkSession, d: str) -> DataFrame:
    """G1: stages and executors that a finding's text names."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("Stage "), F.col("event_id") % 50, F.lit(".1 failed on executor "), "user_id", F.lit(", then stage "), "user_id", F.lit(" too, and stage "), F.col("event_id") % 50).alias("t"))
    s = V.scopes_of_text(e, "event_id", "t")
    return s.select("event_id", F.array_join("stages", ",").alias("stages"), F.array_join("executors", ",").alias("executors"))


@query(f"""WITH {cte("runs")} SELECT run_key, CASE WHEN k % 5 = 0 THEN 'job1|prog' WHEN k % 5 = 1 THEN 'prog' ELSE 'kind|label' END AS family, CASE WHEN k % 3 = 0 THEN concat('task_run:', k) WHEN k % 3 = 1 THEN concat('job_run:', k, '-7') ELSE 'app:a' END AS key FROM (SELECT run_key, CAST(substring(run_key, 5) AS BIGINT) AS k FROM runs)""")
def run_identities(spark: SparkSession, d: str) -> DataFrame:
    """P26, P27."""
    r = bound(spark, d, "runs").withColumn("k", F.substring("run_key", 5, 12).cast("long"))
    props = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("task_run_id"), F.col("k").cast("string"))).when(F.col("k") % 3 == 1, F.create_map(F.lit("job_group"), F.concat(F.lit("x_job-"), "k", F.lit("-run-7-action-1")))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    job, program = F.when(F.col("k") % 5 == 0, "job1"), F.when(F.col("k") % 5 <= 1, "prog")
    family = F.coalesce(F.nullif(V.run_family(job, program, F.lit("kind"), F.lit("label")), F.lit("")), program, F.lit("kind|label"))
    return r.select("run_key", family.alias("family"), T.run_key(props, F.lit("a")).alias("key"))


# views ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {cte("tasks")} SELECT context, stage_id, count(*) AS n, min(task_ms) AS "min", quantile_disc(task_ms, 0.1) AS p10, quantile_disc(task_ms, 0.5) AS p50, quantile_disc(task_ms, 0.9) AS p90, max(task_ms) AS "max", round(avg(task_ms), 6) AS avg FROM tasks WHERE NOT failed AND stage_id % 7 <> 0 GROUP BY ALL""")
def grain_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Good tasks' time at the grain of a job; stages without a job are left out."""
    t = bound(spark, d, "tasks")
    links = t.select("context", "stage_id").distinct().withColumn("job_id", F.when(F.col("stage_id") % 7 != 0, F.col("stage_id")))
    return V.grain_distribution(t, links, "job_id").withColumn("avg", F.round("avg", 6)).withColumnRenamed("job_id", "stage_id")


@query(f"""WITH {cte("tasks")}, k AS (SELECT *, CASE WHEN context = 'app-1' OR stage_id % 2 = 0 THEN NULL ELSE input_bytes END AS b FROM tasks), n AS (SELECT *, bool_or(b IS NOT NULL) OVER (PARTITION BY context) AS known FROM k) SELECT context, stage_id, CAST(sum(CASE WHEN known THEN coalesce(b, 0) END) AS BIGINT) AS input_bytes FROM n GROUP BY ALL""")
def storage_split(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return V.storage_split(bound(spark, d, "tasks").withColumn("input_bytes", F.when((F.col("context") != "app-1") & (F.col("stage_id") % 2 != 0), F.col("input_bytes"))))


@query(f"""WITH {cte("tasks", "stages")}, {STAGE_TABLE} SELECT context, stage_id % 20 AS sql_execution_id, count(*) AS stages, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(failed_tasks) AS BIGINT) AS failed_tasks, CAST(sum(task_ms) AS BIGINT) AS task_ms, CAST(sum(disk_spill) AS BIGINT) AS disk_spill, max(round(max_task_ms / greatest(p50_task_ms, 1), 1)) AS max_skew FROM st GROUP BY ALL""")
def query_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    s = _stage_table(spark, d)
    links = s.select("context", "stage_id").distinct().withColumn("sql_execution_id", F.col("stage_id") % 20)
    return V.query_rollup(s, links).select("context", "sql_execution_id", "stages", "tasks", "failed_tasks", "task_ms", "disk_spill", "max_skew")


@query(f"""WITH {cte("queries")}, j AS (SELECT concat('job_group:g', sql_execution_id % 60) AS run_key, * FROM (SELECT context, sql_execution_id, start_ms, end_ms, status FROM queries)), r AS (SELECT run_key, count(*) AS jobs, min(start_ms) AS s, max(end_ms) AS e, min_by(status, CASE status WHEN 'failed' THEN 0 WHEN 'open' THEN 1 ELSE 2 END) AS status FROM j GROUP BY run_key)
SELECT run_key, jobs, s AS start_ms, e - s AS duration_ms, status FROM r""")
def runs_of_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    jobs = bound(spark, d, "queries").withColumn("properties", F.create_map(F.lit("spark.jobGroup.id"), F.concat(F.lit("g"), F.col("sql_execution_id") % 60)))
    return V.runs(jobs).select("run_key", "jobs", F.unix_millis("start_time").alias("start_ms"), "duration_ms", "status")


@query("""WITH s AS (SELECT concat('set', l_suppkey % 40) AS setting, CAST(l_linenumber % (1 + l_suppkey % 3) AS VARCHAR) AS v FROM lineitem), sv AS (SELECT setting, list_sort(list(DISTINCT v)) AS vs FROM s GROUP BY setting), c AS (SELECT concat('set', s_suppkey % 25) AS setting, max(s_name) AS cv FROM supplier GROUP BY ALL), df AS (SELECT concat('set', n_nationkey) AS setting, n_name AS dv FROM nation)
SELECT coalesce(df.setting, c.setting, sv.setting) AS setting, array_to_string(vs, ',') AS session, coalesce(CASE WHEN len(vs) = 1 THEN vs[1] END, cv, dv) AS effective FROM df FULL JOIN c ON c.setting = df.setting FULL JOIN sv ON sv.setting = coalesce(df.setting, c.setting)""")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    name = lambda c: F.concat(F.lit("set"), c).alias("setting")
    session = read(spark, d, "lineitem").select(name(F.col("l_suppkey") % 40), (F.col("l_linenumber") % (1 + F.col("l_suppkey") % 3)).cast("string").alias("value"))
    cluster = read(spark, d, "supplier").select(name(F.col("s_suppkey") % 25), F.col("s_name").alias("value"))
    return V.settings_merge(cluster, session, read(spark, d, "nation").select(name(F.col("n_nationkey")), F.col("n_name").alias("value"))).select("setting", F.array_join("session_values", ",").alias("session"), "effective")


@query(f"""WITH {cte("tasks", "stages", "queries")} SELECT (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM tasks WHERE failed) AS failed_tasks, (SELECT CAST(sum(task_ms) AS BIGINT) FROM tasks) AS task_ms, (SELECT count(*) FROM stages) AS stages, (SELECT count(*) FROM stages WHERE failure_reason IS NOT NULL) AS failed_stages,
 (SELECT count(*) FROM queries) AS queries, (SELECT count(*) FROM queries WHERE status = 'failed') AS failed_queries""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    q = bound(spark, d, "queries")
    return V.totals(bound(spark, d, "tasks"), bound(spark, d, "stages"), q, q).select("tasks", "failed_tasks", "task_ms", "stages", "failed_stages", "queries", "failed_queries")


@query(f"""WITH {cte("runs")}, f AS (SELECT o_orderpriority AS category, concat('run-', o_orderkey) AS run_key, concat('e', o_custkey) AS entity, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS severity, o_totalprice AS measure FROM orders)
SELECT category, count(DISTINCT run_key) AS runs, count(DISTINCT CASE WHEN status = 'failed' THEN run_key END) AS failed_runs, min_by(entity, (severity, -measure, entity)) AS worst FROM f LEFT JOIN runs USING (run_key) GROUP BY category""")
def kinds_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    f = read(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), F.concat(F.lit("run-"), "o_orderkey").alias("run_key"), F.concat(F.lit("e"), "o_custkey").alias("entity"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("severity"), F.col("o_totalprice").alias("measure"))
    return V.kinds_over_runs(f, bound(spark, d, "runs"))


@query("""WITH p AS (SELECT l_orderkey AS id, concat('k', l_linenumber) AS setting, CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE concat('v', l_linenumber) END AS value FROM lineitem), r AS (SELECT id, setting, value, CASE setting WHEN 'k3' THEN 0 WHEN 'k1' THEN 1 WHEN 'k2' THEN 2 END AS k FROM p WHERE setting IN ('k1', 'k2', 'k3') AND trim(value) <> '')
SELECT id, min_by(value, k) AS "name", min_by(setting, k) AS source FROM r GROUP BY id""")
def first_keys(spark: SparkSession, d: str) -> DataFrame:
    """A36."""
    p = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("k"), "l_linenumber").alias("setting"), F.when(F.col("l_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("v"), "l_linenumber")).alias("value"))
    return V.first_key(p, "id", ["k3", "k1", "k2"], "name")


@query(f"""WITH {cte("runs")} SELECT max_by(run_key, (status = 'failed', end_ms - start_ms, run_key)) AS run_key FROM runs""")
def default_run(spark: SparkSession, d: str) -> DataFrame:
    """A report of one row."""
    return V.default_run(bound(spark, d, "runs").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")))


@query(f"""WITH {cte("tasks", "lines")}, t AS (SELECT executor_id, 0 AS p, finish_ms AS x, 'broadcast' AS site FROM tasks WHERE failed AND error LIKE '%OutOfMemory%' UNION ALL SELECT executor_id, 1, event_id, 'unknown' FROM lines WHERE exception LIKE '%OutOfMemory%' AND executor_id IS NOT NULL) SELECT executor_id, min_by(site, (p, x)) AS site FROM t GROUP BY executor_id""")
def executor_oom_sites(spark: SparkSession, d: str) -> DataFrame:
    """P11, A41."""
    e = bound(spark, d, "lines").filter("executor_id IS NOT NULL").select("executor_id", F.col("event_id").alias("seq"), "exception", F.array("frame").alias("frames"))
    return V.oom_sites(bound(spark, d, "tasks").filter("failed"), e)


@query(f"""WITH {cte("tasks")}, k AS (SELECT *, unnest(range(launch_ms // {7 * DAY}, (finish_ms - 1) // {7 * DAY} + 1)) AS bucket FROM tasks), s AS (SELECT context, executor_id, stage_id, bucket, round(sum(CAST(disk_spill AS DOUBLE) * (least(finish_ms, (bucket + 1) * {7 * DAY}) - greatest(launch_ms, bucket * {7 * DAY})) / (finish_ms - launch_ms))) AS spill FROM k GROUP BY ALL)
SELECT context, executor_id, bucket, sum(spill) AS disk_spill, array_to_string(list_sort(list(DISTINCT stage_id)), ',') AS stages FROM s WHERE spill > 0 GROUP BY ALL""")
def spill_markers(spark: SparkSession, d: str) -> DataFrame:
    """V12, V13."""
    m = V.spill_markers(V.spill_shuffle_timeline(bound(spark, d, "tasks"), 7 * DAY))
    return m.select("context", "executor_id", "bucket", "disk_spill", F.array_join(F.col("stages").cast("array<string>"), ",").alias("stages"))


@query(f"""WITH {cte("stages")} SELECT context, stage_id, stage_attempt, tasks FROM stages WHERE start_ms <= 946684800000 AND end_ms >= 852076800000""")
def in_window(spark: SparkSession, d: str) -> DataFrame:
    """P19."""
    return V.in_window(bound(spark, d, "stages"), "start_ms", "end_ms", F.lit(852_076_800_000), F.lit(946_684_800_000)).select("context", "stage_id", "stage_attempt", "tasks")


@query(f"""WITH {cte("runs", "queries")}, q AS (SELECT concat('run-', sql_execution_id // 2) AS run_key, min(start_ms) AS s, max(end_ms) AS e FROM queries GROUP BY ALL) SELECT run_key, least(start_ms, s) AS start_ms, greatest(end_ms, e) AS end_ms FROM runs LEFT JOIN q USING (run_key)""")
def widened_runs(spark: SparkSession, d: str) -> DataFrame:
    """I14."""
    q = bound(spark, d, "queries").withColumn("run_key", F.concat(F.lit("run-"), F.floor(F.col("sql_execution_id") / 2)))
    w = V.widened(bound(spark, d, "runs"), q.select("run_key", "start_time", "end_time"))
    return w.select("run_key", F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"))


@query("""SELECT row_number() OVER (ORDER BY x NULLS LAST, class, text) AS seq, x AS "at", kind, text FROM (SELECT epoch_us(o_orderdate) // 1000 AS x, 0 AS class, 'order' AS kind, concat('order ', o_orderkey) AS text FROM orders
 UNION ALL SELECT epoch_us(ts) // 1000, 1, event_type, concat('event ', event_id) FROM events UNION ALL SELECT NULL, 2, 'nation', n_name FROM nation)""")
def narrative(spark: SparkSession, d: str) -> DataFrame:
    """All orders, events and nations told in order."""
    o = read(spark, d, "orders").select(millis("o_orderdate").alias("at"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    e = read(spark, d, "events").select(millis("ts").alias("at"), F.concat(F.lit("event "), "event_id").alias("text"), F.col("event_type").alias("kind"))
    return V.story([(o, "order"), (e, F.col("kind")), (read(spark, d, "nation").select(F.lit(None).cast("long").alias("at"), F.col("n_name").alias("text")), "nation")])


@query(f"""WITH {cte("tasks", "executors")}, e AS (SELECT context, CASE WHEN executor_id = '15' THEN 'driver' ELSE executor_id END AS executor_id, finish_ms // {DAY} AS day, max(input_bytes // 1000000 % 4000) AS after, 4000 AS total FROM tasks GROUP BY ALL),
 days AS (SELECT context, unnest(range(min(day), max(day) + 1)) AS day FROM e GROUP BY context),
 x AS (SELECT context, executor_id, added_ms, removed_ms, CASE WHEN CAST(executor_id AS BIGINT) % 2 = 0 THEN 8000 END AS heap_mb FROM executors),
 g AS (SELECT d.context, d.day, e.executor_id, e.after, e.total, CASE WHEN e.executor_id <> 'driver' THEN coalesce(x.heap_mb, e.total) END AS heap FROM days d
   JOIN (SELECT DISTINCT context, executor_id FROM e) k ON k.context = d.context ASOF JOIN e ON e.context = k.context AND e.executor_id = k.executor_id AND e.day <= d.day LEFT JOIN x ON x.context = k.context AND x.executor_id = k.executor_id
   WHERE e.executor_id = 'driver' OR ((added_ms IS NULL OR added_ms < (d.day + 1) * {DAY}) AND (removed_ms IS NULL OR removed_ms > d.day * {DAY}))),
 r AS (SELECT context, day, CAST(sum(after) FILTER (heap IS NOT NULL) AS BIGINT) AS used_mb, CAST(sum(heap) AS BIGINT) AS up_mb, max(after / heap) AS m, min_by(executor_id, (-after / heap, executor_id)) FILTER (heap IS NOT NULL AND after > 0) AS max_exec, max(after / total) FILTER (executor_id = 'driver') AS ds FROM g GROUP BY ALL)
SELECT context, day * {DAY} AS minute, used_mb, up_mb, CASE WHEN up_mb IS NOT NULL THEN round(least(used_mb / up_mb, 1.0), 3) END AS share, CASE WHEN max_exec IS NOT NULL THEN round(least(m, 1.0), 3) END AS max_share, max_exec, round(ds, 3) AS driver_share FROM r WHERE up_mb IS NOT NULL OR ds IS NOT NULL""")
def heap_use(spark: SparkSession, d: str) -> DataFrame:
    """Heap in use while executors are up, by day; executor 15 speaks for the driver."""
    gc = bound(spark, d, "tasks").select("context", F.when(F.col("executor_id") != "15", F.col("executor_id")).alias("executor_id"), F.col("finish_ms").alias("ts_ms"), (F.floor(F.col("input_bytes") / 1_000_000) % 4000).alias("after_mb"), F.lit(4000).cast("long").alias("total_mb"))
    up = bound(spark, d, "executors").withColumn("heap_mb", F.when(F.col("executor_id").cast("int") % 2 == 0, F.lit(8000).cast("long")))
    return I.heap_use(gc, up, DAY)


@query(f"""WITH {cte("tasks")}, r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY task_ms DESC, task_id, executor_id, input_bytes) AS rank FROM tasks) SELECT context, rank, task_id, task_ms FROM r WHERE rank <= 10""")
def slowest_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A report of ten a context."""
    return W.top_n(bound(spark, d, "tasks"), ["context"], [F.desc("task_ms"), F.col("task_id"), F.col("executor_id"), F.col("input_bytes")], 10).select("context", "rank", "task_id", "task_ms")


@query(f"""WITH {cte("stages")} SELECT context, stage_id, stage_attempt, first_ms - start_ms AS wait_ms, tasks FROM stages ORDER BY tasks DESC, context, stage_id, stage_attempt LIMIT 20""")
def top_stages(spark: SparkSession, d: str) -> DataFrame:
    """A report of 20 rows."""
    return V.top(bound(spark, d, "stages").withColumn("wait_ms", F.col("first_ms") - F.col("start_ms")), "tasks", ["context", "stage_id", "stage_attempt"], 20).select("context", "stage_id", "stage_attempt", "wait_ms", "tasks")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def one_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 50 rows."""
    return W.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 50, 100)


@query(f"""WITH {cte("lines")}, b AS (SELECT context, file_path, max(ts_ms) AS built, count(*) AS n FROM lines GROUP BY ALL) SELECT context AS cluster_id, max_by(file_path, (built, file_path)) AS file_path, max(built) AS built FROM b GROUP BY context ORDER BY built DESC, context LIMIT 50""")
def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest output of each cluster; a report of 50 rows."""
    s = bound(spark, d, "lines").groupBy(F.col("context").alias("cluster_id"), "file_path").agg(F.max("ts_ms").alias("built"))
    return V.cluster_list(s).select("cluster_id", "file_path", "built")


@query("""WITH b AS (SELECT concat('s', o_custkey % 9) AS stream, o_orderkey // 3 AS batch, epoch_us(o_orderdate) // 1000 AS s, CAST(round(o_totalprice) AS BIGINT) AS took FROM orders) SELECT stream, count(DISTINCT batch) AS batches, min(s) AS first, max(s) AS last, quantile_disc(took, 0.5) AS median_ms FROM b GROUP BY stream""")
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """V7, P14."""
    start = F.timestamp_millis(millis("o_orderdate"))
    q = read(spark, d, "orders").select(F.concat(F.lit("runId = s"), F.col("o_custkey") % 9, F.lit("\nbatch = "), F.floor(F.col("o_orderkey") / 3)).alias("description"), start.alias("start_time"), F.timestamp_millis(millis("o_orderdate") + F.round("o_totalprice").cast("long")).alias("end_time"))
    m = V.micro_batches(q)
    return m.select("stream", "batches", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "median_ms")


# plan text -----------------------------------------------------------------------------------------------------------


def _plans(spark: SparkSession, d: str) -> DataFrame:
    """A plan's text for each order: an aggregate or a window over a scan or a JDBC read."""
    k = F.col("o_orderkey")
    head = F.when(k % 3 == 0, "AdaptiveSparkPlan isFinalPlan=true\n+- *(2) HashAggregate(keys=[], functions=[count(1)])\n   +- Exchange SinglePartition\n").otherwise("AdaptiveSparkPlan isFinalPlan=false\n+- Project [x#1]\n   +- Sort [a#1]\n")
    scan = F.when(k % 5 == 0, F.concat(F.lit("      +- Scan JDBCRelation((SELECT * FROM t"), F.col("o_custkey") % 7, F.lit(") q) [numPartitions="), k % 4 + 1, F.lit("] [a#1]\n"))).otherwise(F.concat(F.lit("      +- FileScan parquet cat.db.t"), F.col("o_custkey") % 7, F.lit("[a#1] Batched: true\n")))
    return read(spark, d, "orders").select("o_orderkey", F.concat(head, scan).alias("plan"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Scan' ELSE 'FileScan' END || CASE WHEN o_orderkey % 3 = 0 THEN ',Exchange,HashAggregate' ELSE ',Sort,Project' END AS operators, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('cat.db.t', o_custkey % 7) END AS tables, o_orderkey % 3 = 0 AS count_only, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 + 1 END AS partitions FROM orders""")
def plan_facts(spark: SparkSession, d: str) -> DataFrame:
    """P20, P22, P23."""
    p = F.col("plan")
    return _plans(spark, d).select("o_orderkey", F.array_join(P.operators(p), ",").alias("operators"), F.array_join(P.tables_read(p), ",").alias("tables"), P.count_only(p).alias("count_only"), P.jdbc(p)["partitions"].cast("long").alias("partitions"))


@query("""SELECT concat('c', o_orderkey % 2) AS context, count(*) AS queries, count(*) AS adaptive, count(*) FILTER (o_orderkey % 3 = 0) AS count_only FROM orders GROUP BY ALL""")
def engine_summary(spark: SparkSession, d: str) -> DataFrame:
    """V15."""
    t = F.timestamp_millis(F.lit(0))
    q = _plans(spark, d).select(F.concat(F.lit("c"), F.col("o_orderkey") % 2).alias("context"), F.col("o_orderkey").alias("sql_execution_id"), F.col("plan").alias("final_plan"), F.lit(None).cast("string").alias("initial_plan"), F.lit("d").alias("description"), t.alias("start_time"), t.alias("end_time"))
    return V.engine_summary(V.query_facts(q)).select("context", "queries", "adaptive", "count_only")


@query("""WITH p AS (SELECT md5(CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END || CASE WHEN o_orderkey % 5 = 0 THEN concat('j', o_custkey % 7, '-', o_orderkey % 4) ELSE concat('f', o_custkey % 7) END) AS k FROM orders) SELECT count(*) AS n FROM p GROUP BY k""")
def plan_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Plans that differ in expression and node numbers alone are one."""
    p = _plans(spark, d).withColumn("plan", F.regexp_replace("plan", "#1", F.lit("#1")))
    p = p.withColumn("plan", F.replace("plan", F.lit("#1"), F.concat(F.lit("#"), F.col("o_orderkey") % 90 + 1)))
    return p.groupBy(T.plan_hash(F.col("plan")).alias("h")).agg(F.count("*").alias("n")).select("n")


# findings ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {cte("executors")}, x AS (SELECT *, CAST(executor_id AS BIGINT) AS k FROM executors), f AS (SELECT 'executor_lost' AS category, 1 AS severity, context, executor_id FROM x WHERE removal_category = 'lost' UNION ALL SELECT 'gc_stuck', 0, context, executor_id FROM x WHERE k * 100 / 10.0 > 60 AND 0.6 > 0.5 AND k % 2 = 0
  UNION ALL SELECT 'jvm_full_gc', 1, context, executor_id FROM x WHERE NOT (k * 100 / 10.0 > 60 AND k % 2 = 0) AND (k * 100 >= 3) UNION ALL SELECT 'executors_idle', 2, context, executor_id FROM x WHERE k % 4 = 1) SELECT * FROM f""")
def executor_findings(spark: SparkSession, d: str) -> DataFrame:
    """F7, F9, F11."""
    k = F.col("executor_id").cast("int")
    e = bound(spark, d, "executors").withColumns({"removed_reason": F.col("removal_category"), "full_gcs": k * 100, "gc_minutes": F.lit(10.0), "stuck_full_gcs": F.when(k % 2 == 0, k * 60).otherwise(0), "gc_pause_share": F.lit(0.0), "idle_share": F.when(k % 4 == 1, 0.7).otherwise(0.1), "idle_core_min": F.lit(40.0)})
    return FD.detect(e, FD.executor_rules(FD.Thresholds()), F.col("executor_id"), ["context", "executor_id"]).select("category", "severity", "context", "executor_id")


@query(f"""WITH {cte("runs")}, r AS (SELECT run_key, wait_ms, end_ms - start_ms AS dur, CASE WHEN program LIKE '%7' THEN NULL ELSE (wait_ms % 10) / 10.0 END AS own FROM runs)
SELECT 'waited_for_cores' AS category, run_key AS entity, 1 AS severity, CAST(wait_ms AS DOUBLE) AS measure FROM r WHERE wait_ms >= 300000 AND wait_ms / greatest(dur, 1) >= 0.25
 UNION ALL SELECT 'capacity_bound', run_key, CASE WHEN wait_ms * 2 / greatest(dur, 1) >= 0.5 AND coalesce(own, 1) >= 0.5 THEN 0 ELSE 1 END, CAST(wait_ms * 2 AS DOUBLE) FROM r WHERE wait_ms * 2 >= 300000 AND wait_ms * 2 / greatest(dur, 1) >= 0.25
 UNION ALL SELECT 'no_spark_work', run_key, 1, CAST(dur - wait_ms AS DOUBLE) FROM r WHERE dur - wait_ms >= 120000 AND (dur - wait_ms) / greatest(dur, 1) >= 0.5""")
def run_findings(spark: SparkSession, d: str) -> DataFrame:
    """F16, F20, F30."""
    r = bound(spark, d, "runs").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    own = F.when(~F.col("program").like("%7"), F.col("wait_ms") % 10 / 10)
    r = r.withColumns({"queued_wall_ms": F.col("wait_ms") * 2, "own_share": own, "no_stage_ms": F.col("duration_ms") - F.col("wait_ms"), "count_only_ms": F.lit(0), "ddl_repeats": F.lit(0)})
    return FD.detect(r, FD.run_rules(FD.Thresholds()), F.col("run_key")).select("category", "entity", "severity", "measure")


@query("""WITH f AS (SELECT o_custkey % 200 AS problem, concat('c', o_orderkey % 3) AS category, CAST(o_orderkey AS VARCHAR) AS entity, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 2 END AS severity FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY problem, severity ORDER BY category, entity) AS k FROM f)
SELECT problem, category, entity, CASE WHEN severity = 0 AND k > 1 THEN 1 ELSE severity END AS severity FROM g""")
def one_high_per_problem(spark: SparkSession, d: str) -> DataFrame:
    """F33."""
    f = read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("problem"), F.concat(F.lit("c"), F.col("o_orderkey") % 3).alias("category"), F.col("o_orderkey").cast("string").alias("entity"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0).otherwise(2).alias("severity"))
    return FD.one_high_per_problem(f, ["problem"]).select("problem", "category", "entity", "severity")


@query("""WITH a AS (SELECT concat('c', o_orderkey % 4) AS category, CAST(o_custkey AS VARCHAR) AS entity, 1 AS part FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT concat('c', o_orderkey % 4) AS category, CAST(o_custkey AS VARCHAR) AS entity, 2 AS part FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT * FROM a WHERE NOT (category IN ('c0', 'c1') AND (category, entity) IN (SELECT (category, entity) FROM b)) UNION ALL SELECT * FROM b)
SELECT category, part, count(*) AS n FROM u GROUP BY ALL""")
def merged_findings(spark: SparkSession, d: str) -> DataFrame:
    """The later part's findings take the place of some categories' earlier ones."""
    of = lambda s, p: read(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.concat(F.lit("c"), F.col("o_orderkey") % 4).alias("category"), F.col("o_custkey").cast("string").alias("entity"), F.lit(p).alias("part"))
    return FD.merged([of("F", 1), of("O", 2)], ["c0", "c1"]).groupBy("category", "part").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT user_id % 20 AS k, epoch_us(ts) // 1000 // {HOUR} AS h FROM events), b AS (SELECT k, h, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT k, min(h) AS lo, max(h) AS hi FROM e GROUP BY k), g AS (SELECT k, unnest(range(lo, hi + 1)) AS h FROM r), q AS (SELECT g.k, g.h FROM g LEFT JOIN b ON b.k = g.k AND b.h = g.h WHERE coalesce(n, 0) < 2),
 m AS (SELECT k, h, h - row_number() OVER (PARTITION BY k ORDER BY h) AS grp FROM q) SELECT k, min(h) AS "start", max(h) + 1 AS "end", count(*) AS n FROM m GROUP BY k, grp HAVING count(*) >= 3""")
def idle_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of at least three buckets with next to no use while something is up."""
    e = read(spark, d, "events").select((F.col("user_id") % 20).alias("k"), F.floor(millis("ts") / HOUR).alias("h"))
    used = e.groupBy("k", "h").agg(F.count("*").alias("used"))
    up = e.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).select("k", F.explode(F.sequence("lo", "hi")).alias("h")).withColumn("up", F.lit(20))
    return I.underused(up, used, ["k"], "h", 0.1, 3)


@query("""WITH t AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n')) AS line FROM documents) WHERE line <> '' GROUP BY doc_id) SELECT source, CAST(sum(n) AS BIGINT) AS lines, count(*) AS docs FROM documents JOIN t USING (doc_id) GROUP BY source""")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files of lines."""
    lines = read(spark, d, "documents").select("doc_id", "source", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).filter("line <> ''")
    per = lines.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("lines"), F.count("*").alias("docs"))


@query(f"""WITH {cte("tasks")}, t AS (SELECT {STAGE_KEYS}, executor_id, count(*) AS tasks, CAST(sum(task_ms) AS BIGINT) AS task_ms FROM tasks GROUP BY ALL) SELECT *, round(task_ms / sum(task_ms) OVER (PARTITION BY {STAGE_KEYS}), 6) AS share FROM t""")
def stage_executors(spark: SparkSession, d: str) -> DataFrame:
    """A11, V1."""
    return V.stage_executors(bound(spark, d, "tasks")).select("context", "stage_id", "stage_attempt", "executor_id", "tasks", "task_ms", F.round("share", 6).alias("share"))


@query(f"""WITH {cte("queries")}, s AS (SELECT context, root_execution_id AS q, count(*) AS inner_queries, CAST(sum(duration_ms) AS BIGINT) AS inner_ms FROM queries WHERE root_execution_id <> sql_execution_id GROUP BY ALL) SELECT a.context, a.sql_execution_id, a.status, coalesce(inner_queries, 0) AS inner_queries, inner_ms, lower(substring(a.description, 1, 5)) AS head FROM queries a LEFT JOIN s ON s.context = a.context AND s.q = a.sql_execution_id""")
def query_detail(spark: SparkSession, d: str) -> DataFrame:
    """V4: a query with those inside it."""
    q = bound(spark, d, "queries")
    inside = q.filter("root_execution_id <> sql_execution_id").groupBy("context", F.col("root_execution_id").alias("sql_execution_id")).agg(F.count("*").alias("inner_queries"), F.sum("duration_ms").alias("inner_ms"))
    return q.join(inside, ["context", "sql_execution_id"], "left").select("context", "sql_execution_id", "status", F.coalesce("inner_queries", F.lit(0)).alias("inner_queries"), "inner_ms", F.substring(T.query_key(F.col("description")), 1, 5).alias("head"))


@query("""WITH t AS (SELECT doc_id, n_chars, lang, quantile_disc(n_chars, 0.5) OVER (PARTITION BY lang) AS m FROM documents WHERE n_chars IS NOT NULL) SELECT lang, count(*) AS docs, any_value(m) AS median FROM t GROUP BY lang""")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A1 over texts, a null language a group of its own."""
    return A.distribution(read(spark, d, "documents").filter("n_chars IS NOT NULL"), ["lang"], "n_chars", (0.5,)).select("lang", F.col("n").alias("docs"), F.col("p50").alias("median"))
