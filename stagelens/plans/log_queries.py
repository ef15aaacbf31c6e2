"""Log operators, findings and views on the driver's tables in the shape of log tables (bound.py), each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.functions import plan_text as P
from stagelens.functions import text as T
from stagelens.operators import aggregates as A
from stagelens.operators import detectors as D
from stagelens.operators import findings as FD
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators import windows as W
from stagelens.operators import graph as G
from stagelens.plans import run_views as RV
from stagelens.plans import tables as TV
from stagelens.plans import tree as TR
from stagelens.plans import views as V
from stagelens.plans.bound import DAY, HOUR, MINUTE, bound, cte
from stagelens.plans.queries import millis, query, read

STAGE_KEYS = "context, stage_id, stage_attempt"
HAS_OOM = "regexp_matches(error, 'OutOfMemoryError|Java heap space')"

# log text ------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS ts_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, concat('user.', user_id) AS logger, concat(event_type, ' of ', event_id) AS message,
 CASE event_id % 3 WHEN 0 THEN 'log4j' WHEN 1 THEN 'jvm' ELSE 'iso' END AS kind FROM events WHERE event_id % 3 < 2
 UNION ALL SELECT event_id, (epoch_us(ts) // 1000000) * 1000, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, NULL, concat('user.', user_id, ': ', event_type, ' of ', event_id), 'iso' FROM events WHERE event_id % 3 = 2""")
def log_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Every event written as a log line in one of three forms, and read back."""
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("level", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"))
    user, said = F.concat(F.lit("user."), "user_id"), F.concat("event_type", F.lit(" of "), "event_id")
    log4j = F.concat(F.date_format("t", "yy/MM/dd HH:mm:ss "), "level", F.lit(" "), user, F.lit(": "), said)
    jvm = F.concat(F.date_format("t", "'['yyyy-MM-dd'T'HH:mm:ss.SSS'+0000]'"), F.lit("[12.5s]["), F.lower("level"), F.lit("]["), F.regexp_replace(user, r"\.", "_"), F.lit("] "), said)
    iso = F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss "), "level", F.lit(" "), user, F.lit(": "), said)
    p = e.select("event_id", T.log_prefix(F.when(F.col("event_id") % 3 == 0, log4j).when(F.col("event_id") % 3 == 1, jvm).otherwise(iso)).alias("p")).select("event_id", "p.*")
    return p.select("event_id", (F.unix_seconds("ts") * 1000).alias("ts_ms"), "level", F.regexp_replace("logger", "_", ".").alias("logger"), "message", "kind")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_orderkey AS BIGINT) END AS gc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'Pause Young' ELSE 'Pause Full' END AS kind,
 CASE WHEN l_orderkey % 2 = 0 THEN 'Normal, G1 Evacuation Pause' ELSE 'Ergonomics' END AS cause,
 CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS DOUBLE) ELSE round(l_partkey / 1024, 3) END AS heap_before_mb, CASE WHEN l_orderkey % 2 = 0 THEN CAST(1024 AS DOUBLE) ELSE round(l_suppkey / 1024, 3) END AS heap_after_mb,
 CASE WHEN l_orderkey % 2 = 0 THEN CAST(2048 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS heap_total_mb, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS DOUBLE) ELSE CAST(l_quantity * 1000 AS DOUBLE) END AS pause_ms FROM lineitem""")
def gc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Unified and legacy summaries."""
    li, q = read(spark, d, "lineitem"), F.col("l_quantity").cast("long")
    new = F.concat(F.lit("GC("), "l_orderkey", F.lit(") Pause Young (Normal) (G1 Evacuation Pause) "), q, F.lit("M->1G(2G) "), q, F.lit("ms"))
    old = F.concat(F.lit("[Full GC (Ergonomics) [x] "), "l_partkey", F.lit("K->"), "l_suppkey", F.lit("K(1024K), "), q, F.lit(" secs]"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", T.gc_event(F.when(F.col("l_orderkey") % 2 == 0, new).otherwise(old)).alias("g")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "g.*")


@query(f"""WITH {cte("tasks")} SELECT context, executor_id, CASE end_reason WHEN 'FetchFailed' THEN 'fetch_failed' WHEN 'ExceptionFailure' THEN CASE WHEN {HAS_OOM} THEN 'oom' WHEN error LIKE '%jdbc%reset%' THEN 'source_db' ELSE 'exception' END
 WHEN 'TaskKilled' THEN 'killed' WHEN 'ExecutorLostFailure' THEN CASE WHEN error LIKE '%container killed%' OR error LIKE '%OutOfMemory%' THEN 'oom' ELSE 'executor_lost' END ELSE 'other' END AS category, count(*) AS n
FROM tasks WHERE failed GROUP BY ALL""")
def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    """P10."""
    t = bound(spark, d, "tasks").filter("failed")
    return t.groupBy("context", "executor_id", T.failure_category(F.col("end_reason"), F.col("error"), F.lit(None).cast("string")).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes, CAST(o_custkey % 24 AS BIGINT) * 3600000 + CAST(o_orderkey % 60 AS BIGINT) * 60000 AS ms,
 CASE WHEN o_custkey < 1024 THEN concat(o_custkey, ' B') ELSE printf('%.1f KiB', floor(o_custkey / 1024.0 * 10 + 0.5) / 10) END AS size_text FROM orders""")
def sizes_and_durations(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and durations written out and read back."""
    o = read(spark, d, "orders")
    unit = F.element_at(F.array(*map(F.lit, ("", "k", "MB", "GiB"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    span = F.concat((F.col("o_custkey") % 24), F.lit("h "), (F.col("o_orderkey") % 60), F.lit("m"))
    return o.select("o_orderkey", T.parse_size(F.concat("o_custkey", unit)).alias("bytes"), T.parse_duration(span).alias("ms"), T.size_text(F.col("o_custkey")).alias("size_text"))


@query(f"""WITH {cte("executors")}, r AS (SELECT context, executor_id, CASE CAST(executor_id AS BIGINT) % 5 WHEN 0 THEN 'oom' WHEN 1 THEN 'autoscale' WHEN 2 THEN 'lost' WHEN 3 THEN 'termination' ELSE 'other' END AS removal_category,
 CASE CAST(executor_id AS BIGINT) % 5 WHEN 0 THEN 'container killed by the node' WHEN 1 THEN 'kill request from HTTP endpoint' WHEN 2 THEN 'heartbeat timed out' WHEN 3 THEN 'stopping SparkContext' ELSE 'unclear' END AS cause FROM executors) SELECT * FROM r""")
def removal_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons as JSON or plain text."""
    e = bound(spark, d, "executors").withColumn("k", F.col("executor_id").cast("int") % 5)
    said = F.element_at(F.array(*map(F.lit, ("container killed by the node", "kill request from HTTP endpoint", "heartbeat timed out", "stopping SparkContext", "unclear"))), F.col("k") + 1)
    e = e.withColumn("reason", F.when(F.col("executor_id").cast("int") % 2 == 0, F.concat(F.lit('{"cause":"'), said, F.lit('","reason":"x"}'))).otherwise(said))
    parts = T.removal_parts(F.col("reason"))
    return e.select("context", "executor_id", T.removal_category(parts["cause"]).alias("removal_category"), parts["cause"].alias("cause"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type IN ('view', 'error') THEN event_type END AS head FROM events), w AS (SELECT event_id, user_id, head, last_value(head IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lvl FROM e)
SELECT event_id, lvl AS level, head IS NULL AND lvl IS NOT NULL AS continuation FROM w""")
def inherited_context(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a level of their own take the last one's."""
    e = read(spark, d, "events").withColumn("level", F.col("event_type"))
    return W.inherit(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "error"), ["level"]).select("event_id", "level", "continuation")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_plan(spark: SparkSession, d: str) -> DataFrame:
    """The last row of a key wins."""
    e = read(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return J.latest(e, ["user_id"], "seq", ["event_type", "value"])


@query("""SELECT concat('f', user_id % 40) AS file, count(*) AS lines, count(*) FILTER (event_type = 'error' AND event_id % 7 <> 0) AS errors, count(*) FILTER (event_type = 'purchase' AND event_id % 7 <> 0) AS warnings,
 min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last, count(*) FILTER (event_type = 'view' AND value >= 90) AS full_gcs, max(value) FILTER (event_type = 'view') AS max_heap FROM events GROUP BY ALL""")
def log_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Lines, errors, warnings and heap figures of each file; continuations are no records."""
    e = read(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("file"), F.element_at(F.create_map(F.lit("error"), F.lit("ERROR"), F.lit("purchase"), F.lit("WARN")), F.col("event_type")).alias("level"), (F.col("event_id") % 7 == 0).alias("continuation"), millis("ts").alias("at"), F.when(F.col("event_type") == "view", F.col("value")).alias("heap"))
    return A.log_statistics(e, ["file"], "at", F.col("heap") >= 90, "heap")


# findings ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {cte("tasks")} SELECT 'oom_site' AS category, concat('stage ', stage_id, ' broadcast') AS entity, 0 AS severity, CAST(count(*) AS DOUBLE) AS measure, context, array_to_string(list_sort(list(DISTINCT executor_id)), ',') AS executors, min(finish_ms) AS at_ms
FROM tasks WHERE failed AND {HAS_OOM} GROUP BY context, stage_id""")
def oom_site_findings(spark: SparkSession, d: str) -> DataFrame:
    return D.oom_site_findings(bound(spark, d, "tasks"))


@query(f"""WITH {cte("lines", "stages", "executors")}, s AS (SELECT context, bool_or(stage_attempt > 0 OR coalesce(failure_reason LIKE '%FetchFailed%', false)) AS fetch, max(end_ms) AS e FROM stages GROUP BY context),
 g AS (SELECT context, bool_or(NOT coalesce(removal_category IN ('autoscale', 'termination'), false)) AS real FROM executors WHERE removed_ms IS NOT NULL GROUP BY context),
 ok AS (SELECT l.* FROM lines l LEFT JOIN s USING (context) LEFT JOIN g USING (context) WHERE signal IS NOT NULL AND (s.fetch IS NULL OR NOT ((signal = 'fetch_failure' AND NOT s.fetch) OR (signal IN ('executor_lost', 'cache_lost', 'cache_dropped') AND ts_ms >= s.e - 30000)
   OR (signal = 'executor_lost' AND NOT coalesce(g.real, false) AND NOT regexp_matches(line, 'ExecutorLostFailure|Lost executor')))))
SELECT 'log' AS category, signal AS entity, CASE signal WHEN 'executor_lost' THEN 0 WHEN 'disk_full' THEN 2 ELSE 1 END AS severity, CAST(count(*) AS DOUBLE) AS measure, count(DISTINCT executor_id) AS n_executor_id, min(ts_ms) AS first, max(ts_ms) AS last, min_by(line, (ts_ms, event_id)) AS line FROM ok GROUP BY signal""")
def signal_findings(spark: SparkSession, d: str) -> DataFrame:
    """F14, with the lines that are noise left out."""
    ok = D.confirmed_signals(bound(spark, d, "lines"), bound(spark, d, "stages"), bound(spark, d, "executors"))
    return D.signal_findings(ok, {"executor_lost": FD.HIGH, "disk_full": FD.LOW})


@query(f"""WITH {cte("lines")} SELECT 'exception' AS category, concat(exception, ' ', frame) AS entity, CASE WHEN exception LIKE '%OutOfMemoryError%' THEN 0 WHEN exception LIKE '%Interrupted%' THEN 2 ELSE 1 END AS severity, CAST(count(*) AS DOUBLE) AS measure,
 count(DISTINCT executor_id) AS executors, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(ts_ms) AS at_ms FROM lines WHERE exception IS NOT NULL GROUP BY exception, frame""")
def exception_findings(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    return D.exception_findings(bound(spark, d, "lines").filter("exception IS NOT NULL"), benign="InterruptedException")


CORES = """e_end AS (SELECT context, max(end_ms) AS end_ms FROM stages GROUP BY context), up AS (SELECT context, cores, added_ms AS s, coalesce(removed_ms, end_ms) AS e FROM executors JOIN e_end USING (context)),
 core_d AS (SELECT context, t, sum(x) AS x FROM (SELECT context, s AS t, cores AS x FROM up WHERE e > s UNION ALL SELECT context, e, -cores FROM up WHERE e > s) GROUP BY ALL), core_l AS (SELECT context, t, CAST(sum(x) OVER (PARTITION BY context ORDER BY t) AS BIGINT) AS level FROM core_d),
 core_p AS (SELECT context, max(level) AS peak FROM core_l GROUP BY context)"""


@query(f"""WITH {cte("stages", "executors", "runs")}, {CORES}, h AS (SELECT s.*, end_ms - first_ms AS held, peak FROM stages s JOIN core_p USING (context) WHERE end_ms - first_ms >= 1800000 AND tasks > peak),
 r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY held DESC, stage_id, stage_attempt) AS k FROM h), hog AS (SELECT * FROM r WHERE k = 1),
 b AS (SELECT hog.context, count(*) AS behind, max_by(runs.run_key, (wait_ms, runs.run_key)) AS worst FROM hog JOIN runs ON runs.context = hog.context AND wait_ms >= 60000 AND runs.start_ms < hog.end_ms AND runs.end_ms > hog.first_ms GROUP BY hog.context)
SELECT 'core_hog' AS category, concat('stage ', stage_id) AS entity, 0 AS severity, CAST(held AS DOUBLE) AS measure, hog.context, peak, coalesce(behind, 0) AS behind, worst FROM hog LEFT JOIN b ON b.context = hog.context""")
def core_hogs(spark: SparkSession, d: str) -> DataFrame:
    """F17."""
    return D.core_hogs(bound(spark, d, "stages"), bound(spark, d, "executors"), bound(spark, d, "runs"))


SWEEP3 = """small AS (SELECT context, added_ms AS s, coalesce(removed_ms, added_ms + CAST(17280000000 AS BIGINT)) AS e, 1 AS cores FROM executors WHERE coalesce(removed_ms, added_ms + CAST(17280000000 AS BIGINT)) > added_ms AND CAST(executor_id AS BIGINT) < 4),
 sw_d AS (SELECT context, t, CAST(sum(q) AS BIGINT) AS q, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM (
   SELECT context, launch_ms - 60000 AS t, 1 AS q, 0 AS b, 0 AS c FROM tasks UNION ALL SELECT context, launch_ms, -1, 0, 0 FROM tasks UNION ALL SELECT context, launch_ms, 0, 1, 0 FROM tasks UNION ALL SELECT context, finish_ms, 0, -1, 0 FROM tasks
   UNION ALL SELECT context, s, 0, 0, cores FROM small UNION ALL SELECT context, e, 0, 0, -cores FROM small) GROUP BY ALL),
 sw AS (SELECT context, t, lead(t) OVER w AS until, sum(q) OVER w AS q, sum(b) OVER w AS b, sum(c) OVER w AS c FROM sw_d WINDOW w AS (PARTITION BY context ORDER BY t)),
 most AS (SELECT context, max(c) AS m FROM sw WHERE until IS NOT NULL GROUP BY context),
 full_s AS (SELECT context, t AS s, until AS e, least(q, m - c) * (until - t) AS short FROM sw JOIN most USING (context) WHERE until IS NOT NULL AND q > 0 AND b >= c AND c < m),
 full_m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY context ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1999 THEN 1 WHEN row_number() OVER (PARTITION BY context ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS fresh FROM full_s),
 full_n AS (SELECT *, sum(fresh) OVER (PARTITION BY context ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM full_m),
 ep AS (SELECT context, min(s) AS s, max(e) AS e, count(*) AS n, CAST(sum(short) AS BIGINT) AS short FROM full_n GROUP BY context, k HAVING max(e) - min(s) >= 30000)"""


def _small(e: DataFrame) -> DataFrame:
    far = F.coalesce("removed_ms", F.col("added_ms") + 200 * DAY)
    return e.filter(F.col("executor_id").cast("int") < 4).select("context", F.col("added_ms").alias("s"), far.alias("e"), F.lit(1).alias("cores"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    t, small = bound(spark, d, "tasks"), _small(bound(spark, d, "executors"))
    span = lambda a, b: t.select("context", a.alias("s"), b.alias("e"))
    sweep = D.cluster_sweep(span(F.col("launch_ms") - MINUTE, F.col("launch_ms")), span(F.col("launch_ms"), F.col("finish_ms")), small, ["context"], "s", "e", F.col("cores"), 30 * DAY)
    return D.queue_episodes(sweep, ["context"], width=30 * DAY)


@query(f"""WITH {cte("tasks", "executors")}, {SWEEP3} SELECT context, s AS "start", e AS "end", n, short FROM ep""")
def queue_episodes(spark: SparkSession, d: str) -> DataFrame:
    """I8, over a sweep of queued and running tasks against the cores that are up."""
    return _episodes(spark, d)


@query(f"""WITH {cte("tasks", "executors")}, {SWEEP3}, f AS (SELECT context, min(s) AS queue_ms, CAST(sum(short) AS BIGINT) AS short FROM ep GROUP BY context), a AS (SELECT f.*, (SELECT min(launch_ms) FROM tasks t WHERE t.context = f.context AND t.task_index = 7 AND t.launch_ms > queue_ms) AS added FROM f)
SELECT 'autoscale_lag' AS category, context AS entity, CASE WHEN added - queue_ms >= 300000 THEN 0 ELSE 1 END AS severity, CAST(added - queue_ms AS DOUBLE) AS measure, context, queue_ms, short FROM a WHERE added - queue_ms >= 120000 AND short >= 600000""")
def autoscale_lag(spark: SparkSession, d: str) -> DataFrame:
    """Executors come when a task of index 7 starts."""
    added = bound(spark, d, "tasks").filter("task_index = 7").select("context", F.col("launch_ms").alias("added_ms"))
    return D.autoscale_lags(_episodes(spark, d), added, ["context"])


@query(f"""WITH {cte("stages", "executors", "lines")}, gone AS (SELECT * FROM executors WHERE removed_ms IS NOT NULL), au AS (SELECT context, removed_ms AS t FROM gone WHERE removal_category = 'autoscale'),
 m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY context ORDER BY t) <= {30 * DAY} THEN 0 ELSE 1 END AS fresh FROM au), n AS (SELECT *, sum(fresh) OVER (PARTITION BY context ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m),
 b AS (SELECT context, min(t) AS s, max(t) AS e, count(*) AS n FROM n GROUP BY context, k), bn AS (SELECT *, lead(s) OVER (PARTITION BY context ORDER BY s) AS nxt FROM b),
 act AS (SELECT b.context, b.s, count(*) AS active, min(stage_id) AS stage_id FROM b JOIN stages st ON st.context = b.context AND st.start_ms <= b.e AND st.end_ms >= b.s GROUP BY ALL),
 l AS (SELECT context, ts_ms + {DAY * 365 * 30 - 1_000_000_000_000} AS x FROM lines WHERE signal = 'cache_lost'),
 o AS (SELECT l.context, l.x, g.removed_ms, g.removal_category FROM l ASOF JOIN (SELECT context, removed_ms // 1000 * 1000 AS at, removed_ms, removal_category, max(CAST(executor_id AS BIGINT)) OVER (PARTITION BY context, removed_ms // 1000) AS q, CAST(executor_id AS BIGINT) AS id FROM gone QUALIFY q = id) g ON l.context = g.context AND l.x >= g.at),
 lost AS (SELECT bn.context, bn.s, count(*) AS lost FROM o JOIN bn ON o.context = bn.context AND removal_category = 'autoscale' AND removed_ms BETWEEN bn.s AND bn.e AND x >= bn.s // 1000 * 1000 AND (nxt IS NULL OR x < nxt) GROUP BY ALL)
SELECT 'autoscale_removed' AS category, CAST(n AS VARCHAR) AS entity, CASE WHEN coalesce(lost, 0) >= 10 THEN 0 ELSE 1 END AS severity, CAST(coalesce(lost, 0) AS DOUBLE) AS measure, b.context, b.s AS "start", b.e AS "end", coalesce(active, 0) AS active, stage_id
FROM b LEFT JOIN act ON act.context = b.context AND act.s = b.s LEFT JOIN lost ON lost.context = b.context AND lost.s = b.s WHERE coalesce(active, 0) > 0 OR coalesce(lost, 0) > 0""")
def autoscale_removals(spark: SparkSession, d: str) -> DataFrame:
    """The lines' times are moved into the executors' years."""
    lines = bound(spark, d, "lines").withColumn("ts_ms", F.col("ts_ms") + (DAY * 365 * 30 - 1_000_000_000_000))
    return D.autoscale_removals(bound(spark, d, "executors"), bound(spark, d, "stages"), lines, gap=30 * DAY, many=10)


@query(f"""WITH {cte("stages", "executors", "runs")}, {CORES}, sums AS (SELECT context, sum(end_ms - start_ms) AS total, sum(wait_ms) AS wait, count(*) AS runs, max_by(run_key, (wait_ms, run_key)) AS worst FROM runs GROUP BY context),
 bad AS (SELECT * FROM sums WHERE total > 0 AND wait >= 1800000 AND wait >= 0.2 * total), rd AS (SELECT context, t, sum(x) AS x FROM (SELECT context, start_ms AS t, 1 AS x FROM runs WHERE end_ms > start_ms UNION ALL SELECT context, end_ms, -1 FROM runs WHERE end_ms > start_ms) GROUP BY ALL),
 rl AS (SELECT context, t, CAST(sum(x) OVER (PARTITION BY context ORDER BY t) AS BIGINT) AS level FROM rd), rp AS (SELECT context, max(level) AS peak, max_by(t, (level, -t)) AS peak_at FROM rl GROUP BY context),
 th AS (SELECT e.context, sum(cores) AS cores_then FROM executors e JOIN bad USING (context) JOIN rp USING (context) WHERE added_ms <= peak_at AND (removed_ms IS NULL OR removed_ms > peak_at) GROUP BY e.context)
SELECT 'cores_full' AS category, CAST(runs AS VARCHAR) AS entity, CASE WHEN wait >= 0.4 * total THEN 0 ELSE 1 END AS severity, CAST(wait AS DOUBLE) AS measure, bad.context, rp.peak, peak_at, CAST(cores_then AS BIGINT) AS cores_then, core_p.peak AS cores_most, worst
FROM bad JOIN rp USING (context) LEFT JOIN th USING (context) LEFT JOIN core_p USING (context)""")
def cores_full(spark: SparkSession, d: str) -> DataFrame:
    """F21, W16."""
    s = bound(spark, d, "stages")
    return D.cores_full(bound(spark, d, "runs"), bound(spark, d, "executors"), D.ends_of(s))


@query("""WITH s AS (SELECT concat('c', l_orderkey % 5) AS context, l_orderkey, count(*) * 10 AS tasks, quantile_disc(CAST(l_quantity AS BIGINT), 0.5) AS p50, sum(CAST(l_quantity AS BIGINT)) * 1000 AS ms FROM lineitem GROUP BY ALL), a AS (SELECT context, sum(tasks) AS all_tasks FROM s GROUP BY context),
 g AS (SELECT context, tasks, count(*) AS stages, CAST(sum(ms) AS BIGINT) AS ms FROM s WHERE tasks >= 20 AND p50 <= 30 GROUP BY ALL)
SELECT 'tiny_task_stages' AS category, concat(stages, ' x ', tasks) AS entity, CASE WHEN ms >= 60000 THEN 1 ELSE 2 END AS severity, CAST(stages * tasks AS DOUBLE) AS measure, g.context, ms FROM g JOIN a USING (context) WHERE stages >= 10 AND stages * tasks >= greatest(100.0, 0.1 * all_tasks)""")
def tiny_task_stages(spark: SparkSession, d: str) -> DataFrame:
    """F31."""
    q = F.col("l_quantity").cast("long")
    s = read(spark, d, "lineitem").withColumns({"q": q, "context": F.concat(F.lit("c"), F.col("l_orderkey") % 5)}).groupBy("context", "l_orderkey").agg((F.count("*") * 10).alias("tasks"), A.quantile("q", 0.5).alias("p50_task_ms"), (F.sum("q") * 1000).alias("duration_ms"))
    return D.tiny_task_stages(s.withColumn("p50_bytes", F.lit(0)), p50_ms=30, share=0.1, floor=100)


@query(f"""WITH {cte("queries")}, e AS (SELECT * FROM queries WHERE sql_execution_id % 3 = 0), r AS (SELECT e.* FROM e LEFT JOIN e p ON e.context = p.context AND p.sql_execution_id = e.root_execution_id AND e.root_execution_id <> e.sql_execution_id WHERE p.context IS NULL AND e.input_records < 20000000 AND e.input_bytes < 4000000000)
SELECT 'empty_input' AS category, CAST(count(*) AS VARCHAR) AS entity, CASE WHEN sum(duration_ms) >= 3600000 THEN 1 ELSE 2 END AS severity, CAST(sum(duration_ms) AS DOUBLE) AS measure, context, count(DISTINCT run_key) AS runs, max_by(sql_execution_id, (duration_ms, sql_execution_id)) AS longest FROM r GROUP BY context HAVING sum(duration_ms) >= 600000""")
def empty_inputs(spark: SparkSession, d: str) -> DataFrame:
    """F29."""
    return D.empty_inputs(bound(spark, d, "queries"), F.col("sql_execution_id") % 3 == 0, records=20_000_000, bytes_=4_000_000_000)


@query(f"""WITH {cte("queries")} SELECT 'ddl_loop' AS category, 'ALTER TABLE ? SET TBLPROPERTIES (A = ' || CASE WHEN true THEN sql_execution_id || ')' END AS entity, 1 AS severity, CAST(count(*) AS DOUBLE) AS measure, context, run_key, CAST(sum(duration_ms) AS BIGINT) AS ms FROM queries WHERE description LIKE 'ALTER%' GROUP BY ALL HAVING sum(duration_ms) >= 60000
 UNION ALL SELECT 'ddl_loop', 'ALTER TABLE ? SET TBLPROPERTIES (A = ' || sql_execution_id || ')', 2, CAST(count(*) AS DOUBLE), context, run_key, CAST(sum(duration_ms) AS BIGINT) FROM queries WHERE description LIKE 'ALTER%' GROUP BY ALL HAVING sum(duration_ms) < 60000""")
def ddl_loops(spark: SparkSession, d: str) -> DataFrame:
    """Shapes keep bare numbers, so each statement here is its own; one is enough."""
    return D.ddl_loops(bound(spark, d, "queries"), more_than=0)


@query(f"""WITH {cte("queries", "runs")}, c AS (SELECT run_key, count(*) AS n, CAST(sum(least(duration_ms, duration_ms // 2)) AS BIGINT) AS ms FROM queries WHERE sql_execution_id % 2 = 0 AND duration_ms // 2 > 0 GROUP BY run_key),
 r AS (SELECT run_key, max(end_ms) - min(start_ms) AS dur FROM queries GROUP BY run_key)
SELECT 'count_only' AS category, run_key AS entity, CASE WHEN ms >= 0.3 * dur THEN 0 ELSE 1 END AS severity, CAST(ms AS DOUBLE) AS measure, n FROM c JOIN r USING (run_key) WHERE ms >= 60000 AND ms >= 0.00001 * dur""")
def count_only_runs(spark: SparkSession, d: str) -> DataFrame:
    """F24."""
    q = bound(spark, d, "queries").withColumn("busy_ms", F.floor(F.col("duration_ms") / 2))
    return D.count_only_runs(q, q, F.col("sql_execution_id") % 2 == 0, share=0.00001)


@query(f"""WITH {cte("queries")} SELECT 'dedup_noop' AS category, CAST(sql_execution_id AS VARCHAR) AS entity, CASE WHEN input_bytes >= 9000000000 * 11 THEN 1 ELSE 2 END AS severity, CAST(input_records AS DOUBLE) AS measure, context, run_key FROM queries WHERE sql_execution_id % 5 = 0 AND input_records >= 10000000 AND output_records = input_records""")
def dedup_noops(spark: SparkSession, d: str) -> DataFrame:
    """F26."""
    q = bound(spark, d, "queries").withColumn("shuffle_read", F.when(F.col("input_bytes") >= 99_000_000_000, 100 * FD.GB).otherwise(0))
    return D.dedup_noops(q, F.col("sql_execution_id") % 5 == 0)


@query(f"""WITH {cte("tasks")}, r AS (SELECT context, CAST(sum(input_bytes) // 100 AS BIGINT) AS hit, CAST(sum(input_bytes) AS BIGINT) AS miss, CAST(sum(shuffle_write) AS BIGINT) AS wr FROM tasks GROUP BY context)
SELECT 'disk_cache' AS category, context AS entity, 2 AS severity, CAST(wr AS DOUBLE) AS measure, hit, miss FROM r WHERE wr >= 10737418240 AND hit < 0.1 * (hit + miss)""")
def disk_caches(spark: SparkSession, d: str) -> DataFrame:
    """F27."""
    t = bound(spark, d, "tasks").groupBy("context").agg(F.floor(F.sum("input_bytes") / 100).cast("long").alias("hit"), F.sum("input_bytes").alias("miss"), F.sum("shuffle_write").alias("written"))
    return D.disk_caches(t)


@query(f"""WITH {cte("stages", "executors", "queries", "lines")}, {CORES}, n_d AS (SELECT context, t, sum(x) AS x FROM (SELECT context, s AS t, 1 AS x FROM up WHERE e > s UNION ALL SELECT context, e, -1 FROM up WHERE e > s) GROUP BY ALL), n_p AS (SELECT context, max(l) AS alive FROM (SELECT context, CAST(sum(x) OVER (PARTITION BY context ORDER BY t) AS BIGINT) AS l FROM n_d) GROUP BY context),
 b AS (SELECT context, count(*) AS queries, max(input_bytes) AS big, max_by(sql_execution_id, (input_bytes, sql_execution_id)) AS query FROM queries WHERE sql_execution_id % 7 = 0 GROUP BY context), l AS (SELECT context, count(*) FILTER (signal = 'cache_lost') AS cache_lost FROM lines GROUP BY context)
SELECT 'dataframe_cache' AS category, CAST(query AS VARCHAR) AS entity, CASE WHEN big > 2 * alive * 1000000000 OR cache_lost >= 100 THEN 0 ELSE 1 END AS severity, CAST(big AS DOUBLE) AS measure, b.context, queries, alive * 1000000000 AS room, coalesce(cache_lost, 0) AS cache_lost
FROM b LEFT JOIN n_p USING (context) LEFT JOIN l USING (context) WHERE big > alive * 1000000000 OR cache_lost > 0""")
def dataframe_caches(spark: SparkSession, d: str) -> DataFrame:
    """F23."""
    q = bound(spark, d, "queries").filter("sql_execution_id % 7 = 0").withColumn("cache_bytes", F.col("input_bytes"))
    e = bound(spark, d, "executors").withColumn("unified_memory", F.lit(1_000_000_000).cast("long"))
    return D.dataframe_caches(q, e, D.ends_of(bound(spark, d, "stages")), bound(spark, d, "lines"))


@query(f"""WITH {cte("stages", "queries")}, sp AS (SELECT context, min(start_ms) AS s, max(end_ms) AS e FROM queries GROUP BY context), short_st AS (SELECT context, first_ms AS st, first_ms + 8640000000 AS en FROM stages),
 d AS (SELECT context, t, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT context, s AS t, 1 AS a, 0 AS b, 0 AS c FROM sp UNION ALL SELECT context, e, -1, 0, 0 FROM sp UNION ALL SELECT context, st, 0, 1, 0 FROM short_st UNION ALL SELECT context, en, 0, -1, 0 FROM short_st
   UNION ALL SELECT context, start_ms, 0, 0, 1 FROM queries WHERE end_ms > start_ms UNION ALL SELECT context, end_ms, 0, 0, -1 FROM queries WHERE end_ms > start_ms) GROUP BY ALL),
 l AS (SELECT context, lead(t) OVER w - t AS dt, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(c) OVER w AS c FROM d WINDOW w AS (PARTITION BY context ORDER BY t))
SELECT context, CAST(sum(dt) FILTER (a > 0) AS BIGINT) AS total, CAST(coalesce(sum(dt) FILTER (a > 0 AND b = 0), 0) AS BIGINT) AS no_stage, CAST(coalesce(sum(dt) FILTER (a > 0 AND b = 0 AND c = 0), 0) AS BIGINT) AS "between", CAST(coalesce(sum(dt) FILTER (a > 0 AND b = 0 AND c > 0), 0) AS BIGINT) AS inside FROM l GROUP BY context""")
def no_stage_time(spark: SparkSession, d: str) -> DataFrame:
    """I12, I4, F30's input: time of a context in which no stage ran, inside and between its statements."""
    q, s = bound(spark, d, "queries"), bound(spark, d, "stages").select("context", F.col("first_ms").alias("start_ms"), (F.col("first_ms") + 100 * DAY).alias("end_ms"))
    return D.no_stage_time(q, s, q.select("context", "start_ms", "end_ms"), "context", "start_ms", "end_ms")


@query(f"""WITH l AS (SELECT concat('script', user_id % 4) AS script, concat('h', user_id % 9) AS host, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_type = 'error' THEN concat('error in step ', event_id) ELSE concat('step ', event_id) END AS line, event_type FROM events),
 r AS (SELECT script, host, min(ts_ms) AS t FROM l GROUP BY ALL), a AS (SELECT host, ts_ms FROM l WHERE event_type = 'purchase'), j AS (SELECT script, max(x - t) AS join_ms FROM (SELECT r.*, (SELECT min(ts_ms) FROM a WHERE a.host = r.host AND a.ts_ms >= r.t) AS x FROM r) WHERE x - t <= {HOUR} GROUP BY script)
SELECT 'init_script' AS category, script AS entity, 1 AS severity, CAST(count(*) AS DOUBLE) AS measure, count(DISTINCT host) AS nodes, min_by(line, (ts_ms, line)) AS first, join_ms FROM l LEFT JOIN j USING (script) WHERE event_type = 'error' GROUP BY script, join_ms""")
def init_scripts(spark: SparkSession, d: str) -> DataFrame:
    """F32, J13."""
    e = read(spark, d, "events").select(F.concat(F.lit("script"), F.col("user_id") % 4).alias("script"), F.concat(F.lit("h"), F.col("user_id") % 9).alias("host"), millis("ts").alias("ts_ms"), F.concat(F.when(F.col("event_type") == "error", "error in step ").otherwise("step "), "event_id").alias("line"), "event_type")
    up = e.filter("event_type = 'purchase'").select("host", F.col("ts_ms").alias("added_ms"))
    return D.init_scripts(e.drop("event_type"), up, wait_ms=HOUR)


@query(f"""WITH {cte("queries")}, p AS (SELECT *, CASE WHEN sql_execution_id % 4 = 3 AND table_written IS NOT NULL THEN concat('s3://bucket/', table_written) ELSE table_written END AS w FROM queries), r AS (SELECT context, sql_execution_id, min(w) AS t FROM p WHERE w NOT LIKE '%/%' GROUP BY ALL)
SELECT q.context, q.sql_execution_id, CASE WHEN status = 'failed' AND error LIKE '%5-LOW' THEN 'replanned' ELSE status END AS status,
  CASE WHEN q.root_execution_id <> q.sql_execution_id AND (w IS NULL OR w LIKE '%/%') THEN coalesce(r.t, w) ELSE w END AS table_written FROM p q LEFT JOIN r ON r.context = q.context AND r.sql_execution_id = q.root_execution_id""")
def settled_states(spark: SparkSession, d: str) -> DataFrame:
    """replans are no failures; children that know their table by a path take the root's name."""
    q = bound(spark, d, "queries")
    q = q.withColumn("table_written", F.when(F.col("sql_execution_id") % 4 == 3, F.concat(F.lit("s3://bucket/"), "table_written")).otherwise(F.col("table_written")))
    return D.settled_states(q, F.col("error").endswith("5-LOW")).select("context", "sql_execution_id", "status", "table_written")


# stages, tasks, executors ---------------------------------------------------------------------------------------------

#: stage_table in SQL: good attempts for data, all for cost.
STAGE_TABLE = f"""g AS (SELECT *, bool_or(NOT failed) OVER (PARTITION BY {STAGE_KEYS}) AS has_ok FROM tasks), st AS (SELECT {STAGE_KEYS}, count(*) AS tasks, count(*) FILTER (failed) AS failed_tasks, count(DISTINCT executor_id) AS executors,
  CAST(max(task_ms) FILTER (NOT failed OR NOT has_ok) AS BIGINT) AS max_task_ms, quantile_disc(task_ms, 0.5) FILTER (NOT failed OR NOT has_ok) AS p50_task_ms, quantile_disc(input_bytes + shuffle_read, 0.5) FILTER (NOT failed OR NOT has_ok) AS p50_read_bytes,
  CAST(sum(input_bytes) FILTER (NOT failed OR NOT has_ok) AS BIGINT) AS input_bytes, CAST(sum(shuffle_read) FILTER (NOT failed OR NOT has_ok) AS BIGINT) AS shuffle_read, CAST(sum(shuffle_write) FILTER (NOT failed OR NOT has_ok) AS BIGINT) AS shuffle_write,
  CAST(sum(gc_ms) AS BIGINT) AS gc_ms, CAST(sum(disk_spill) AS BIGINT) AS disk_spill, CAST(sum(task_ms) AS BIGINT) AS task_ms FROM g GROUP BY ALL)"""


def _stage_table(spark: SparkSession, d: str) -> DataFrame:
    s = bound(spark, d, "stages").select("context", "stage_id", "stage_attempt", "failure_reason", "start_time", "end_time", "start_ms", "end_ms")
    return V.stage_table(bound(spark, d, "tasks"), s)


@query(f"""WITH {cte("tasks", "stages")}, {STAGE_TABLE} SELECT st.*, s.end_ms - s.start_ms AS duration_ms, round(max_task_ms / greatest(p50_task_ms, 1), 1) AS skew, round(least(1.0, gc_ms / greatest(task_ms, 1)), 6) AS gc_share, coalesce(failure_reason LIKE '%cancelled unused%', false) AS replanned,
 failure_reason IS NOT NULL AS failed, failed_tasks > 0 AS retried, disk_spill >= 1073741824 AS spill, coalesce(round(max_task_ms / greatest(p50_task_ms, 1), 1) >= 2 AND max_task_ms >= 60000, false) AS skewed, gc_ms / greatest(task_ms, 1) >= 0.1 AND gc_ms >= 10000 AS gc,
 shuffle_read + shuffle_write >= 1073741824 AS shuffle_heavy FROM st JOIN stages s USING ({STAGE_KEYS})""")
def stage_table(spark: SparkSession, d: str) -> DataFrame:
    """A5-A7 with the flags of R8."""
    flagged = FD.stage_flags(_stage_table(spark, d), FD.Thresholds(skew_ratio=2, gc_share=0.1))
    cols = "context stage_id stage_attempt tasks failed_tasks executors max_task_ms p50_task_ms p50_read_bytes input_bytes shuffle_read shuffle_write gc_ms disk_spill task_ms duration_ms skew replanned failed retried spill skewed gc shuffle_heavy".split()
    return flagged.select(*cols, F.round("gc_share", 6).alias("gc_share"))


@query(f"""WITH {cte("tasks", "stages")}, {STAGE_TABLE}, x AS (SELECT st.*, failure_reason, end_ms - start_ms AS duration_ms, round(max_task_ms / greatest(p50_task_ms, 1), 1) AS skew FROM st JOIN stages USING ({STAGE_KEYS})),
 f AS (SELECT 'stage_failed' AS category, 0 AS severity, x.* FROM x WHERE failure_reason = 'Job aborted' UNION ALL SELECT 'task_skew', CASE WHEN max_task_ms >= 300000 THEN 0 ELSE 1 END, x.* FROM x WHERE skew >= 2 AND max_task_ms >= 60000
  UNION ALL SELECT 'disk_spill', CASE WHEN disk_spill >= 53687091200 THEN 0 ELSE 1 END, x.* FROM x WHERE disk_spill >= 1073741824 UNION ALL SELECT 'gc_pressure', CASE WHEN gc_ms >= 60000 THEN 1 ELSE 2 END, x.* FROM x WHERE gc_ms / greatest(task_ms, 1) >= 0.1 AND gc_ms >= 10000
  UNION ALL SELECT 'task_retries', 1, x.* FROM x WHERE failed_tasks > 0 AND failure_reason IS NULL UNION ALL SELECT 'large_tasks', 1, x.* FROM x WHERE p50_read_bytes >= 268435456 AND duration_ms >= 60000
  UNION ALL SELECT 'big_read', CASE WHEN input_bytes >= 107374182400 THEN 0 ELSE 1 END, x.* FROM x WHERE input_bytes >= 21474836480)
SELECT category, severity, context, stage_id, stage_attempt FROM f""")
def stage_findings(spark: SparkSession, d: str) -> DataFrame:
    """F1-F6, F12, F13."""
    found = FD.detect(_stage_table(spark, d), FD.stage_rules(FD.Thresholds(skew_ratio=2, gc_share=0.1)), F.col("stage_id").cast("string"), ["context", "stage_id", "stage_attempt"])
    return found.select("category", "severity", "context", "stage_id", "stage_attempt")


@query(f"""WITH {cte("tasks")}, {STAGE_TABLE}, em AS (SELECT context, stage_id, stage_attempt, executor_id, median(task_ms) AS m FROM tasks GROUP BY ALL), sm AS (SELECT {STAGE_KEYS}, median(task_ms) AS m FROM tasks GROUP BY ALL),
 slow AS (SELECT em.context, executor_id, median(em.m / sm.m) AS slowness FROM em JOIN sm USING ({STAGE_KEYS}) WHERE sm.m > 0 GROUP BY ALL),
 h AS (SELECT t.*, st.p50_task_ms, st.p50_read_bytes, slowness, row_number() OVER (PARTITION BY {STAGE_KEYS} ORDER BY t.task_ms DESC, task_id, t.input_bytes, t.executor_id, t.gc_ms) AS rank FROM tasks t JOIN st USING ({STAGE_KEYS}) LEFT JOIN slow USING (context, executor_id) WHERE t.task_ms >= 1.5 * greatest(p50_task_ms, 1) AND t.task_ms >= 60000)
SELECT {STAGE_KEYS}, rank, task_id, task_ms, CASE WHEN executor_id = '3' THEN 'gc_stuck' WHEN end_reason = 'ExecutorLostFailure' AND input_bytes + shuffle_read = 0 THEN 'lost' WHEN input_bytes + shuffle_read >= 1.4 * greatest(p50_read_bytes, 1) THEN 'data_skew' WHEN gc_ms >= 0.2 * task_ms THEN 'gc'
 WHEN slowness >= 1.02 THEN 'slow_executor' ELSE 'unknown' END AS cause FROM h WHERE rank <= 5""")
def skewed_tasks(spark: SparkSession, d: str) -> DataFrame:
    """W8 with its cascade of causes, A39."""
    stuck = bound(spark, d, "executors").filter("executor_id = '3'").select("context", "executor_id")
    out = V.skewed_tasks(bound(spark, d, "tasks"), _stage_table(spark, d), ratio=1.5, data_ratio=1.4, stuck=stuck, slow_ratio=1.02)
    return out.select("context", "stage_id", "stage_attempt", "rank", "task_id", "task_ms", "cause")


@query(f"""WITH {cte("tasks")}, s AS (SELECT *, input_bytes + shuffle_read AS b FROM tasks) SELECT {STAGE_KEYS}, executor_id, median(task_ms) AS median_ms, count(*) FILTER (b <= 0) AS n_0, count(*) FILTER (b > 0 AND b < 10485760) AS n_1, count(*) FILTER (b >= 10485760 AND b < 134217728) AS n_2,
 count(*) FILTER (b >= 134217728 AND b < 268435456) AS n_3, count(*) FILTER (b >= 268435456) AS n_4, CAST(sum(b) FILTER (b >= 268435456) AS BIGINT) AS bytes_4 FROM s GROUP BY ALL""")
def task_placement(spark: SparkSession, d: str) -> DataFrame:
    """V2."""
    return V.placement(bound(spark, d, "tasks")).select("context", "stage_id", "stage_attempt", "executor_id", "median_ms", *[f"n_{i}" for i in range(5)], "bytes_4")


@query(f"""WITH {cte("tasks", "executors")}, b AS (SELECT *, CASE WHEN launch_ms > max(finish_ms) OVER w + 2000 THEN 1 WHEN max(finish_ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT context, executor_id, launch_ms, finish_ms FROM tasks) WINDOW w AS (PARTITION BY context, executor_id ORDER BY launch_ms, finish_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY context, executor_id ORDER BY launch_ms, finish_ms ROWS UNBOUNDED PRECEDING) AS k FROM b), i AS (SELECT context, executor_id, max(finish_ms) - min(launch_ms) AS ms FROM n GROUP BY context, executor_id, k), busy AS (SELECT context, executor_id, CAST(sum(ms) AS BIGINT) AS busy_ms FROM i GROUP BY ALL),
 t AS (SELECT context, executor_id, count(*) AS tasks, count(*) FILTER (failed) AS failed_tasks, CAST(sum(task_ms) AS BIGINT) AS task_ms, CAST(sum(gc_ms) AS BIGINT) AS gc_ms, max(finish_ms) AS l FROM tasks GROUP BY ALL)
SELECT context, executor_id, tasks, failed_tasks, task_ms, gc_ms, busy_ms, coalesce(removed_ms, l) - added_ms AS lifetime_ms, greatest(0, (coalesce(removed_ms, l) - added_ms) * cores - task_ms) AS idle_core_ms, CAST(greatest(0, coalesce(removed_ms, l) - added_ms - busy_ms) AS BIGINT) AS idle_ms
FROM t JOIN busy USING (context, executor_id) JOIN executors USING (context, executor_id)""")
def executor_profile(spark: SparkSession, d: str) -> DataFrame:
    """A12, I9."""
    p = V.executor_profile(bound(spark, d, "tasks"), bound(spark, d, "executors").drop("added_ms", "removed_ms"))
    return p.select("context", "executor_id", "tasks", "failed_tasks", "task_ms", "gc_ms", "busy_ms", "lifetime_ms", "idle_core_ms", F.greatest(F.lit(0), F.col("lifetime_ms") - F.col("busy_ms")).alias("idle_ms"))


@query(f"""WITH {cte("tasks", "executors")}, l AS (SELECT context, max(finish_ms) AS last FROM tasks GROUP BY context), p AS (SELECT e.context, CAST(sum(greatest(0, (coalesce(removed_ms, last) - added_ms) * cores)) AS BIGINT) AS paid_core_ms FROM executors e JOIN l USING (context) GROUP BY e.context)
SELECT context, paid_core_ms, CAST(sum(task_ms) FILTER (NOT failed) AS BIGINT) AS good_task_ms, round(sum(task_ms) FILTER (NOT failed) / paid_core_ms, 9) AS use FROM tasks JOIN p USING (context) GROUP BY context, paid_core_ms""")
def core_use(spark: SparkSession, d: str) -> DataFrame:
    """A30."""
    return V.core_use(bound(spark, d, "tasks"), bound(spark, d, "executors")).withColumn("use", F.round("use", 9))


@query(f"""WITH {cte("tasks")}, c AS (SELECT context, stage_id, stage_attempt, task_index, task_ms, task_id, finish_ms, error, CASE end_reason WHEN 'FetchFailed' THEN 'fetch_failed' WHEN 'ExceptionFailure' THEN CASE WHEN {HAS_OOM} THEN 'oom' WHEN error LIKE '%jdbc%reset%' THEN 'source_db' ELSE 'exception' END
  WHEN 'TaskKilled' THEN 'killed' ELSE CASE WHEN error LIKE '%container killed%' OR error LIKE '%OutOfMemory%' THEN 'oom' ELSE 'executor_lost' END END AS category FROM tasks WHERE failed)
SELECT {STAGE_KEYS}, count(*) AS attempts, count(DISTINCT task_index) AS tasks, CAST(sum(task_ms) AS BIGINT) AS wasted_ms, count(*) FILTER (category = 'oom') AS oom, count(*) FILTER (category = 'source_db') AS source_db FROM c GROUP BY ALL""")
def retry_summary(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    r = V.retry_summary(bound(spark, d, "tasks"))
    n = lambda k: F.coalesce(F.element_at("categories", k), F.lit(0)).alias(k)
    return r.select("context", "stage_id", "stage_attempt", "attempts", "tasks", "wasted_ms", n("oom"), n("source_db"))


BUCKETS = f"""k AS (SELECT *, unnest(range(launch_ms // {DAY}, (finish_ms - 1) // {DAY} + 1)) AS bucket FROM tasks), sh AS (SELECT *, (least(finish_ms, (bucket + 1) * {DAY}) - greatest(launch_ms, bucket * {DAY})) / (finish_ms - launch_ms) AS part FROM k)"""


@query(f"""WITH {cte("tasks")}, {BUCKETS}, b AS (SELECT context, bucket, sum(task_ms * part) AS total FROM sh GROUP BY ALL), r AS (SELECT *, avg(total) OVER (PARTITION BY context) AS average, row_number() OVER (PARTITION BY context ORDER BY round(total, 3) DESC, bucket) AS rank FROM b), p AS (SELECT * FROM r WHERE rank <= 3),
 s AS (SELECT context, bucket, stage_id, sum(task_ms * part) AS v FROM sh JOIN p USING (context, bucket) GROUP BY ALL), e AS (SELECT context, bucket, executor_id, sum(task_ms * part) AS v FROM sh JOIN p USING (context, bucket) GROUP BY ALL)
SELECT context, bucket, rank, round(total, 3) AS total, round(average, 3) AS average, (SELECT max_by(stage_id, (round(v, 3), stage_id)) FROM s WHERE s.context = p.context AND s.bucket = p.bucket) AS top_stage_id, round((SELECT max(v) FROM s WHERE s.context = p.context AND s.bucket = p.bucket) / total, 6) AS stage_id_share,
 round((SELECT max(v) FROM e WHERE e.context = p.context AND e.bucket = p.bucket) / total, 6) AS executor_id_share FROM p""")
def peak_buckets(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    t = bound(spark, d, "tasks")
    p = V.peak_buckets(t, "task_ms", DAY, 3)
    out = RV.stage_shares(t, p, DAY)
    return out.select("context", "bucket", "rank", F.round("total", 3).alias("total"), F.round("average", 3).alias("average"), "top_stage_id", F.round("stage_id_share", 6).alias("stage_id_share"), F.round("executor_id_share", 6).alias("executor_id_share"))


WAIT_RUN = """wr AS (SELECT {k}, t, sum(w) AS w, sum(r) AS r FROM (SELECT {k}, s AS t, 1 AS w, 0 AS r FROM wait WHERE e > s UNION ALL SELECT {k}, e, -1, 0 FROM wait WHERE e > s UNION ALL SELECT {k}, s, 0, 1 FROM run WHERE e > s UNION ALL SELECT {k}, e, 0, -1 FROM run WHERE e > s) GROUP BY ALL),
 wl AS (SELECT {k}, lead(t) OVER v - t AS dt, sum(w) OVER v AS w, sum(r) OVER v AS r FROM wr WINDOW v AS (PARTITION BY {k} ORDER BY t))"""


@query(f"""WITH {cte("stages")}, wait AS (SELECT context, start_ms AS s, first_ms AS e FROM stages), run AS (SELECT context, first_ms AS s, first_ms + 3600000 AS e FROM stages), {WAIT_RUN.format(k="context")}
SELECT context, CAST(coalesce(sum(dt) FILTER (w > 0 AND r = 0), 0) AS BIGINT) AS wait_ms, CAST(coalesce(sum(dt) FILTER (r > 0), 0) AS BIGINT) AS run_ms FROM wl GROUP BY context""")
def stage_waits(spark: SparkSession, d: str) -> DataFrame:
    """I5 over a cluster's clock: time with a stage submitted and none running, and time with one running."""
    s = bound(spark, d, "stages").withColumn("end_time", F.timestamp_millis(F.col("first_ms") + HOUR))
    return V.waiting(s, ["context"])


@query(f"""WITH {cte("tasks")} SELECT {STAGE_KEYS}, min(launch_ms) AS first_launch, max(finish_ms) AS last_finish, quantile_disc(finish_ms, 0.9) AS p90_finish, max(finish_ms) - quantile_disc(finish_ms, 0.9) AS tail_ms FROM tasks GROUP BY ALL""")
def stage_times(spark: SparkSession, d: str) -> DataFrame:
    """I15."""
    return V.stage_times(bound(spark, d, "tasks"))


@query(f"""WITH {cte("tasks", "executors")}, {BUCKETS.replace(str(DAY), str(7 * DAY))}, b AS (SELECT context, bucket, count(*) FILTER (bucket = (finish_ms - 1) // {7 * DAY}) AS tasks, sum(task_ms * part) AS total, sum(CASE WHEN failed THEN task_ms ELSE 0 END * part) AS f, sum(CASE WHEN failed THEN 0 ELSE cpu_ms END * part) AS c, sum(CASE WHEN failed THEN 0 ELSE gc_ms END * part) AS g, sum(CASE WHEN failed THEN 0 ELSE fetch_wait_ms END * part) AS w FROM sh GROUP BY ALL),
 z AS (SELECT context, max(finish_ms) AS end_ms FROM tasks GROUP BY context), u AS (SELECT e.context, added_ms AS s, coalesce(removed_ms, end_ms) AS e, cores FROM executors e JOIN z USING (context) WHERE coalesce(removed_ms, end_ms) > added_ms), ub AS (SELECT *, unnest(range(s // {7 * DAY}, (e - 1) // {7 * DAY} + 1)) AS bucket FROM u),
 p AS (SELECT context, bucket, sum(cores * (least(e, (bucket + 1) * {7 * DAY}) - greatest(s, bucket * {7 * DAY}))) AS core_ms FROM ub GROUP BY ALL)
SELECT context, bucket, tasks, round(total, 3) AS total, round(f, 3) AS failed, round(least(c, total - f), 3) AS cpu, round(least(g, total - f - least(c, total - f)), 3) AS gc, round(CAST(core_ms AS DOUBLE), 1) AS core_ms, round(total / core_ms, 6) AS use FROM b LEFT JOIN p USING (context, bucket)""")
def cluster_minutes(spark: SparkSession, d: str) -> DataFrame:
    """V11, A17, in buckets of a week."""
    t = bound(spark, d, "tasks")
    out = RV.cluster_minutes(t, bound(spark, d, "executors"), t.groupBy("context").agg(F.max("finish_ms").alias("end_ms")), 7 * DAY)
    return out.select("context", "bucket", "tasks", *[F.round(c, 3).alias(c) for c in ("total", "failed", "cpu", "gc")], F.round("core_ms", 1).alias("core_ms"), F.round("use", 6).alias("use"))


# queries, runs, tables ------------------------------------------------------------------------------------------------


@query(f"""WITH {cte("queries", "stages")}, sq AS (SELECT context, stage_id * 7 % 1000 AS sql_execution_id, stage_attempt, first_ms AS start_ms, first_ms + 600000 AS first_ms, first_ms + 3600000 * 200 AS end_ms FROM stages), root AS (SELECT context, root_execution_id AS root, sql_execution_id FROM queries),
 span AS (SELECT context, sql_execution_id AS root, start_ms - {900 * DAY} AS q0, end_ms + {900 * DAY} AS q1 FROM queries WHERE sql_execution_id = root_execution_id), x AS (SELECT r.context, r.root, q0, q1, sq.start_ms, sq.first_ms, sq.end_ms FROM sq JOIN root r USING (context, sql_execution_id) JOIN span s ON s.context = r.context AND s.root = r.root),
 wait AS (SELECT context, root, greatest(start_ms, q0) AS s, least(first_ms, q1) AS e FROM x), run AS (SELECT context, root, greatest(first_ms, q0) AS s, least(end_ms, q1) AS e FROM x), {WAIT_RUN.format(k="context, root")},
 t AS (SELECT context, root, sum(dt) FILTER (w > 0 AND r = 0) AS waiting, sum(dt) FILTER (r > 0) AS running FROM wl GROUP BY ALL)
SELECT context, root, q1 - q0 AS total_ms, CAST(coalesce(waiting, 0) AS BIGINT) AS waiting_ms, CAST(coalesce(running, 0) AS BIGINT) AS running_ms, CAST(greatest(0, q1 - q0 - coalesce(running, 0) - coalesce(waiting, 0)) AS BIGINT) AS outside_ms FROM span LEFT JOIN t USING (context, root)""")
def query_time(spark: SparkSession, d: str) -> DataFrame:
    """V3, I2, I3."""
    q = bound(spark, d, "queries").withColumns({"start_ms": F.col("start_ms") - 900 * DAY, "end_ms": F.col("end_ms") + 900 * DAY})
    s = bound(spark, d, "stages").select("context", (F.col("stage_id") * 7 % 1000).alias("sql_execution_id"), F.col("first_ms").alias("start_ms"), (F.col("first_ms") + 10 * MINUTE).alias("first_ms"), (F.col("first_ms") + 200 * HOUR).alias("end_ms"))
    return RV.query_time(q, s)


@query(f"""WITH {cte("queries")}, m AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER w THEN 1 WHEN max(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM queries WINDOW w AS (PARTITION BY run_key ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY run_key ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM m), i AS (SELECT run_key, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM n GROUP BY run_key, k)
SELECT run_key, start_ms, end_ms, n, row_number() OVER w AS step, CASE WHEN start_ms - lag(end_ms) OVER w >= 60000 THEN start_ms - lag(end_ms) OVER w END AS pause_ms FROM i WINDOW w AS (PARTITION BY run_key ORDER BY start_ms)""")
def run_steps(spark: SparkSession, d: str) -> DataFrame:
    """V6, I13."""
    return RV.run_steps(bound(spark, d, "queries").select("run_key", "start_ms", "end_ms"), "run_key")


@query(f"""WITH {cte("runs", "queries")}, q AS (SELECT concat('run-', sql_execution_id) AS run_key, input_bytes, duration_ms, sql_execution_id FROM queries)
SELECT run_key, status, wait_ms, CAST(input_bytes AS BIGINT) AS read_bytes, duration_ms AS biggest_ms, sql_execution_id AS biggest_task FROM runs LEFT JOIN q USING (run_key)""")
def runs_list(spark: SparkSession, d: str) -> DataFrame:
    """V14."""
    r, q = bound(spark, d, "runs"), bound(spark, d, "queries").withColumn("run_key", F.concat(F.lit("run-"), "sql_execution_id"))
    out = RV.runs_list(r.select("run_key", "status"), r, q.select("run_key", F.col("input_bytes").alias("bytes")), q.select("run_key", F.col("sql_execution_id").alias("task_id"), F.col("duration_ms").alias("task_ms")), "run_key")
    return out.select("run_key", "status", F.col("waited_ms").alias("wait_ms"), "read_bytes", "biggest_ms", "biggest_task")


@query(f"""WITH {cte("tasks", "stages", "queries", "executors")}, sq AS (SELECT DISTINCT context, stage_id * 7 % 1000 AS q, stage_id FROM stages), n AS (SELECT context, q, count(*) AS stages FROM sq GROUP BY ALL), u AS (SELECT DISTINCT sq.context, q, executor_id FROM tasks JOIN sq USING (context, stage_id)), un AS (SELECT context, q, count(*) AS executors FROM u GROUP BY ALL),
 l AS (SELECT u.context, u.q, count(*) AS lost FROM u JOIN executors e USING (context, executor_id) JOIN queries x ON x.context = u.context AND x.sql_execution_id = u.q WHERE removal_category IN ('oom', 'lost', 'killed') AND removed_ms BETWEEN x.start_ms - {900 * DAY} AND x.end_ms GROUP BY ALL)
SELECT q.context, sql_execution_id, coalesce(stages, 0) AS stages, coalesce(executors, 0) AS executors, coalesce(lost, 0) AS lost, CASE WHEN q.error IS NULL THEN 0 ELSE 1 END AS findings, CASE WHEN q.error IS NOT NULL THEN 0 END AS worst
FROM queries q LEFT JOIN n ON n.context = q.context AND n.q = sql_execution_id LEFT JOIN un ON un.context = q.context AND un.q = sql_execution_id LEFT JOIN l ON l.context = q.context AND l.q = sql_execution_id""")
def query_profile(spark: SparkSession, d: str) -> DataFrame:
    """A10, F8."""
    q = bound(spark, d, "queries").withColumn("start_ms", F.col("start_ms") - 900 * DAY)
    s = bound(spark, d, "stages").withColumn("sql_execution_id", F.col("stage_id") * 7 % 1000)
    found = FD.detect(q, FD.query_rules(FD.Thresholds())[:1], F.col("sql_execution_id").cast("string"), ["context", "sql_execution_id"])
    return RV.query_profile(q, s, bound(spark, d, "tasks"), bound(spark, d, "executors"), found)


@query("""WITH s AS (SELECT concat('t', l_partkey % 30) AS tbl, concat('run-', l_orderkey % 50) AS run_key, l_orderkey AS q, CASE WHEN l_partkey % 30 < 5 THEN 's1' END AS stream, CASE WHEN l_partkey % 30 < 5 THEN l_orderkey % 12 END AS batch, CAST(l_quantity AS BIGINT) AS fr, CAST(l_linenumber AS BIGINT) AS fp,
  CAST(round(l_extendedprice) AS BIGINT) AS br, CAST(round(l_extendedprice * l_discount) AS BIGINT) AS bp, CAST(l_partkey AS BIGINT) AS mn, CAST(l_partkey * 3 AS BIGINT) AS mx, CAST(round(l_extendedprice) AS BIGINT) * 5 AS rows FROM lineitem),
 b AS (SELECT tbl, stream, batch, max(br + bp) AS size, max(fr + fp) AS n FROM s WHERE stream IS NOT NULL GROUP BY ALL), bb AS (SELECT tbl, count(*) AS batches, CAST(sum(size) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY tbl)
SELECT tbl AS "table", count(*) AS scans, count(DISTINCT run_key) AS runs, coalesce(CASE WHEN bb.batches > 1 THEN bb.size END, max(br + bp)) AS size, coalesce(CASE WHEN bb.batches > 1 THEN bb.n END, max_by(fr + fp, (br + bp, fr + fp))) AS files, CAST(sum(fr) AS BIGINT) AS files_read, CAST(sum(fp) AS BIGINT) AS files_pruned,
 min(nullif(mn, 0)) AS min_file, max(mx) AS max_file, CASE WHEN bb.batches > 1 THEN bb.batches END AS batches FROM s LEFT JOIN bb USING (tbl) GROUP BY tbl, bb.batches, bb.size, bb.n""")
def table_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    li = read(spark, d, "lineitem")
    k, streamed = F.col("l_partkey") % 30, F.col("l_partkey") % 30 < 5
    price = F.round("l_extendedprice").cast("long")
    s = li.select(
        F.concat(F.lit("t"), k).alias("table"), F.concat(F.lit("run-"), F.col("l_orderkey") % 50).alias("run_key"), F.col("l_orderkey").alias("query"), F.when(streamed, "s1").alias("stream"), F.when(streamed, F.col("l_orderkey") % 12).alias("batch"),
        F.col("l_quantity").cast("long").alias("files_read"), F.col("l_linenumber").cast("long").alias("files_pruned"), price.alias("bytes_read"), F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long").alias("bytes_pruned"),
        F.col("l_partkey").alias("min_file"), (F.col("l_partkey") * 3).alias("max_file"), (price * 5).alias("rows"),
    )
    return TV.table_stats(s).drop("rows_per_file")


@query("""WITH r AS (SELECT concat('jdbc:db://h', o_custkey % 12, '?user=...&password=...&t=', o_orderpriority) AS source, CAST(round(o_totalprice) AS BIGINT) AS rows, o_custkey, o_orderkey FROM orders)
SELECT source, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS queries, count(DISTINCT o_custkey) AS runs, max(o_orderkey % 16) AS partitions, CAST(sum(rows) * 3 AS BIGINT) AS ms, max(rows) AS max_task_rows, max_by(rows // 2, (rows, rows // 2)) AS p50_task_rows FROM r GROUP BY source""")
def jdbc_reads(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    o, rows = read(spark, d, "orders"), F.round("o_totalprice").cast("long")
    address = F.concat(F.lit("jdbc:db://h"), F.col("o_custkey") % 12, F.lit("?user=u"), "o_orderkey", F.lit("&password=p"), "o_custkey", F.lit("&t="), "o_orderpriority")
    return TV.jdbc_reads(o.select(address.alias("address"), F.col("o_custkey").alias("run_key"), rows.alias("rows"), (F.col("o_orderkey") % 16).alias("partitions"), (rows * 3).alias("ms"), rows.alias("max_task_rows"), F.floor(rows / 2).alias("p50_task_rows")))


@query("""SELECT o_orderkey AS sql_execution_id, row_number() OVER w - 1 AS repeat, first_value(o_orderkey) OVER w AS first_query FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def jdbc_steps(spark: SparkSession, d: str) -> DataFrame:
    """Reads of one source by one statement, in order."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("sql_execution_id"), F.concat_ws("|", "o_custkey", "o_orderpriority").alias("k"), "o_orderdate")
    return TV.jdbc_steps(o, "k", ["o_orderdate", "sql_execution_id"]).select("sql_execution_id", "repeat", "first_query")


@query(f"""WITH {cte("tasks", "queries")}, s AS (SELECT context, stage_id * 7 % 1000 AS q, CAST(sum(input_bytes) FILTER (NOT failed) AS BIGINT) AS st, CAST(sum(input_bytes) FILTER (NOT failed AND executor_id = '3') AS BIGINT) AS df, CAST(sum(shuffle_read) FILTER (NOT failed AND stage_id % 2 = 0) AS BIGINT) AS hit FROM tasks GROUP BY ALL),
 m AS (SELECT context, sql_execution_id AS q, input_bytes AS n FROM queries WHERE sql_execution_id < 500) SELECT coalesce(s.context, m.context) AS context, coalesce(s.q, m.q) AS sql_execution_id, st AS storage_read, df AS cache_read, coalesce(hit, n) AS hit, n AS miss, CASE WHEN n IS NOT NULL THEN n * 2 END AS written
FROM s FULL JOIN m ON s.context = m.context AND s.q = m.q""")
def read_split(spark: SparkSession, d: str) -> DataFrame:
    """A29."""
    t = bound(spark, d, "tasks").select("context", (F.col("stage_id") * 7 % 1000).alias("sql_execution_id"), F.col("input_bytes").alias("storage_bytes"), F.when(F.col("executor_id") == "3", F.col("input_bytes")).alias("df_cache_bytes"), F.when(F.col("stage_id") % 2 == 0, F.col("shuffle_read")).alias("disk_cache_bytes"), "failed")
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for n, k in (("cache hits size", 1), ("cache misses size", 1), ("cache writes size", 2))]))
    q = bound(spark, d, "queries").filter("sql_execution_id < 500").select("context", "sql_execution_id", "input_bytes", names.alias("x")).select("context", "sql_execution_id", "x.name", (F.col("input_bytes") * F.col("x.k")).alias("total"))
    return TV.read_split(t, q)


@query(f"""WITH {cte("queries")}, m AS (SELECT *, CASE WHEN description LIKE 'MERGE: materialize%' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM queries WHERE description LIKE 'MERGE%' WINDOW w AS (PARTITION BY context ORDER BY sql_execution_id)),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY context ORDER BY sql_execution_id) AS cycle FROM m)
SELECT context, CAST(cycle AS BIGINT) AS cycle, count(*) AS steps, min(sql_execution_id) AS first_step, max(sql_execution_id) AS last_step, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(input_bytes) FILTER (description LIKE 'MERGE: mat%') AS BIGINT) AS source_copy_bytes, count(*) FILTER (description NOT LIKE 'MERGE: mat%' AND input_bytes > 0) AS target_scans FROM c GROUP BY ALL""")
def merge_cycles(spark: SparkSession, d: str) -> DataFrame:
    """R4."""
    return TV.merge_cycles(bound(spark, d, "queries"), ["context"], ["sql_execution_id"])


MERGE_FACTS = """s AS (SELECT q.context, sql_execution_id, description, CASE WHEN o_key % 2 = 0 THEN b ELSE b // 2 END AS hit, b FROM (SELECT *, sql_execution_id AS o_key, input_records AS b FROM queries) q WHERE description LIKE 'MERGE: rewriting%')"""


@query(f"""WITH {cte("queries")}, {MERGE_FACTS}, f AS (SELECT *, CASE WHEN sql_execution_id % 9 = 0 THEN b + hit ELSE b END AS output, CAST(regexp_extract(description, 'rewriting (\\d+) files', 1) AS BIGINT) AS files FROM s)
SELECT context, sql_execution_id, b * 10 AS target_bytes, b AS target_rows, b * 2 AS copy_bytes, b AS copy_rows, files AS files_touched, b AS source_rows, CASE WHEN output = b THEN hit END AS updated, CASE WHEN output = b THEN b - hit END AS inserted FROM f""")
def merge_facts(spark: SparkSession, d: str) -> DataFrame:
    """R3."""
    q = bound(spark, d, "queries").withColumn("hit", F.when(F.col("sql_execution_id") % 2 == 0, F.col("input_records")).otherwise(F.floor(F.col("input_records") / 2)))
    q = q.withColumn("output_records", F.when(F.col("sql_execution_id") % 9 == 0, F.col("input_records") + F.col("hit")).otherwise(F.col("input_records"))).withColumns({"dv_on": F.lit(True), "cdf_on": F.lit(False)})
    of = lambda kind, k, hit: q.select("context", "sql_execution_id", F.lit(kind).alias("kind"), F.lit(False).alias("failed"), (F.col("input_records") * k).alias("input_bytes"), "input_records", hit.alias("shuffle_write_records"))
    return TV.merge_facts(q, of("target", 10, F.col("hit")).unionByName(of("copy", 2, F.lit(0).cast("long"))))


@query(f"""WITH {cte("queries")} SELECT 'merge_rewrite' AS category, CAST(sql_execution_id AS VARCHAR) AS entity, 1 AS severity, context FROM queries WHERE description LIKE 'MERGE: rewriting%' AND input_records * 1000 >= 10737418240 AND input_records * 1000 >= 5 * (input_records * (sql_execution_id % 5) * 60)
 UNION ALL SELECT 'query_failed', CAST(sql_execution_id AS VARCHAR), 0, context FROM queries WHERE error IS NOT NULL AND description LIKE 'MERGE: rewriting%'""")
def merge_findings(spark: SparkSession, d: str) -> DataFrame:
    """F22, F8."""
    q = bound(spark, d, "queries").filter("description LIKE 'MERGE: rewriting%'").withColumns({"target_read": F.col("input_records") * 1000, "source_read": F.col("input_records") * (F.col("sql_execution_id") % 5) * 60})
    rules = [r for r in FD.query_rules(FD.Thresholds()) if r.category in ("merge_rewrite", "query_failed")]
    return FD.detect(q, rules, F.col("sql_execution_id").cast("string"), ["context"]).select("category", "entity", "severity", "context")


def _window_plan(wide: F.Column, ranked: F.Column) -> F.Column:
    """A plan with a ranking window on a, or on a and c, by the time of change; the first is kept, by a group limit or by a filter."""
    name = F.when(ranked, "rank(coalesce(ts#3, d#5))").otherwise("row_number()")
    keys = F.when(wide, "a#1, c#2L").otherwise("a#1")
    window = F.concat(F.lit("+- Window ["), name, F.lit(" windowspecdefinition("), keys, F.lit(", coalesce(ts#3, d#5) DESC NULLS LAST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS rn#9], ["), keys, F.lit("], [coalesce(ts#3, d#5) DESC NULLS LAST]"))
    limit = F.concat(F.lit("\n   +- WindowGroupLimit ["), keys, F.lit("], [coalesce(ts#3, d#5) DESC NULLS LAST], "), name, F.lit(", 1, Final"))
    return F.concat(F.when(wide, "Filter (rn#9 < 2)\n").otherwise("Project [a#1]\n"), window, F.when(wide, "").otherwise(limit), F.lit("\n      +- Scan t"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN 'rank' ELSE 'row_number' END AS function, CASE WHEN o_custkey % 3 = 1 THEN 'a;c' ELSE 'a' END AS partition_keys, 'coalesce(ts, d) DESC NULLS LAST' AS order_keys, 1 AS "limit", o_custkey % 3 = 2 AS keeps_ties FROM orders""")
def window_dedups(spark: SparkSession, d: str) -> DataFrame:
    """The window that keeps one row a key, from plan text with brackets in brackets."""
    k = F.col("o_custkey") % 3
    w = read(spark, d, "orders").select("o_orderkey", P.dedup_window(_window_plan(k == 1, k == 2)).alias("w"))
    return w.select("o_orderkey", "w.function", F.array_join("w.partition_keys", ";").alias("partition_keys"), F.array_join("w.order_keys", ";").alias("order_keys"), "w.limit", "w.keeps_ties")


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 4 AS k FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, CASE k WHEN 0 THEN 'not deduplicated' WHEN 1 THEN 'deduplicated on more keys than the MERGE joins' WHEN 2 THEN 'ties kept' ELSE 'unclear' END AS cause, CASE WHEN k = 1 THEN 'c' WHEN k > 1 THEN '' END AS extra FROM f""")
def duplicate_causes(spark: SparkSession, d: str) -> DataFrame:
    """R5."""
    f = read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_custkey") % 4).alias("k"))
    failed = f.select("o_orderkey", F.col("o_orderkey").alias("batch"), F.array(F.lit("a"), F.lit("b")).alias("merge_keys"))
    one = P.dedup_window(_window_plan(F.col("k") == 1, F.col("k") == 2))
    dedups = f.filter("k > 0").select(F.col("o_orderkey").alias("batch"), one.alias("w")).select("batch", "w.partition_keys", "w.keeps_ties")
    out = TV.duplicate_causes(failed, dedups, ["batch"])
    return out.select("o_orderkey", "cause", F.array_join("extra_keys", ",").alias("extra"))


@query(f"""WITH {cte("queries")}, f AS (SELECT run_key, tables_read AS tbl, 'read' AS how, input_bytes AS b, start_ms, end_ms FROM queries UNION ALL SELECT run_key, table_written, 'write', 0, start_ms, end_ms FROM queries WHERE table_written IS NOT NULL),
 p AS (SELECT run_key, tbl, count(*) FILTER (how = 'read') AS reads, count(*) FILTER (how = 'write') AS writes, CAST(sum(b) FILTER (how = 'read') AS BIGINT) AS bytes, min(start_ms) FILTER (how = 'read') AS s FROM f GROUP BY ALL), w AS (SELECT tbl, end_ms, max(run_key) AS run_key FROM f WHERE how = 'write' GROUP BY ALL),
 a AS (SELECT p.run_key, p.tbl, w.run_key AS src FROM p ASOF JOIN w ON p.tbl = w.tbl AND p.s >= w.end_ms WHERE p.s IS NOT NULL)
SELECT p.run_key, p.tbl AS "table", reads, writes, bytes, CASE WHEN src <> p.run_key THEN src END AS fed_by FROM p LEFT JOIN a ON a.run_key = p.run_key AND a.tbl = p.tbl""")
def run_tables(spark: SparkSession, d: str) -> DataFrame:
    """V9, J11."""
    q = bound(spark, d, "queries")
    r = q.select("run_key", "sql_execution_id", F.col("tables_read").alias("table"), F.lit("read").alias("how"), F.col("input_bytes").alias("bytes"), "start_ms", "end_ms")
    w = q.filter("table_written IS NOT NULL").select("run_key", "sql_execution_id", F.col("table_written").alias("table"), F.lit("write").alias("how"), F.lit(0).alias("bytes"), "start_ms", "end_ms")
    return TV.run_tables(r.unionByName(w))


@query("""WITH l AS (SELECT concat('id', l_suppkey % 40) AS id, concat('tbl', (l_suppkey * 7 + l_linenumber) % 45) AS name FROM lineitem), n AS (SELECT id, name, count(*) AS k FROM l GROUP BY ALL), b AS (SELECT id, max_by(name, (k, name)) AS name FROM n GROUP BY id)
SELECT o_orderkey, concat_ws(',', coalesce(b.name, concat('/mnt/id', o_custkey % 60)), 'plain', coalesce(c.name, concat('/mnt/id', o_orderkey % 60))) AS tables FROM orders LEFT JOIN b ON b.id = concat('id', o_custkey % 60) LEFT JOIN b c ON c.id = concat('id', o_orderkey % 60)""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    """Names learnt from all plans, put in place of paths."""
    li = read(spark, d, "lineitem").select(F.concat(F.lit("id"), F.col("l_suppkey") % 40).alias("table_id"), F.concat(F.lit("tbl"), (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 45).alias("name"))
    path = lambda c: F.concat(F.lit("/mnt/id"), F.col(c) % 60)
    o = read(spark, d, "orders").select("o_orderkey", F.array(path("o_custkey"), F.lit("plain"), path("o_orderkey")).alias("tables"))
    return TV.with_names(o, ["o_orderkey"], "tables", TV.learnt_names(li), r"/(id\d+)$").withColumn("tables", F.array_join("tables", ","))


@query(f"""WITH {cte("runs", "queries", "executors", "lines")}, q AS (SELECT concat('run-', sql_execution_id - sql_execution_id % 3) AS run_key, count(*) FILTER (status = 'failed') AS fq, count(*) FILTER (status = 'open') AS oq, max_by(sql_execution_id, (end_ms, sql_execution_id)) FILTER (status <> 'open') AS last_query FROM queries GROUP BY ALL),
 er AS (SELECT context, exception AS fp, ts_ms - {28 * 365 * DAY} AS t FROM lines WHERE exception IS NOT NULL), h AS (SELECT DISTINCT r.run_key, program, fp FROM runs r JOIN er ON er.context = r.context AND t BETWEEN end_ms - {DAY} AND end_ms + {HOUR}), c AS (SELECT program, fp, count(DISTINCT run_key) AS runs_with FROM h GROUP BY ALL),
 e AS (SELECT run_key, count(*) AS error_kinds, max(runs_with) AS runs_with FROM h JOIN c USING (program, fp) GROUP BY run_key), g AS (SELECT r.run_key, count(*) AS gone, count(*) FILTER (removal_category IN ('oom', 'lost', 'killed')) AS lost FROM runs r JOIN executors x ON x.context = r.context AND removed_ms BETWEEN r.start_ms AND r.end_ms GROUP BY r.run_key),
 a AS (SELECT context, max(end_ms) AS app_end FROM runs GROUP BY context)
SELECT run_key, CASE WHEN coalesce(fq, 0) > 0 THEN 'failed' WHEN coalesce(oq, 0) > 0 THEN 'cut off' ELSE 'succeeded' END AS outcome, coalesce(fq, 0) AS failed_queries, coalesce(oq, 0) AS open_queries, last_query, coalesce(error_kinds, 0) AS error_kinds, runs_with, coalesce(gone, 0) AS executors_gone, coalesce(lost, 0) AS executors_lost,
 coalesce(app_end - end_ms BETWEEN 0 AND {30 * DAY}, false) AS cluster_stopped FROM runs LEFT JOIN q USING (run_key) LEFT JOIN e USING (run_key) LEFT JOIN g USING (run_key) LEFT JOIN a USING (context)""")
def run_end(spark: SparkSession, d: str) -> DataFrame:
    """R7; the log lines' times are moved into the runs' years."""
    r = bound(spark, d, "runs")
    q = bound(spark, d, "queries").withColumn("run_key", F.concat(F.lit("run-"), F.col("sql_execution_id") - F.col("sql_execution_id") % 3))
    errors = bound(spark, d, "lines").filter("exception IS NOT NULL").select("context", F.col("exception").alias("fingerprint"), (F.col("ts_ms") - 28 * 365 * DAY).alias("ts_ms"))
    return RV.run_end(r, q, bound(spark, d, "executors"), errors, r.groupBy("context").agg(F.max("end_ms").alias("end_ms")), DAY, HOUR, 30 * DAY, DAY)


@query(f"""WITH {cte("runs")}, f AS (SELECT concat('run-', l_orderkey) AS run_key, l_orderkey * 8 + l_linenumber AS id, l_returnflag AS category, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS severity, epoch_us(l_shipdate) // 1000 AS t, l_partkey, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
 w AS (SELECT run_key, min_by(id, (severity, t, id)) AS top, count(*) AS findings, count(*) FILTER (severity = 0) AS high, count(*) FILTER (category = 'R') AS retries, CAST(coalesce(sum(w) FILTER (category = 'R'), 0) AS BIGINT) AS wasted, min_by(concat('error ', l_partkey), (t, concat('error ', l_partkey))) FILTER (category <> 'N') AS first_error FROM f GROUP BY run_key),
 k AS (SELECT run_key, category, min(severity) AS s, count(*) AS n FROM f GROUP BY ALL), n AS (SELECT run_key, string_agg(category, ', ' ORDER BY s, n DESC, category) AS nxt FROM k GROUP BY run_key)
SELECT run_key, status AS outcome, first_error, CASE WHEN top % 4 = 0 THEN top + 1 ELSE top END AS root, coalesce(top % 4 = 0, false) AS by_cause, coalesce(findings, 0) AS findings, coalesce(high, 0) AS high, coalesce(retries, 0) AS retries, coalesce(wasted, 0) AS wasted, nxt AS "next" FROM runs LEFT JOIN w USING (run_key) LEFT JOIN n USING (run_key)""")
def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """R6, with a cause for every fourth finding."""
    li = read(spark, d, "lineitem").withColumns({"run_key": F.concat(F.lit("run-"), "l_orderkey"), "id": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "ts_ms": millis("l_shipdate")})
    found = li.select("run_key", "id", F.col("l_returnflag").alias("category"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("severity"), "ts_ms")
    causes = found.filter("id % 4 = 0").select(F.col("id").alias("effect"), (F.col("id") + 1).alias("root")).distinct()
    errors = li.filter("l_returnflag <> 'N'").select("run_key", "ts_ms", F.concat(F.lit("error "), "l_partkey").alias("text"))
    return RV.diagnosis(bound(spark, d, "runs"), found, causes, errors, li.filter("l_returnflag = 'R'").select("run_key", F.col("l_quantity").cast("long").alias("wasted")))


@query(f"""WITH {cte("tasks", "stages")}, {STAGE_TABLE}, x AS (SELECT st.*, end_ms - start_ms AS d, round(max_task_ms / greatest(p50_task_ms, 1), 1) AS skew FROM st JOIN stages USING ({STAGE_KEYS})), h AS (
  SELECT context, 'spark.sql.shuffle.partitions' AS setting, 'fewer partitions' AS advice, d AS cost FROM x WHERE shuffle_read > 0 AND shuffle_read / tasks < 45000000 UNION ALL SELECT context, 'spark.sql.shuffle.partitions', 'more partitions', d FROM x WHERE shuffle_read / tasks > 50000000
  UNION ALL SELECT context, 'spark.sql.files.maxPartitionBytes', 'smaller input splits', d FROM x WHERE disk_spill > 0 UNION ALL SELECT context, 'spark.sql.adaptive.skewJoin.enabled', 'on, with a lower factor', max_task_ms - p50_task_ms FROM x WHERE skew >= 10
  UNION ALL SELECT context, 'spark.memory.fraction', 'less cached, or more memory a core', gc_ms FROM x WHERE gc_ms >= 0.2 * task_ms UNION ALL SELECT context, 'spark.speculation', 'look at the hosts that fail first', d FROM x WHERE failed_tasks > 0),
 s AS (SELECT context, setting, advice, CAST(sum(cost) AS BIGINT) AS cost_ms, count(*) AS stages FROM h GROUP BY ALL)
SELECT *, CASE WHEN setting = 'spark.speculation' THEN 'false' END AS current, row_number() OVER (PARTITION BY context ORDER BY cost_ms DESC, setting, advice) AS rank FROM s""")
def settings_advice(spark: SparkSession, d: str) -> DataFrame:
    """R2: rules over stages, by cost."""
    now = bound(spark, d, "stages").select("context").distinct().select("context", F.lit("spark.speculation").alias("setting"), F.lit("false").alias("value"))
    return RV.settings_advice(_stage_table(spark, d), now, 45_000_000, 50_000_000)


@query(f"""WITH {cte("tasks", "stages", "lines", "queries")} SELECT 'levels' AS step, level AS "value", count(*) AS n FROM lines GROUP BY ALL UNION ALL SELECT 'sources', source, count(*) FROM lines GROUP BY ALL UNION ALL SELECT 'signals', signal, count(*) FROM lines WHERE signal IS NOT NULL GROUP BY ALL UNION ALL SELECT 'exceptions', exception, count(*) FROM lines WHERE exception IS NOT NULL GROUP BY ALL
 UNION ALL SELECT * FROM (SELECT 'first_errors', line, 1 FROM lines WHERE level = 'ERROR' ORDER BY ts_ms, event_id LIMIT 50) UNION ALL SELECT 'end_reasons', end_reason, count(*) FROM tasks GROUP BY ALL UNION ALL SELECT 'failed_by_executor', executor_id, count(*) FROM tasks WHERE failed GROUP BY ALL UNION ALL SELECT 'failed_by_host', host, count(*) FROM tasks WHERE failed GROUP BY ALL
 UNION ALL SELECT 'stage_attempts', CAST(stage_attempt AS VARCHAR), count(*) FROM stages GROUP BY ALL UNION ALL SELECT 'failure_reasons', failure_reason, count(*) FROM stages WHERE failure_reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'query_status', status, count(*) FROM queries GROUP BY ALL UNION ALL SELECT 'tables_written', table_written, count(*) FROM queries WHERE table_written IS NOT NULL GROUP BY ALL""")
def debug_steps(spark: SparkSession, d: str) -> DataFrame:
    """A32."""
    out = None
    for name, df in RV.debug_steps(*(bound(spark, d, n) for n in ("lines", "tasks", "stages", "queries"))).items():
        one = df.select(F.lit(name).alias("step"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {cte("stages", "queries", "executors", "tasks")}, t AS (SELECT context, task_id AS id, launch_ms AS s, finish_ms AS e, failed, row_number() OVER (PARTITION BY context ORDER BY launch_ms, task_id, finish_ms, failed) - 1 AS k FROM tasks)
SELECT kind, context, count(*) AS n, CAST(sum(s % 1000003) AS BIGINT) AS starts, CAST(sum(e % 1000003) AS BIGINT) AS ends FROM (SELECT 'job' AS kind, context, start_ms AS s, end_ms AS e FROM queries UNION ALL SELECT 'stage', context, start_ms, end_ms FROM stages UNION ALL SELECT 'executor', context, added_ms, removed_ms FROM executors
 UNION ALL SELECT 'task', context, s, e FROM t WHERE k % 20 = 0 OR failed UNION ALL SELECT 'removed', context, removed_ms, removed_ms FROM executors WHERE removed_ms IS NOT NULL UNION ALL SELECT 'task_failed', context, finish_ms, finish_ms FROM tasks WHERE failed) GROUP BY ALL""")
def gantt(spark: SparkSession, d: str) -> DataFrame:
    """V5, W12, summed by kind."""
    span = lambda df, i, a, b, *more: df.select("context", F.col(i).alias("id"), F.col(a).alias("start_ms"), F.col(b).alias("end_ms"), *more)
    t = span(bound(spark, d, "tasks"), "task_id", "launch_ms", "finish_ms", "failed")
    g = RV.gantt(span(bound(spark, d, "queries"), "sql_execution_id", "start_ms", "end_ms"), span(bound(spark, d, "stages"), "stage_id", "start_ms", "end_ms"), span(bound(spark, d, "executors"), "executor_id", "added_ms", "removed_ms"), t)
    return g.groupBy("kind", "context").agg(F.count("*").alias("n"), F.sum(F.col("start_ms") % 1_000_003).alias("starts"), F.sum(F.col("end_ms") % 1_000_003).alias("ends"))


@query(f"""WITH {cte("tasks")}, t AS (SELECT context, stage_id, task_id, task_ms, failed, row_number() OVER (PARTITION BY context, stage_id ORDER BY launch_ms, task_id, task_ms) - 1 AS place, max(task_ms) OVER (PARTITION BY context, stage_id) AS m FROM tasks) SELECT context, stage_id, place, task_id, task_ms FROM t WHERE place % 25 = 0 OR failed OR task_ms = m""")
def task_columns(spark: SparkSession, d: str) -> DataFrame:
    """V8."""
    return RV.task_columns(bound(spark, d, "tasks"), ["context", "stage_id"], "task_ms", 25).select("context", "stage_id", "place", "task_id", "task_ms")


@query(f"""WITH {cte("executors")}, e AS (SELECT context, executor_id, concat('a', CAST(executor_id AS BIGINT) % 3) AS app FROM executors WHERE CAST(executor_id AS BIGINT) < 12), l AS (SELECT concat('a', user_id % 5) AS app, CAST(user_id % 14 AS VARCHAR) AS executor_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT executor_id, CAST(sum(n) AS BIGINT) AS n FROM l WHERE app IN ('a3', 'a4') GROUP BY ALL),
 x AS (SELECT * FROM e UNION ALL SELECT context, executor_id, NULL FROM executors WHERE CAST(executor_id AS BIGINT) >= 12) SELECT x.context, x.app AS app_id, x.executor_id, coalesce(l.n, r.n) AS records FROM x LEFT JOIN l ON l.app = x.app AND l.executor_id = x.executor_id LEFT JOIN r ON r.executor_id = x.executor_id""")
def executor_logs(spark: SparkSession, d: str) -> DataFrame:
    """J21."""
    e = bound(spark, d, "executors")
    k = F.col("executor_id").cast("int")
    logs = read(spark, d, "events").select(F.concat(F.lit("a"), F.col("user_id") % 5).alias("app_id"), (F.col("user_id") % 14).cast("string").alias("executor_id"), F.lit(1).cast("long").alias("records"))
    return RV.executor_logs(logs, e.filter(k < 12).select("context", F.concat(F.lit("a"), k % 3).alias("app_id"), "executor_id"), e.select("context", "executor_id"))


@query(f"""WITH {cte("stages", "queries")}, j AS (SELECT context, sql_execution_id AS job, CASE WHEN sql_execution_id % 5 > 0 THEN sql_execution_id END AS q, status FROM queries), n AS (
  SELECT concat_ws(':', 'query', context, sql_execution_id) AS id, CASE WHEN root_execution_id <> sql_execution_id THEN concat_ws(':', 'query', context, root_execution_id) ELSE concat_ws(':', 'app', context) END AS parent, 'query' AS kind, status FROM queries
  UNION ALL SELECT concat_ws(':', 'job', context, job), CASE WHEN q IS NOT NULL THEN concat_ws(':', 'query', context, q) ELSE concat_ws(':', 'app', context) END, 'job', status FROM j
  UNION ALL SELECT concat_ws(':', 'stage', context, stage_id, stage_attempt), CASE WHEN stage_id % 2 = 0 THEN concat_ws(':', 'job', context, stage_id) ELSE concat_ws(':', 'app', context) END, 'stage', coalesce(failure_reason, 'ok') FROM stages)
SELECT * FROM n UNION ALL SELECT DISTINCT parent, NULL, 'app', NULL FROM n WHERE parent LIKE 'app:%'""")
def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Containment."""
    q = bound(spark, d, "queries")
    jobs = q.select("context", F.col("sql_execution_id").alias("job_id"), F.when(F.col("sql_execution_id") % 5 > 0, F.col("sql_execution_id")).alias("sql_execution_id"), "status")
    s = bound(spark, d, "stages").select("context", "stage_id", "stage_attempt", F.when(F.col("stage_id") % 2 == 0, F.col("stage_id")).alias("job_id"), F.coalesce("failure_reason", F.lit("ok")).alias("status"))
    return TR.hierarchy(jobs, s, q)


@query("""WITH w AS (SELECT o_custkey % 50 AS tbl, o_orderkey AS q, epoch_us(o_orderdate) // 1000 AS t FROM orders WHERE o_orderkey % 2 = 0), w1 AS (SELECT tbl, t, max(q) AS q FROM w GROUP BY ALL), r AS (SELECT o_custkey % 50 AS tbl, o_orderkey AS q, epoch_us(o_orderdate) // 1000 AS t FROM orders WHERE o_orderkey % 2 = 1),
 e AS (SELECT w1.q AS src, r.q AS dst FROM r ASOF JOIN w1 ON r.tbl = w1.tbl AND r.t >= w1.t), i AS (SELECT o_orderkey - o_orderkey % 4 AS src, o_orderkey AS dst FROM orders), s AS (SELECT min(l_orderkey) AS src, l_orderkey2 AS dst FROM (SELECT l_orderkey, l_partkey, max(l_orderkey) OVER (PARTITION BY l_partkey) AS l_orderkey2 FROM lineitem) GROUP BY l_partkey, l_orderkey2)
SELECT src, dst, kind, count(*) AS n FROM (SELECT 'inside' AS kind, src, dst FROM i UNION ALL SELECT 'table', src, dst FROM e UNION ALL SELECT 'shuffle', src, dst FROM s) WHERE src <> dst GROUP BY ALL""")
def run_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow, J11, J14."""
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("t"), millis("o_orderdate").alias("s")).withColumn("e", F.col("s"))
    table = G.lineage_edges(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "t", "o_orderkey", "s", "e")
    inside = o.select((F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("src"), F.col("o_orderkey").alias("dst"))
    shuffle = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("src"), F.max("l_orderkey").alias("dst"))
    return TR.flow(inside, table, shuffle)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) SELECT o_orderkey, node_id, parent_id, name, detail FROM (
  SELECT o_orderkey, 0 AS node_id, NULL AS parent_id, 'Project' AS name, concat('p ', o_custkey) AS detail FROM o UNION ALL SELECT o_orderkey, 1, 0, 'Join', 'j' FROM o UNION ALL SELECT o_orderkey, 2, 1, 'Scan', concat('a ', o_custkey) FROM o UNION ALL SELECT o_orderkey, 3, 1, 'Exchange', 'x' FROM o UNION ALL SELECT o_orderkey, 4, 3, 'Scan', concat('b ', o_orderstatus) FROM o)""")
def plan_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A plan of five operators for each order, flattened."""
    o = read(spark, d, "orders")
    return TR.plan_nodes(o.select("o_orderkey", _plan_json().alias("plan")), ["o_orderkey"], "plan").drop("metrics")


def _plan_json() -> F.Column:
    node = lambda name, detail, metrics="", children="": F.concat(F.lit(f'{{"nodeName":"{name}","simpleString":"'), detail, F.lit('","metrics":['), F.lit(metrics) if isinstance(metrics, str) else metrics, F.lit('],"children":['), F.lit(children) if isinstance(children, str) else children, F.lit("]}"))
    metric = lambda name, base, kind="sum": F.concat(F.lit(f'{{"name":"{name}","accumulatorId":'), F.col("o_orderkey") * 10 + base, F.lit(f',"metricType":"{kind}"}}'))
    several = lambda *m: F.concat(*[x for pair in zip(m, [F.lit(",")] * (len(m) - 1) + [F.lit("")], strict=True) for x in pair])
    a = node("Scan", F.concat(F.lit("a "), "o_custkey"), several(metric("number of output rows", 1), metric("scan time", 2, "nsTiming"), metric("metadata time", 5, "timing")))
    b = node("Scan", F.concat(F.lit("b "), "o_orderstatus"))
    timed = several(metric("number of output rows", 3), metric("duration", 6, "timing"), metric("sort time", 7, "timing"), metric("peak memory", 8, "size"), metric("spill size", 9, "size"))
    join = node("Join", F.lit("j"), timed, F.concat(a, F.lit(","), node("Exchange", F.lit("x"), metric("data size", 4, "size"), b)))
    return node("Project", F.concat(F.lit("p "), "o_custkey"), "", join)


@query("""WITH o AS (SELECT o_orderkey FROM orders), l AS (SELECT l_orderkey AS k, CAST(sum(l_partkey) AS BIGINT) AS p, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(l_partkey % 50) AS BIGINT) AS r, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, 1 AS node_id, coalesce(q, 0) + o_orderkey AS rows_out, CAST(3 * q AS DOUBLE) AS time_ms, s AS peak_mem, p AS spill_bytes, CAST(NULL AS BIGINT) AS data_bytes FROM o LEFT JOIN l ON k = o_orderkey
UNION ALL SELECT o_orderkey, 2, p, CAST(q * 5 + r AS DOUBLE), NULL, NULL, NULL FROM o LEFT JOIN l ON k = o_orderkey UNION ALL SELECT o_orderkey, 3, NULL, NULL, NULL, NULL, o_orderkey FROM o""")
def operator_metrics(spark: SparkSession, d: str) -> DataFrame:
    """plans' metric ids joined with what tasks and the driver added to them; a scan has two timings, a join its own clock beside another."""
    o = read(spark, d, "orders").withColumn("context", F.lit("c"))
    nodes = TR.plan_nodes(o.select("context", "o_orderkey", _plan_json().alias("plan")), ["context", "o_orderkey"], "plan")
    li, q = read(spark, d, "lineitem"), F.col("l_quantity").cast("long")
    added = {1: F.col("l_partkey"), 2: q * 5_000_000, 3: q, 5: F.col("l_partkey") % 50, 6: q * 3, 7: q * 7, 8: F.col("l_suppkey"), 9: F.col("l_partkey")}
    each = F.explode(F.array(*[F.struct((F.col("l_orderkey") * 10 + base).alias("accumulator"), v.cast("long").alias("total")) for base, v in added.items()])).alias("x")
    totals = li.select(each).select(F.lit("c").alias("context"), "x.*")
    driver = o.select("context", F.explode(F.array(F.col("o_orderkey") * 10 + 3, F.col("o_orderkey") * 10 + 4)).alias("accumulator"), F.col("o_orderkey").alias("total"))
    return TR.headline(TR.node_metrics(nodes, ["context", "o_orderkey"], totals, driver), ["context", "o_orderkey"]).drop("context")


@query("""SELECT o_orderkey, substring(o_orderpriority, 1, 3) AS o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    """A report of 100 rows."""
    return RV.scan(spark, f"{d}/orders.parquet", {"o_orderstatus": "F"}, [F.desc("o_totalprice"), F.col("o_orderkey")], 100, {"o_orderpriority": 3}, ["o_orderdate"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""WITH k AS (SELECT DISTINCT concat('c', user_id % 12) AS context, event_type AS kind FROM events WHERE user_id % 12 < 6 OR event_type <> 'error'), x AS (SELECT DISTINCT context FROM k), e AS (SELECT * FROM (VALUES ('error', 'failures'), ('view', 'reads'), ('gc', 'heap')) v(kind, what)),
 s AS (SELECT concat('c', user_id % 12) AS context, user_id, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), m AS (SELECT context, user_id, median(n - t) AS u FROM s WHERE n IS NOT NULL GROUP BY ALL), h AS (SELECT s.context, count(*) AS n FROM s JOIN m USING (context, user_id) WHERE s.n IS NOT NULL AND s.n - t >= 6 * u GROUP BY s.context)
SELECT x.context, e.kind, e.what FROM x, e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.context = x.context AND k.kind = e.kind) UNION ALL SELECT context, 'rolled files', concat(n, ' holes between rolled files') FROM h""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """R1, W15."""
    e = read(spark, d, "events").select(F.concat(F.lit("c"), F.col("user_id") % 12).alias("context"), F.col("event_type").alias("kind"), F.col("user_id").alias("file"), millis("ts").alias("at"), "user_id")
    return RV.coverage_gaps(e.filter((F.col("user_id") % 12 < 6) | (F.col("kind") != "error")), {"error": "failures", "view": "reads", "gc": "heap"}, e, 6)
