"""Operators bound to the driver's tables, each beside the SQL that gives the same rows.

Times are epoch milliseconds taken from timestamps without a zone; money and ratios are rounded after the sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelens.functions import text as T
from stagelens.operators import aggregates as A
from stagelens.operators import graph as G
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(c: str) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals: from ts on, value minutes long."""
    e = read(spark, d, "events").withColumn("start_ms", millis("ts"))
    return e.select("event_id", "user_id", "event_type", "value", "start_ms", (F.col("start_ms") + F.floor(F.col("value") * 60000)).alias("end_ms"))


SPANS = "spans AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 60000) AS BIGINT) AS end_ms FROM events)"


@query("""SELECT l_suppkey, count(*) AS n, min(l_quantity) AS "min", quantile_disc(l_quantity, 0.1) AS p10, quantile_disc(l_quantity, 0.5) AS p50,
  quantile_disc(l_quantity, 0.9) AS p90, max(l_quantity) AS "max", round(avg(l_quantity), 4) AS avg FROM lineitem GROUP BY l_suppkey""")
def group_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").withColumn("avg", F.round("avg", 4))


@query("""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS "min", quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS "max"
FROM lineitem GROUP BY l_returnflag""")
def giant_group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """A1 of groups with a third of all rows each: exact percentiles by brackets."""
    return A.exact_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9, 0.99]).drop("avg")


@query("""SELECT l_partkey, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, max(l_quantity) AS "max",
  floor(max(l_quantity) / greatest(quantile_disc(l_quantity, 0.5), 1) * 10 + 0.5) / 10 AS skew FROM lineitem GROUP BY l_partkey""")
def skew_by_group(spark: SparkSession, d: str) -> DataFrame:
    return A.skew(read(spark, d, "lineitem"), ["l_partkey"], "l_quantity")


@query("""WITH v AS (SELECT o_custkey, o_totalprice, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS w FROM orders GROUP BY ALL),
 r AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS run, sum(w) OVER (PARTITION BY o_custkey) AS total FROM v)
SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM r WHERE run >= 0.5 * total GROUP BY o_custkey""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("w", F.round(F.col("o_totalprice") * 100).cast("long"))
    return A.weighted_quantile(o, ["o_custkey"], "o_totalprice", "w")


@query("""SELECT l_returnflag, count(*) FILTER (coalesce(l_extendedprice, 0) <= 0) AS n_0, count(*) FILTER (l_extendedprice > 0 AND l_extendedprice < 10000) AS n_1,
 count(*) FILTER (l_extendedprice >= 10000 AND l_extendedprice < 40000) AS n_2, count(*) FILTER (l_extendedprice >= 40000) AS n_3,
 round(sum(l_extendedprice) FILTER (coalesce(l_extendedprice, 0) <= 0), 2) AS bytes_0,
 round(sum(l_extendedprice) FILTER (l_extendedprice > 0 AND l_extendedprice < 10000), 2) AS bytes_1,
 round(sum(l_extendedprice) FILTER (l_extendedprice >= 10000 AND l_extendedprice < 40000), 2) AS bytes_2,
 round(sum(l_extendedprice) FILTER (l_extendedprice >= 40000), 2) AS bytes_3 FROM lineitem GROUP BY l_returnflag""")
def size_bands(spark: SparkSession, d: str) -> DataFrame:
    out = A.size_bands(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (10_000, 40_000))
    return out.withColumns({f"bytes_{i}": F.round(f"bytes_{i}", 2) for i in range(4)})


@query("""WITH t AS (SELECT l_orderkey, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_suppkey, CAST(total AS BIGINT) AS total, round(total / sum(total) OVER (PARTITION BY l_orderkey), 6) AS share FROM t""")
def share_of_group(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return A.share(li, ["l_orderkey"], ["l_suppkey"], "q").withColumn("share", F.round("share", 6))


@query("""SELECT l_suppkey, l_orderkey % 7 AS part, count(*) AS attempts, count(*) FILTER (l_returnflag = 'R') AS failed,
 coalesce(max(l_quantity) FILTER (l_returnflag <> 'R'), max(l_quantity)) AS max_ms, coalesce(min(l_quantity) FILTER (l_returnflag <> 'R'), min(l_quantity)) AS min_ms,
 count(DISTINCT l_partkey) AS executors, min(epoch_us(l_shipdate) // 1000) AS first_launch, sum(l_quantity) FILTER (l_returnflag <> 'R') AS good_ms, sum(l_quantity) AS all_ms
FROM lineitem GROUP BY ALL""")
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumns({"part": F.col("l_orderkey") % 7, "bad": F.col("l_returnflag") == "R", "at": millis("l_shipdate")})
    return A.stage_metrics(li, ["l_suppkey", "part"], "l_quantity", "bad", "l_partkey", "at")


ISLANDS = """marked AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER w + {gap} THEN 1 WHEN max(end_ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM spans
  WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM marked),
 islands AS (SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM numbered GROUP BY user_id, island)"""


@query(f"WITH {SPANS}, {ISLANDS.format(gap=2 * MINUTE)} SELECT user_id, start_ms, end_ms, n FROM islands")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_intervals(spans(spark, d), ["user_id"], "start_ms", "end_ms", 2 * MINUTE)


@query(f"WITH {SPANS}, {ISLANDS.format(gap=0)} SELECT user_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered FROM islands GROUP BY user_id")
def union_length(spark: SparkSession, d: str) -> DataFrame:
    return I.union_length(spans(spark, d), ["user_id"], "start_ms", "end_ms")


@query(f"""WITH {SPANS}, {ISLANDS.format(gap=0)}, ordered AS (SELECT user_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms) AS end_ms FROM islands)
SELECT user_id, start_ms, end_ms FROM ordered WHERE end_ms - start_ms >= {6 * HOUR}""")
def outside_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = I.gaps(spans(spark, d), ["user_id"], "start_ms", "end_ms", 6 * HOUR)
    return out.select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


SWEEP = "changes AS (SELECT user_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT user_id, start_ms AS t, CAST(event_type = 'view' AS INT) AS a, CAST(event_type = 'error' AS INT) AS b FROM spans WHERE end_ms > start_ms AND event_type IN ('view', 'error') UNION ALL SELECT user_id, end_ms, -CAST(event_type = 'view' AS INT), -CAST(event_type = 'error' AS INT) FROM spans WHERE end_ms > start_ms AND event_type IN ('view', 'error')) GROUP BY ALL)"


@query(f"""WITH {SPANS}, {SWEEP}, levels AS (SELECT user_id, t, sum(a) OVER w AS a, sum(b) OVER w AS b, lead(t) OVER w AS until FROM changes WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 part AS (SELECT user_id, t AS start_ms, until AS end_ms FROM levels WHERE a > 0 AND b = 0 AND until IS NOT NULL),
 marked AS (SELECT *, CASE WHEN start_ms = lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms) THEN 0 ELSE 1 END AS fresh FROM part),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_ms) AS island FROM marked)
SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM numbered GROUP BY user_id, island""")
def subtract_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return I.subtract_intervals(s.filter("event_type = 'view'"), s.filter("event_type = 'error'"), ["user_id"], "start_ms", "end_ms")


LEVELS = """deltas AS (SELECT t, sum(x) AS x FROM (SELECT start_ms AS t, 1 AS x FROM spans WHERE end_ms > start_ms UNION ALL SELECT end_ms, -1 FROM spans WHERE end_ms > start_ms) GROUP BY t),
 levels AS (SELECT t, CAST(sum(x) OVER (ORDER BY t) AS BIGINT) AS level, lead(t) OVER (ORDER BY t) AS until FROM deltas)"""


@query(f"WITH {SPANS}, {LEVELS} SELECT max(level) AS peak, min(t) FILTER (level = (SELECT max(level) FROM levels)) AS peak_at FROM levels")
def peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return I.peak(spans(spark, d), [], "start_ms", "end_ms", width=DAY)


@query(f"""WITH {SPANS}, deltas AS (SELECT user_id % 8 AS k, t, sum(x) AS x FROM (SELECT user_id, start_ms AS t, 1 AS x FROM spans WHERE end_ms > start_ms UNION ALL
  SELECT user_id, end_ms, -1 FROM spans WHERE end_ms > start_ms) GROUP BY ALL),
 levels AS (SELECT k, t, sum(x) OVER (PARTITION BY k ORDER BY t) AS level, lead(t) OVER (PARTITION BY k ORDER BY t) AS until FROM deltas)
SELECT k, CAST(coalesce(sum(until - t) FILTER (level >= 6), 0) AS BIGINT) AS full_ms, CAST(coalesce(sum(until - t) FILTER (level > 6), 0) AS BIGINT) AS queued_wall_ms,
 CAST(sum((until - t) * least(level, 6)) AS BIGINT) AS busy_ms, CAST(sum((until - t) * greatest(level - 6, 0)) AS BIGINT) AS queued_ms, CAST(max(level) AS BIGINT) AS peak_demand
FROM levels WHERE until IS NOT NULL AND level > 0 GROUP BY k""")
def capacity_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).withColumn("k", F.col("user_id") % 8)
    return I.capacity_totals(I.capacity_sweep(s, ["k"], "start_ms", "end_ms", 6, width=DAY), ["k"], 6)


@query(f"""WITH {SPANS}, {LEVELS}, per AS (SELECT level, sum(until - t) AS w FROM levels WHERE until IS NOT NULL AND level > 0 GROUP BY level),
 r AS (SELECT level, sum(w) OVER (ORDER BY level) AS run, sum(w) OVER () AS total FROM per) SELECT min(level) AS demand FROM r WHERE run >= 0.9 * total""")
def time_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    sweep = I.capacity_sweep(spans(spark, d), [], "start_ms", "end_ms", 6, width=DAY).withColumn("dt", F.col("until") - F.col("t"))
    return A.weighted_quantile(sweep, [], "demand", "dt", 0.9, splits=16)


@query(f"""WITH {SPANS}, b AS (SELECT *, unnest(range(start_ms // {HOUR}, (CASE WHEN end_ms > start_ms THEN end_ms - 1 ELSE end_ms END) // {HOUR} + 1)) AS bucket,
  (CASE WHEN end_ms > start_ms THEN end_ms - 1 ELSE end_ms END) // {HOUR} AS last_bucket FROM spans)
SELECT bucket, count(*) FILTER (bucket = last_bucket) AS n,
 round(sum(value * CASE WHEN end_ms > start_ms THEN (least(end_ms, (bucket + 1) * {HOUR}) - greatest(start_ms, bucket * {HOUR})) / (end_ms - start_ms) ELSE 1 END), 6) AS value FROM b GROUP BY bucket""")
def bucket_spread(spark: SparkSession, d: str) -> DataFrame:
    return I.bucket_spread(spans(spark, d), [], "start_ms", "end_ms", ["value"], HOUR).withColumn("value", F.round("value", 6))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {2 * HOUR} THEN 0 ELSE 1 END AS fresh FROM e),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS burst FROM m)
SELECT user_id, min(t) AS "start", max(t) AS "end", count(*) AS n FROM g GROUP BY user_id, burst HAVING count(*) >= 3""")
def bursts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", millis("ts").alias("t"))
    return I.bursts(e, ["user_id"], "t", 2 * HOUR, 3)


@query(f"""WITH h AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 // {HOUR} AS h FROM events), x AS (SELECT user_id, h + 1 AS "start", lead(h) OVER (PARTITION BY user_id ORDER BY h) - 1 AS "end" FROM h)
SELECT user_id, "start", "end", "end" - "start" + 1 AS n FROM x WHERE "end" - "start" + 1 >= 3""")
def idle_grid(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "events").select("user_id", F.floor(millis("ts") / HOUR).alias("h"))
    return I.idle_stretches(used, ["user_id"], "h", 3)


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return W.forward_fill(e, ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "value")


@query("""WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS session FROM conversations)
SELECT conv_id, CAST(session AS BIGINT) AS session, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY ALL""")
def content_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = W.sessions(read(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], F.col("role") == "user")
    return s.groupBy("conv_id", "session").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {SPANS}, a AS (SELECT *, start_ms // {DAY} AS day, event_type = 'error' AS bad, row_number() OVER w AS k, lead(start_ms) OVER w AS nxt FROM spans
  WINDOW w AS (PARTITION BY user_id, start_ms // {DAY} ORDER BY start_ms, event_id)),
 g AS (SELECT user_id, day, count(*) AS attempts, count(*) FILTER (bad) AS failures, min_by(event_type, k) FILTER (bad) AS first_reason, min_by(nxt - end_ms, k) FILTER (bad AND nxt IS NOT NULL) AS delay,
  min(k) FILTER (bad) AS first_bad, min(k) FILTER (bad AND nxt IS NOT NULL) AS first_with_next, max_by(bad, k) AS last_bad, CAST(coalesce(sum(end_ms - start_ms) FILTER (bad), 0) AS BIGINT) AS wasted FROM a GROUP BY ALL)
SELECT user_id, day, attempts, failures, first_reason, CASE WHEN first_bad = first_with_next THEN delay END AS retry_delay, wasted,
 CASE WHEN last_bad THEN 'failed' WHEN failures > 0 THEN 'recovered' ELSE 'succeeded' END AS final FROM g WHERE failures > 0 OR attempts > 1""")
def retry_analysis(spark: SparkSession, d: str) -> DataFrame:
    a = spans(spark, d).withColumns({"day": F.floor(F.col("start_ms") / DAY), "bad": F.col("event_type") == "error"})
    return W.retries(a, ["user_id", "day"], ["start_ms", "event_id"], "start_ms", "end_ms", "bad", "event_type")


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.t, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""")
def asof_last_writer(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", millis("ts").alias("t"))
    views = e.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("t").alias("vt"))
    return J.asof_join(e.filter("event_type = 'purchase'").drop("event_type"), views, ["user_id"], "t", "vt", ["view_id"], width=DAY)


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'error'), v AS (SELECT event_id AS next_id, user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.t, v.next_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t < v.t""")
def asof_next_start(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", millis("ts").alias("t"))
    clicks = e.filter("event_type = 'click'").select(F.col("event_id").alias("next_id"), "user_id", F.col("t").alias("vt"))
    return J.asof_join(e.filter("event_type = 'error'").drop("event_type"), clicks, ["user_id"], "t", "vt", ["next_id"], forward=True, strict=True, width=DAY)


@query(f"""WITH {SPANS}, p AS (SELECT event_id AS error_id, user_id, start_ms AS at FROM spans WHERE event_type = 'error'), s AS (SELECT event_id, user_id, start_ms, end_ms, event_type = 'purchase' AS bad FROM spans WHERE event_type <> 'error'),
 m AS (SELECT p.error_id, s.event_id, s.bad, bool_or(s.bad) OVER (PARTITION BY p.error_id) AS any_bad FROM p JOIN s ON p.user_id = s.user_id AND s.start_ms <= p.at + 2000 AND s.end_ms >= p.at - 2000),
 hit AS (SELECT error_id, event_id, false AS fallback FROM m WHERE bad OR NOT any_bad)
SELECT * FROM hit UNION ALL SELECT p.error_id, s.event_id, true FROM p JOIN s ON s.start_ms <= p.at AND s.end_ms >= p.at - 60000 AND s.bad WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.error_id = p.error_id)""")
def interval_error_join(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    points = s.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("start_ms").alias("at"))
    work = s.filter("event_type <> 'error'").select("event_id", "user_id", "start_ms", "end_ms", (F.col("event_type") == "purchase").alias("bad"))
    # read twice: as rows, and for the errors that have none
    hit = G.written(J.running_at(points, work, ["user_id"], "at", "start_ms", "end_ms", "bad", 2000, 6 * HOUR).select("error_id", "event_id"))
    open_ = work.filter("bad").drop("user_id")
    rest = J.with_fallback(points, hit, ["error_id"], open_, "at", "start_ms", "end_ms", MINUTE, HOUR)
    return hit.select("error_id", "event_id", F.lit(False).alias("fallback")).unionByName(rest.select("error_id", "event_id", F.lit(True).alias("fallback")))


@query(f"""WITH {SPANS} SELECT a.event_id, count(*) AS others, CAST(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS overlap
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms) GROUP BY a.event_id""")
def overlap_share(spark: SparkSession, d: str) -> DataFrame:
    return J.overlap_share(spans(spark, d), ["user_id"], "event_id", "start_ms", "end_ms", 6 * HOUR)


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000 AS s, epoch_us(o_orderdate) // 1000 + {30 * DAY} AS e FROM orders)
SELECT a.o_orderkey, array_to_string(list_sort(list(DISTINCT b.o_orderkey)), ',') AS overlapping FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND greatest(a.s, b.s) < least(a.e, b.e) GROUP BY a.o_orderkey""")
def overlapping_runs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", millis("o_orderdate").alias("s")).withColumn("e", F.col("s") + 30 * DAY)
    return J.overlapping(o, ["o_custkey"], "o_orderkey", "s", "e", 30 * DAY).withColumn("overlapping", F.array_join(F.col("overlapping").cast("array<string>"), ","))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id, b.event_type AS prev_event_type, b.value AS prev_value FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.k = a.k - 1""")
def prev_attempt(spark: SparkSession, d: str) -> DataFrame:
    return J.previous_attempt(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"]).select("event_id", "prev_event_type", "prev_value")


@query("""WITH m AS (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey)
SELECT m.l_partkey, m.l_suppkey, min(l.l_orderkey) AS l_orderkey FROM m JOIN lineitem l USING (l_partkey, l_suppkey) GROUP BY ALL""")
def lowest_parent(spark: SparkSession, d: str) -> DataFrame:
    return J.lowest_parent(read(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", ["l_orderkey"])


@query("""WITH f AS (SELECT o_custkey, min_by({'k': o_orderkey, 'p': o_totalprice}, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
 l AS (SELECT o_custkey, max_by({'k': o_orderkey, 'p': o_totalprice, 't': o_orderpriority}, o_orderkey) AS e FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT coalesce(f.o_custkey, l.o_custkey) AS o_custkey, coalesce(e.k, s.k) AS o_orderkey, coalesce(e.p, s.p) AS o_totalprice, e.t AS o_orderpriority FROM f FULL JOIN l ON f.o_custkey = l.o_custkey""")
def start_end_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    starts = o.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_totalprice")
    ends = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return J.start_end(starts, ends, ["o_custkey"], "o_orderkey")


TAGS = (("secret", r"(token|password|secret)\s*="), ("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+"), ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("shout", r"[A-Z]{6,}"), ("number", r"[0-9]{3}"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TAGS) + " WHEN text IS NOT NULL THEN 'plain' END AS tag FROM documents")
def first_match_tag(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.first_match(F.col("text"), TAGS, "plain").alias("tag"))


@query(r"""WITH d AS (SELECT doc_id, source, substring(sha256(concat_ws('|', coalesce(lang, ''), regexp_replace(text, ':\d+\)|\d+|0x[0-9a-f]+', '', 'g'))), 1, 12) AS fingerprint FROM documents)
SELECT fingerprint, count(*) AS n, min(doc_id) AS "first", max(doc_id) AS "last", count(DISTINCT source) AS n_source, min_by(source, doc_id) AS source FROM d GROUP BY fingerprint""")
def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return A.summary(docs.select("doc_id", "source", T.fingerprint(F.col("lang"), F.array("text")).alias("fingerprint")), ["fingerprint"], "doc_id", [], ["source"], ["source"])


@query(r"""WITH k AS (SELECT page_id, substring(trim(regexp_replace(regexp_replace(lower(url), '''(?:[^'']|'''')*''|\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g')), 1, 500) AS key FROM pages)
SELECT key, count(*) AS n, min(page_id) AS "first" FROM k GROUP BY key""")
def query_key_groups(spark: SparkSession, d: str) -> DataFrame:
    keyed = read(spark, d, "pages").select("page_id", T.query_key(F.col("url")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("SELECT date_trunc('minute', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def signal_timeline(spark: SparkSession, d: str) -> DataFrame:
    return A.per_bucket(read(spark, d, "events"), "ts", ["event_type"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT CAST(label AS VARCHAR) AS value, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 200")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return A.facets(read(spark, d, "embeddings"), "label").withColumn("value", F.col("value").cast("string"))


STAT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER ({c} IS NULL) AS n_null, CAST(min({c}) AS DOUBLE) AS \"min\", CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc({c}, 0.9) AS DOUBLE) AS p90, CAST(max({c}) AS DOUBLE) AS \"max\", round(CAST(sum({c}) AS DOUBLE), 2) AS \"sum\" FROM lineitem" for c in STAT_COLUMNS))
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.column_stats(read(spark, d, "lineitem"), STAT_COLUMNS).withColumn("sum", F.round("sum", 2))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate) AS rank FROM lineitem)
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, rank FROM r WHERE rank <= 5""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"))]
    return W.top_n(read(spark, d, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "rank")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE p % 10 = 0 OR o_orderstatus = 'F'""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    out = W.systematic_sample(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 10, F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH m AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS failed, max(l_quantity) AS mx, quantile_disc(l_quantity, 0.5) AS p50, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_suppkey),
 f AS (SELECT 'task_skew' AS category, l_suppkey AS entity, 1 AS severity, mx AS measure FROM m WHERE mx >= 1.9 * p50
  UNION ALL SELECT 'task_retries', l_suppkey, CASE WHEN failed >= 0.3 * n THEN 0 ELSE 2 END, failed FROM m WHERE failed >= 0.25 * n
  UNION ALL SELECT 'big_read', l_suppkey, 1, q FROM m WHERE q >= 15500)
SELECT 'F' || CASE WHEN row_number() OVER w < 1000 THEN lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER w AS VARCHAR) END AS id, category, entity, severity, CAST(measure AS DOUBLE) AS measure
FROM f WINDOW w AS (ORDER BY severity, category, entity)""")
def ranked_findings(spark: SparkSession, d: str) -> DataFrame:
    from stagelens.operators.findings import Rule, detect

    li = read(spark, d, "lineitem")
    m = li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.max("l_quantity").alias("mx"), A.quantile("l_quantity", 0.5).alias("p50"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    rules = [
        Rule("task_skew", F.col("mx") >= 1.9 * F.col("p50"), F.lit(1), measure=F.col("mx")),
        Rule("task_retries", F.col("failed") >= 0.25 * F.col("n"), F.when(F.col("failed") >= 0.3 * F.col("n"), 0).otherwise(2), measure=F.col("failed")),
        Rule("big_read", F.col("q") >= 15500, F.lit(1), measure=F.col("q")),
    ]
    found = detect(m, rules, entity=F.col("l_suppkey"))
    return W.ranked_ids(found, [F.col("severity"), F.col("category"), F.col("entity")]).select("id", "category", "entity", "severity", "measure")


@query("""WITH w AS (SELECT o_orderkey, o_custkey, list(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN len(seen) >= 2 THEN list_sort(seen)[CAST(ceil(len(seen) / 2) AS BIGINT)] END AS typical FROM w""")
def typical_duration(spark: SparkSession, d: str) -> DataFrame:
    return A.typical(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "o_custkey", "typical")


@query("""WITH n AS (SELECT r_regionkey AS region, r_regionkey * 8 AS node FROM region UNION ALL SELECT n_regionkey, n_nationkey * 8 + 1 FROM nation UNION ALL SELECT n_regionkey, s_suppkey * 8 + 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT n_regionkey, c_custkey * 8 + 3 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, o_orderkey * 8 + 4 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT node, min(node) OVER (PARTITION BY region) AS component FROM n""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their customers, these and all suppliers with their nations, nations with regions: a component for each region, with hubs."""
    of = lambda name, a, ka, b, kb: read(spark, d, name).select((F.col(a) * 8 + ka).cast("long").alias("a"), (F.col(b) * 8 + kb).cast("long").alias("b"))
    edges = of("nation", "n_nationkey", 1, "n_regionkey", 0).unionByName(of("supplier", "s_suppkey", 2, "s_nationkey", 1)).unionByName(of("customer", "c_custkey", 3, "c_nationkey", 1)).unionByName(of("orders", "o_orderkey", 4, "o_custkey", 3))
    return G.connected_components(edges, "a", "b")


@query("""SELECT l_orderkey, round(sum(least(l_extendedprice * l_discount, l_extendedprice)), 4) AS cpu, round(sum(greatest(0, least(l_extendedprice * l_tax, l_extendedprice - least(l_extendedprice * l_discount, l_extendedprice)))), 4) AS gc FROM lineitem GROUP BY l_orderkey""")
def time_causes(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    parts = A.cause_split(price, {"cpu": price * F.col("l_discount"), "gc": price * F.col("l_tax")})
    return read(spark, d, "lineitem").select("l_orderkey", *parts).groupBy("l_orderkey").agg(F.round(F.sum("cpu"), 4).alias("cpu"), F.round(F.sum("gc"), 4).alias("gc"))


@query("""WITH c AS (SELECT source, lang, count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY ALL), m AS (SELECT source, max(k) AS k FROM c GROUP BY source)
SELECT c.source, min(lang) AS lang FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source AND c.k = m.k GROUP BY c.source""")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    return A.mode(read(spark, d, "documents"), ["source"], "lang")


@query("""WITH t AS (SELECT l_partkey % 50 AS stage, median(l_quantity) AS m FROM lineitem GROUP BY ALL), o AS (SELECT l_partkey % 50 AS stage, l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(median(o.m / t.m), 6) AS slowness FROM o JOIN t USING (stage) WHERE t.m > 0 GROUP BY l_suppkey""")
def executor_slowness(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumn("stage", F.col("l_partkey") % 50)
    return A.slowness(li, ["stage"], "l_suppkey", "l_quantity").withColumn("slowness", F.round("slowness", 6))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS e FROM events), m AS (SELECT user_id, median(e - t) AS usual FROM s WHERE e IS NOT NULL GROUP BY user_id)
SELECT s.user_id, t AS "start", e AS "end", e - t AS step, usual FROM s JOIN m USING (user_id) WHERE e - t >= 1.8 * usual""")
def series_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.series_gaps(read(spark, d, "events").select("user_id", millis("ts").alias("t")), ["user_id"], "t")


@query("""WITH a AS (SELECT user_id % 10 AS k, event_type, count(*) AS na FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id % 10 AS k, event_type, count(*) AS nb FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN coalesce(nb, 0) > coalesce(na, 0) THEN 'added' ELSE 'removed' END AS side, abs(coalesce(nb, 0) - coalesce(na, 0)) AS n
FROM a FULL JOIN b ON a.k = b.k AND a.event_type = b.event_type WHERE coalesce(na, 0) <> coalesce(nb, 0)""")
def plan_difference(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", F.col("user_id") % 10)
    return W.plan_difference(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["k"], "event_type")


@query(f"""WITH {SPANS}, h AS (SELECT user_id, start_ms // {DAY} AS day, max_by(value, (start_ms, event_id)) AS value FROM spans GROUP BY ALL), l AS (SELECT max(start_ms // {DAY}) AS top FROM spans),
 n AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day) - 1, top) AS stop FROM h, l)
SELECT user_id, unnest(range(day, stop + 1)) AS day, value FROM n""")
def heap_carried_forward(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).withColumns({"day": F.floor(F.col("start_ms") / DAY), "at": F.struct("start_ms", "event_id")})
    top = s.agg(F.max("day").alias("top"))
    return I.carried_forward(s.join(F.broadcast(top)), ["user_id"], "day", "at", "value", "top")


@query("""WITH t AS (SELECT l_partkey % 20 AS k, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY total DESC, l_suppkey) AS n FROM t)
SELECT k, min_by(l_suppkey, n) AS top, CAST(max(total) AS BIGINT) AS total FROM r GROUP BY k""")
def top_contributor(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").withColumns({"k": F.col("l_partkey") % 20, "q": F.col("l_quantity").cast("long")})
    out = A.top_executors_text(li, ["k"], "l_suppkey", "q").select("k", "top")
    return out.join(A.share(li, ["k"], ["l_suppkey"], "q").groupBy("k").agg(F.max("total").alias("total")), "k")


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice FROM orders), p AS (SELECT a.o_orderkey, b.o_orderkey AS candidate, CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 0 ELSE 1 END AS "group", b.o_totalprice AS price
 FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, "group" ORDER BY price, candidate) AS rank FROM p)
SELECT o_orderkey, candidate, "group", rank FROM r WHERE rank <= CASE "group" WHEN 0 THEN 2 ELSE 1 END""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    groups = [J.Candidates(0, ["o_custkey", "o_orderpriority"], 2), J.Candidates(1, ["o_custkey"], 1, differs="o_orderpriority")]
    out = J.ranked_candidates(o, o, "o_orderkey", ["o_totalprice"], groups)
    return out.select("o_orderkey", F.col("c_o_orderkey").alias("candidate"), "group", "rank")


@query(f"""WITH f AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, user_id, epoch_us(ts) // 1000 // {HOUR} AS h FROM events WHERE event_type IN ('error', 'purchase')),
 s AS (SELECT event_id, event_type, t, 'users:' || user_id AS scope FROM f UNION ALL SELECT event_id, event_type, t, 'hours:' || h FROM f)
SELECT a.event_id AS cause, b.event_id AS effect, 3 + count(DISTINCT a.scope) AS score FROM s a JOIN s b ON a.scope = b.scope AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.t <= b.t + 1000 GROUP BY ALL""")
def cause_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter("event_type IN ('error', 'purchase')").withColumn("t", millis("ts"))
    e = e.select("event_id", "event_type", "t", F.array("user_id").alias("users"), F.array(F.floor(F.col("t") / HOUR)).alias("hours"))
    rules = spark.createDataFrame([("error", "purchase", 3)], "cause_kind string, effect_kind string, weight int")
    return G.candidate_pairs(e, "event_id", ["users", "hours"], "event_type", "t", rules, 1000)


@query("""SELECT event_id, coalesce(lag(event_id, 8) OVER w, first_value(event_id) OVER w) AS root, least(row_number() OVER w - 1, 8) AS steps FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
QUALIFY row_number() OVER w > 1""")
def root_causes(spark: SparkSession, d: str) -> DataFrame:
    """Each event's cause is its user's last one of its type; roots are up to eight causes back."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    best = read(spark, d, "events").withColumn("before", F.lag("event_id").over(w)).filter("before IS NOT NULL").select("event_id", "before")
    return G.follow_roots(best, "event_id", "before", depth=8)


@query("""WITH w AS (SELECT user_id AS k, event_id AS src, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'signup'), r AS (SELECT user_id AS k, event_id AS dst, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'click')
SELECT w.src, r.dst, r.k FROM r ASOF JOIN w ON r.k = w.k AND r.t >= w.t""")
def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", "event_type", millis("ts").alias("t"))
    return G.lineage_edges(e.filter("event_type = 'signup'"), e.filter("event_type = 'click'"), "k", "event_id", "t", "t")


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type, user_id % 5 AS who, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, who, event_id, n FROM c""")
def collapsed_repeats(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumns({"hour": F.date_trunc("hour", "ts"), "who": F.col("user_id") % 5})
    return W.collapse(e.withColumn("e", F.col("event_id")), ["hour", "event_type", "who"], ["ts", "event_id"], ["event_id"]).select("event_type", "who", "event_id", "n")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber = 3 AND (contains(lower(l_linestatus), 'o'))""")
def filtered_rows(spark: SparkSession, d: str) -> DataFrame:
    out = W.where_equal(read(spark, d, "lineitem"), {"l_returnflag": ["R", "A"], "l_linenumber": 3})
    return out.filter(T.contains_anywhere("O", F.col("l_linestatus"))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"""WITH {SPANS}, w AS (SELECT user_id, min(start_ms) AS s, min(start_ms) + {5 * DAY} AS e FROM spans GROUP BY user_id)
SELECT event_id, greatest(start_ms, s) AS start_ms, least(end_ms, e) AS end_ms FROM spans JOIN w USING (user_id) WHERE greatest(start_ms, s) < least(end_ms, e)""")
def clipped_to_windows(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    first = s.groupBy("user_id").agg(F.min("start_ms").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 5 * DAY)
    return I.clip(s, first, ["user_id"], "start_ms", "end_ms", 12 * HOUR).select("event_id", "start_ms", "end_ms")


@query("""SELECT user_id, min_by(value, ts) FILTER (value > 100) AS value, min(epoch_us(ts) // 1000) FILTER (event_type = 'view') AS view_time, min(epoch_us(ts) // 1000) FILTER (event_type = 'error') AS error_time FROM events GROUP BY user_id""")
def operation_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("value", F.when(F.col("value") > 100, F.col("value"))).withColumn("t", millis("ts"))
    return A.pivot_first(e, ["user_id"], "ts", ["value"], "event_type", "t", ["view", "error"])


@query("""WITH t AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_suppkey),
 f AS (SELECT l_suppkey, 'often' AS category, CASE WHEN bad > 0.33 * n THEN 0 ELSE 1 END AS severity FROM t WHERE bad > 0.25 * n UNION ALL SELECT l_suppkey, 'many', 2 FROM t WHERE n > 600)
SELECT category, count(*) FILTER (severity = 0) AS high, count(*) FILTER (severity = 1) AS medium, count(*) FILTER (severity = 2) AS low FROM f GROUP BY category""")
def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    from stagelens.operators.findings import Rule, counts, detect

    t = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    rules = [Rule("often", F.col("bad") > 0.25 * F.col("n"), F.when(F.col("bad") > 0.33 * F.col("n"), 0).otherwise(1)), Rule("many", F.col("n") > 600, F.lit(2))]
    return counts(detect(t, rules, F.col("l_suppkey")), ["category"])
