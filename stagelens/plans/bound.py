"""The driver's tables in the shape of log tables: Spark DataFrames, and common table expressions of the same columns for the SQL beside each query.

Each table is a list of expressions that both engines read; {ms(c)} stands for the epoch milliseconds of a timestamp without a zone. Times go by the name
<what>_ms there; the DataFrames have them as timestamps too (<what>_time), as the tables of an event log do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
QTY = "CAST(l_quantity AS BIGINT)"
EPOCH_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
PRICE = "CAST(round(l_extendedprice) AS BIGINT)"

#: name -> (source, columns)
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "tasks": ("lineitem", {
        "context": "concat('app-', l_suppkey % 3)", "stage_id": "l_suppkey", "stage_attempt": "CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END",
        "task_id": "l_orderkey * 8 + l_linenumber", "task_index": "l_partkey % 1000", "executor_id": "CAST(l_partkey % 16 AS VARCHAR(9))", "host": "concat('host-', l_partkey % 16 % 5)",
        "launch_ms": "{ms(l_shipdate)} + (l_orderkey % 1440) * 60000", "finish_ms": f"{{ms(l_shipdate)}} + (l_orderkey % 1440) * 60000 + {QTY} * 20000", "task_ms": f"{QTY} * 20000",
        "gc_ms": f"{QTY} * CAST(round(l_tax * 100) AS BIGINT) * 600", "cpu_ms": f"{QTY} * CAST(round(l_discount * 100) AS BIGINT) * 1500", "fetch_wait_ms": f"{QTY} * 1000", "shuffle_write_ms": f"{QTY} * 500",
        "input_bytes": f"{PRICE} * 10000", "input_records": PRICE, "output_bytes": f"{PRICE} * 10", "shuffle_read": f"{PRICE} * 1000", "shuffle_write": f"{PRICE} * 10000",
        "mem_spill": f"CASE WHEN l_returnflag = 'A' THEN {PRICE} * 4000 ELSE 0 END", "disk_spill": f"CASE WHEN l_returnflag = 'A' THEN {PRICE} * 2000 ELSE 0 END", "peak_mem": f"{PRICE} * 5000",
        "failed": "l_returnflag = 'R'",
        "end_reason": "CASE WHEN l_returnflag <> 'R' THEN 'Success' WHEN l_partkey % 4 = 0 THEN 'FetchFailed' WHEN l_partkey % 4 = 1 THEN 'ExceptionFailure' WHEN l_partkey % 4 = 2 THEN 'ExecutorLostFailure' ELSE 'TaskKilled' END",
        "error": "CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_partkey % 5 = 0 THEN 'java.lang.OutOfMemoryError: Java heap space in TorrentBroadcast' WHEN l_partkey % 5 = 1 THEN concat('FetchFailed from executor ', l_partkey % 16) "
        "WHEN l_partkey % 5 = 2 THEN 'oracle.jdbc: Connection reset' WHEN l_partkey % 5 = 3 THEN 'container killed, exit code 137' ELSE 'job aborted' END",
    }),
    "queries": ("orders", {
        "context": "concat('app-', o_custkey % 3)", "sql_execution_id": "o_orderkey", "root_execution_id": "o_orderkey - o_orderkey % 4", "run_key": "concat('run-', o_custkey)",
        "start_ms": "{ms(o_orderdate)} + (o_orderkey % 1440) * 60000", "end_ms": "{ms(o_orderdate)} + (o_orderkey % 1440) * 60000 + CAST(round(o_totalprice) AS BIGINT) * 10", "duration_ms": "CAST(round(o_totalprice) AS BIGINT) * 10",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'open' END",
        "error": "CASE WHEN o_orderstatus = 'F' THEN concat('query failed: ', o_orderpriority) END",
        "description": "CASE o_orderkey % 6 WHEN 0 THEN concat('ALTER TABLE t', o_custkey % 7, ' SET TBLPROPERTIES (a = ', o_orderkey, ')') WHEN 1 THEN 'MERGE: materialize source' WHEN 2 THEN 'MERGE: scanning files for matches' "
        "WHEN 3 THEN concat('MERGE: rewriting ', o_custkey % 90, ' files') WHEN 4 THEN concat('SELECT * FROM t WHERE k = ', o_orderkey) ELSE concat('Streaming batch ', o_orderkey, ' stream s', o_custkey % 3) END",
        "tables_read": "concat('t', o_orderkey % 9)", "table_written": "CASE WHEN o_orderkey % 3 = 0 THEN concat('t', o_custkey % 9) END",
        "input_bytes": "CAST(round(o_totalprice) AS BIGINT) * 20000", "input_records": "CAST(round(o_totalprice) AS BIGINT) * 100", "output_records": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(round(o_totalprice) AS BIGINT) * 100 ELSE 1 END",
    }),
    "runs": ("orders", {
        "run_key": "concat('run-', o_orderkey)", "context": "concat('app-', o_custkey % 3)", "program": "concat('prog-', o_custkey % 40)", "start_ms": "{ms(o_orderdate)} + (o_orderkey % 1440) * 60000",
        "end_ms": "{ms(o_orderdate)} + (o_orderkey % 1440) * 60000 + CAST(round(o_totalprice) AS BIGINT) * 60", "wait_ms": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(round(o_totalprice) AS BIGINT) * 30 ELSE o_orderkey % 1000 END",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'open' END",
    }),
    "lines": ("events", {
        "event_id": "event_id", "file_path": "concat('/logs/executor/app-', user_id % 3, '/', user_id, '/stderr')", "source": "CASE WHEN user_id % 10 = 0 THEN 'driver' ELSE 'executor' END", "context": "concat('app-', user_id % 3)", "executor_id": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id % 16 AS VARCHAR(9)) END",
        "ts_ms": "{ms(ts)}", "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END", "continuation": "event_id % 7 = 0",
        "signal": "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'executor_lost' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'fetch_failure' WHEN event_type = 'error' THEN 'cache_lost' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'disk_full' END",
        "line": "CASE WHEN event_id % 2 = 0 THEN concat('Lost executor ', user_id % 16) ELSE concat('decommission of ', event_type, ' ', event_id % 97) END",
        "exception": "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'java.lang.OutOfMemoryError' WHEN 1 THEN 'org.app.ParseException' WHEN 2 THEN 'java.lang.InterruptedException' ELSE 'java.io.IOException' END END", "frame": "concat('at app.job', user_id % 6, '.run')",
    }),
}
#: Tables over the ones above.
DERIVED = {
    "stages": """SELECT context, stage_id, stage_attempt, min(launch_ms) - 45000 AS start_ms, max(finish_ms) AS end_ms, min(launch_ms) AS first_ms, count(*) AS tasks, sum(input_bytes) AS input_bytes, CASE WHEN stage_id % 10 = 3 THEN 'Job aborted' WHEN stage_id % 10 = 4 THEN 'cancelled unused stages' END AS failure_reason
      FROM tasks GROUP BY context, stage_id, stage_attempt""",
    "executors": """SELECT context, executor_id, 4 AS cores, min(launch_ms) - 60000 * (CAST(executor_id AS BIGINT) % 4) AS added_ms, CASE WHEN CAST(executor_id AS BIGINT) % 3 = 0 THEN max(finish_ms) - 86400000 * (CAST(executor_id AS BIGINT) % 5) END AS removed_ms,
      CASE WHEN CAST(executor_id AS BIGINT) % 3 <> 0 THEN NULL WHEN CAST(executor_id AS BIGINT) % 2 = 0 THEN 'autoscale' ELSE 'lost' END AS removal_category FROM tasks GROUP BY context, executor_id""",
}
TIMES = {"launch_ms": "launch_time", "finish_ms": "finish_time", "start_ms": "start_time", "end_ms": "end_time", "first_ms": "first_task_time", "added_ms": "added_time", "removed_ms": "removed_time", "ts_ms": "ts"}


def _columns(name: str, ms: str) -> str:
    text = ", ".join(f"{e} AS {k}" for k, e in TABLES[name][1].items())
    return re.sub(r"\{ms\((\w+)\)\}", lambda m: ms.format(m[1]), text)


def cte(*names: str) -> str:
    """The tables (and those they stand on) as common table expressions."""
    wanted = [n for n in TABLES if n in names or n == "tasks" and set(names) & set(DERIVED)] + [n for n in DERIVED if n in names]
    body = lambda n: DERIVED[n] if n in DERIVED else f"SELECT {_columns(n, 'epoch_us({}) // 1000')} FROM {TABLES[n][0]}"
    return ", ".join(f"{n} AS ({body(n)})" for n in wanted)


def bound(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, with its times also as timestamps."""
    if name in DERIVED:
        df = spark.sql(DERIVED[name].replace("FROM tasks", "FROM {tasks}"), tasks=bound(spark, d, "tasks"))
    else:
        source, _ = TABLES[name]
        table = spark.read.parquet(f"{d}/{source}.parquet")
        df = spark.sql(f"SELECT {_columns(name, EPOCH_MS)} FROM {{t}}", t=table)
    return df.withColumns({t: F.timestamp_millis(c) for c, t in TIMES.items() if c in df.columns})
