"""Incidents on the log-shaped tables, beside their SQL: failed tasks and aborted stages as findings, their problems, causes and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.operators import incidents as N
from stagelens.operators.graph import written
from stagelens.plans.bound import bound, cte
from stagelens.plans.queries import query

#: Executors that failed tasks were lost, killed or out of memory; fetch failures belong to their stage too; aborted stages are findings of their own.
FINDINGS = """SELECT concat('t', stage_id, '.', stage_attempt, '.', executor_id, '.', context, '.', end_reason) AS finding_id, CASE end_reason WHEN 'FetchFailed' THEN 'log:fetch_failure' WHEN 'ExecutorLostFailure' THEN 'executor_lost' WHEN 'TaskKilled' THEN 'executor_killed' ELSE 'executor_oom' END AS category,
    ts, context, CASE WHEN end_reason = 'FetchFailed' THEN stage_id END AS stage_id, CASE WHEN end_reason = 'FetchFailed' THEN stage_attempt END AS stage_attempt, executor_id
  FROM (SELECT context, stage_id, stage_attempt, executor_id, end_reason, min(finish_ms) AS ts FROM {tasks} WHERE failed GROUP BY context, stage_id, stage_attempt, executor_id, end_reason)
  UNION ALL SELECT concat('s', stage_id, '.', stage_attempt, '.', context), 'stage_failed', end_ms, context, stage_id, stage_attempt, NULL FROM {stages} WHERE failure_reason = 'Job aborted'"""
PROBLEMS = f"""WITH RECURSIVE {cte("stages")}, f0 AS ({FINDINGS.format(tasks="tasks", stages="stages")}),
 f AS (SELECT *, CASE category WHEN 'log:fetch_failure' THEN 'fetch' WHEN 'executor_lost' THEN 'lost' WHEN 'executor_killed' THEN 'killed' WHEN 'executor_oom' THEN 'oom' ELSE 'stage_failed' END AS kind, concat(context, '|', executor_id) AS ekey, concat(context, '|', stage_id, '|', stage_attempt) AS skey FROM f0),
 ch AS (SELECT finding_id, lag(finding_id) OVER w AS prev, ts - lag(ts) OVER w AS d FROM f WHERE executor_id IS NOT NULL WINDOW w AS (PARTITION BY kind, ekey ORDER BY ts, finding_id)),
 ed AS (SELECT finding_id AS a, prev AS b FROM ch WHERE d <= 120000 UNION ALL SELECT finding_id, min(finding_id) OVER (PARTITION BY skey) FROM f WHERE kind = 'fetch'),
 e2 AS (SELECT DISTINCT * FROM (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed) WHERE a <> b), reach(a, b) AS (SELECT finding_id, finding_id FROM f UNION SELECT r.a, e.b FROM reach r JOIN e2 e ON r.b = e.a),
 members AS (SELECT a AS finding_id, min(b) AS problem FROM reach GROUP BY a)"""
LINKS = f"""{PROBLEMS}, prob AS (SELECT problem, kind, CASE kind WHEN 'oom' THEN 3 WHEN 'killed' THEN 3 WHEN 'lost' THEN 4 WHEN 'fetch' THEN 5 ELSE 6 END AS level, min(ts) AS ts, max(ts) AS until FROM f JOIN members USING (finding_id) GROUP BY problem, kind),
 sc AS (SELECT finding_id, 'stage' AS type, skey AS key, false AS inferred FROM f WHERE stage_id IS NOT NULL UNION ALL SELECT finding_id, 'executor', ekey, false FROM f WHERE executor_id IS NOT NULL
   UNION ALL SELECT finding_id, 'stage', concat(t.context, '|', t.stage_id, '|', t.stage_attempt), true FROM f JOIN tasks t ON t.context = f.context AND t.executor_id = f.executor_id AND t.launch_ms <= f.ts + 2000 AND t.finish_ms >= f.ts - 2000),
 ab AS (SELECT problem, type, key, bool_and(inferred) AS inferred FROM sc JOIN members USING (finding_id) GROUP BY ALL), ran AS (SELECT DISTINCT concat(context, '|', stage_id, '|', stage_attempt) AS key, concat(context, '|', executor_id) AS e FROM tasks),
 rules(ck, ek) AS (VALUES ('oom', 'killed'), ('oom', 'lost'), ('killed', 'lost'), ('oom', 'fetch'), ('killed', 'fetch'), ('lost', 'fetch'), ('oom', 'stage_failed'), ('killed', 'stage_failed'), ('lost', 'stage_failed'), ('fetch', 'stage_failed')),
 cau AS (SELECT problem AS cause, kind AS ck, level, type, key, type = 'stage' AND inferred AS ci, ts AS ct, until FROM ab JOIN prob USING (problem) UNION ALL SELECT problem, kind, level, 'ran_on', key, false, ts, until FROM ab JOIN prob USING (problem) WHERE type = 'executor' AND kind IN ('oom', 'killed', 'lost')),
 eff AS (SELECT problem AS effect, kind AS ek, level AS el, type, key, inferred AS ei, ts FROM ab JOIN prob USING (problem) UNION ALL SELECT DISTINCT problem, kind, level, 'ran_on', e, false, ts FROM ab JOIN prob USING (problem) JOIN ran USING (key) WHERE type = 'stage'),
 last AS (SELECT * FROM eff JOIN rules USING (ek) JOIN cau USING (type, key, ck) WHERE ct <= ts + 5000 AND level < el QUALIFY row_number() OVER (PARTITION BY effect, type, key, ei, ck, ci ORDER BY ct DESC, cause DESC) = 1),
 scored AS (SELECT *, CASE WHEN type = 'stage' THEN CASE WHEN ei AND ci THEN 2 ELSE 3 END WHEN ts - until <= 1800000 THEN 2 ELSE 0 END AS score FROM last),
 links AS (SELECT effect, cause, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY effect ORDER BY score DESC, level DESC, ct DESC, cause DESC) = 1)"""


def _frames(spark: SparkSession, d: str, infer: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """findings with their kinds, tasks, stages, and what the findings are about."""
    tasks, stages, executors = (bound(spark, d, t) for t in ("tasks", "stages", "executors"))
    none = lambda kind: F.lit(None).cast(kind)
    # sums over all tasks that several steps read: taken once
    stages = written(stages).withColumns({"sql_execution_id": none("long"), "stage_name": F.lit("")})
    executors = written(executors).withColumn("host", F.concat(F.lit("host-"), F.col("executor_id").cast("int") % 5))
    f = spark.sql(FINDINGS, tasks=tasks, stages=stages).withColumns({"severity": F.lit(0), "sql_execution_id": none("long")} | {c: none("string") for c in ("run_key", "entity", "evidence", "signal", "fingerprint")})
    nothing = lambda *names: spark.range(0).select(*[none("long" if n == "ts" else "string").alias(n) for n in names]).filter("false")
    lines = nothing("signal", "line", "ts", "context", "executor_id")
    errors = nothing("fingerprint", "message", "ts", "context", "executor_id", "source", "user_frame")
    kinds = written(N.finding_kinds(f, errors))
    return kinds, tasks, stages, written(N.finding_scopes(kinds, stages, executors, tasks, lines, errors, infer=infer))


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kinds, tasks, stages, scopes = _frames(spark, d)
    problems, about = (written(x) for x in N.problems_of(kinds, scopes, written(N.problem_members(kinds, scopes))))
    return problems, about, written(N.best_links(problems, about, tasks, stages))


@query(f"{PROBLEMS} SELECT finding_id, problem, kind FROM f JOIN members USING (finding_id)")
def problems(spark: SparkSession, d: str) -> DataFrame:
    """Which findings are one problem."""
    kinds, _, _, scopes = _frames(spark, d, N.ERRORS)
    return N.problem_members(kinds, scopes).join(kinds.select("finding_id", "kind"), "finding_id")


@query(f"{LINKS} SELECT effect, cause, score FROM links")
def incident_causes(spark: SparkSession, d: str) -> DataFrame:
    """The best cause of each problem that has one."""
    return _linked(spark, d)[2].drop("because")


@query(f"""{LINKS}, up(problem, cur, steps) AS (SELECT problem, problem, 0 FROM prob UNION ALL SELECT problem, cause, steps + 1 FROM up JOIN links ON effect = cur), ends AS (SELECT problem, max_by(cur, steps) AS root, max(steps) AS steps FROM up GROUP BY problem),
 tops AS (SELECT root, min(problem) AS incident, max_by(problem, (level, -ts, problem)) AS top FROM ends JOIN prob USING (problem) GROUP BY root)
SELECT p.problem, incident, p.kind, CASE WHEN p.problem = e.root THEN 'root' ELSE 'effect' END AS role, cause, CASE score WHEN 3 THEN 'strong' WHEN 2 THEN 'likely' END AS confidence, top, e.root, t.steps
FROM prob p JOIN ends e USING (problem) JOIN tops ON tops.root = e.root JOIN ends t ON t.problem = top LEFT JOIN links l ON l.effect = p.problem""")
def incident_roles(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of linked problems, the way from the highest problem down to its root, and who is what."""
    return N.incident_roles(*_linked(spark, d)).select("problem", "incident", "kind", "role", "cause", "confidence", "top", "root", "steps")
