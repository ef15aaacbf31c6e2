"""Steps whose work must grow no faster than their input, and rules that leave no ties."""

import random

import duckdb

from pyspark.sql import functions as F

from stagelens.operators import graph as G
from stagelens.operators import incidents as N
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.plans import advice as AD
from stagelens.plans import log_queries  # noqa: F401  (it registers its queries)
from stagelens.plans import queries as Q
from stagelens.plans import run_views as RV
from stagelens.plans import views as V


def got(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_forward_asof_takes_no_frame_of_all_following_rows(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(k, rng.randrange(300)) for k in "ab" for _ in range(60)], "k string, t long")
    right = spark.createDataFrame([(k, rng.randrange(300), rng.randrange(9)) for k in "ab" for _ in range(60)], "k string, u long, v long")
    rows = [tuple(r) for r in right.collect()]
    for strict in (False, True):
        later = lambda u, t: u > t if strict else u >= t  # noqa: B023, E731
        want = sorted((k, t, *min(((u, v) for b, u, v in rows if b == k and later(u, t)), default=(None, None))) for k, t in (tuple(r) for r in left.collect()))
        for width in (None, 7, 1000):
            out = J.asof_join(left, right, ["k"], "t", "u", ["u", "v"], forward=True, strict=strict, width=width)
            assert sorted(map(str, got(out.fillna(-1)))) == sorted(str(tuple(-1 if x is None else x for x in r)) for r in want)
            assert "unboundedfollowing" not in plan(out)


def test_gantt_and_busy_time_leave_no_ties(spark, sf_dir, tmp_path):
    rows = [("c", i % 7, 5, 9, i % 3 == 0) for i in range(400)]
    none = spark.createDataFrame([], "context string, id long, start_ms long, end_ms long")
    shown = []
    for turn in (rows, rows[::-1]):
        tasks = spark.createDataFrame(turn, "context string, id long, start_ms long, end_ms long, failed boolean").coalesce(1)
        shown.append(got(RV.gantt(none, none, none, tasks, every=5).groupBy("kind", "id").count()))
    assert shown[0] == shown[1]
    # equal tasks several times over: the SQL must number islands by what it orders, not by the order rows come in
    con = duckdb.connect()
    con.execute(f"COPY (SELECT l.* FROM '{sf_dir}/lineitem.parquet' l, range(30)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = Q.QUERIES["executor_profile"](spark, str(tmp_path))
    want = con.execute(Q.SQL["executor_profile"])
    names = [c[0] for c in want.description]
    assert got(df.select(*names)) == sorted(want.fetchall())


def test_candidate_pairs_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(f"F{i}", rng.choice("xyz"), rng.randrange(50), [rng.randrange(4) for _ in range(3)] or None, None if i % 7 == 0 else [f"e{rng.randrange(3)}", None]) for i in range(60)]
    f = spark.createDataFrame(rows, "id string, kind string, at long, stages array<long>, executors array<string>")
    rules = spark.createDataFrame([("x", "y", 3), ("x", "y", 5), ("y", "z", 1)], "cause_kind string, effect_kind string, weight int")
    scopes = {r[0]: {("s", x) for x in r[3]} | {("e", x) for x in r[4] or [] if x is not None} for r in rows}
    weight = {("x", "y"): 5, ("y", "z"): 1}
    want = sorted((a[0], b[0], weight[a[1], b[1]] + len(scopes[a[0]] & scopes[b[0]])) for a in rows for b in rows if (a[1], b[1]) in weight and scopes[a[0]] & scopes[b[0]] and a[2] <= b[2] + 10)
    out = G.candidate_pairs(f, "id", ["stages", "executors"], "kind", "at", rules, 10)
    assert got(out) == want
    text = plan(out)
    assert "aggregate" not in text[: text.index("join")]


def test_storage_split_has_no_window_of_a_whole_context(spark):
    tasks = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, None), (None, 3, 7), (None, 4, None)], "context string, stage_id long, input_bytes long")
    out = V.storage_split(tasks)
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, [("a", 1, 0), ("a", 2, 5), ("b", 1, None), (None, 3, 7), (None, 4, 0)]))
    assert "window" not in plan(out)


def test_run_end_meets_stretches_of_errors_once(spark, monkeypatch):
    rng = random.Random(7)
    runs = [(f"r{i}", f"c{i % 2}", f"p{i % 3}", s, s + 30) for i, s in enumerate(rng.randrange(3000) for _ in range(80))]
    errors = [(f"c{rng.randrange(2)}", f"f{rng.randrange(3)}", t) for t in [rng.randrange(3000) for _ in range(120)] + [5] * 50]
    r = spark.createDataFrame(runs, "run_key string, context string, program string, start_ms long, end_ms long")
    q = spark.createDataFrame([], "run_key string, sql_execution_id long, status string, end_ms long")
    x = spark.createDataFrame([], "context string, removed_ms long, removal_category string")
    pairs, join = [], I.overlap_join
    monkeypatch.setattr(I, "overlap_join", lambda *a, **k: pairs.append(join(*a, **k)) or pairs[-1])
    out = RV.run_end(r, q, x, spark.createDataFrame(errors, "context string, fingerprint string, ts_ms long"), r.groupBy("context").agg(F.max("end_ms").alias("end_ms")), 20, 5, 9, 10)
    hits = {(k, p, f) for k, c, p, _, e in runs for b, f, t in errors if b == c and e - 20 <= t <= e + 5}
    with_ = {k: [len({h[0] for h in hits if h[1:] == (p, f)}) for k2, p, f in hits if k2 == k] for k, *_ in runs}
    assert got(out.select("run_key", "error_kinds", F.coalesce("runs_with", F.lit(0)))) == sorted((k, len(v), max(v, default=0)) for k, v in with_.items())
    assert pairs[0].count() == len(hits)


def test_problems_need_running_stages_of_errors_only(spark):
    rng = random.Random(11)
    kinds = {"executor_lost": "lost", "executor_oom": "oom", "task_skew": "skew", "stage_failed": "stage_failed", "other": "other_error"}
    rows = [(f"F{i:03}", c, 0, rng.randrange(400_000), "c", rng.randrange(4) if i % 3 == 0 else None, 0, str(rng.randrange(3)) if i % 3 else None) for i, c in enumerate(rng.choice(list(kinds)) for _ in range(60))]
    f = spark.createDataFrame(rows, "finding_id string, category string, severity int, ts long, context string, stage_id long, stage_attempt long, executor_id string")
    f = f.withColumns({"sql_execution_id": F.lit(None).cast("long")} | {c: F.lit(None).cast("string") for c in ("run_key", "entity", "evidence", "signal", "fingerprint")})
    tasks = spark.createDataFrame([("c", s, 0, str(e), s * 100_000, (s + 2) * 100_000) for s in range(4) for e in range(3)], "context string, stage_id long, stage_attempt long, executor_id string, launch_ms long, finish_ms long")
    stages = spark.createDataFrame([("c", s, 0, None, 0, 900_000, "x") for s in range(4)], "context string, stage_id long, stage_attempt long, sql_execution_id long, start_ms long, end_ms long, stage_name string")
    executors = spark.createDataFrame([("c", str(e), "h", 0, None) for e in range(3)], "context string, executor_id string, host string, added_ms long, removed_ms long")
    lines = spark.createDataFrame([], "signal string, line string, ts long, context string, executor_id string")
    errors = spark.createDataFrame([], "fingerprint string, message string, ts long, context string, executor_id string, source string, user_frame string")
    found = G.written(N.finding_kinds(f, errors))
    whole, some = (G.written(N.finding_scopes(found, stages, executors, tasks, lines, errors, infer=i)) for i in (None, N.ERRORS))
    assert {r["kind"] for r in some.filter("inferred").collect()} == {"other_error"} < {r["kind"] for r in whole.filter("inferred").collect()}
    assert got(N.problem_members(found, some)) == got(N.problem_members(found, whole))


def test_rules_on_runs_take_no_context_in_one_window(spark):
    rng = random.Random(13)
    rows = [("c", f"r{i}", s, s + rng.randrange(400), "failed") for i, s in enumerate(rng.randrange(9000) for _ in range(90))]
    runs = spark.createDataFrame(rows, "context string, run_key string, start_ms long, end_ms long, status string")
    ups = spark.createDataFrame([("c", 4, 0, None, None)], "context string, cores long, added_ms long, removed_ms long, removal_category string")
    shown = [[got(x.select("rule", "subject", "severity", "n")) for x in AD.run_rules(runs, ups, gap=60, at_once=2, width=w)] for w in (20, 1 << 40)]
    assert shown[0] == shown[1] and all(shown[0])
    assert got(AD.runs_at_once(runs, 100)) == got(AD.runs_at_once(runs, 1 << 40))
    assert "scan parquet" in plan(AD.runs_at_once(runs, 100))  # the buckets' islands, written before those at edges are joined


def test_asof_of_several_kinds_asks_once(spark):
    """a left row is one row for all kinds, not one a kind."""
    rng = random.Random(5)
    left = spark.createDataFrame([(k, i, rng.randrange(300)) for k in "ab" for i in range(40)], "k string, i long, t long")
    right = spark.createDataFrame([(k, rng.choice("xyz"), rng.randrange(300), rng.randrange(9)) for k in "ab" for _ in range(60)], "k string, kind string, u long, v long")
    rows = [tuple(r) for r in right.collect()]
    want = []
    for k, i, t in (tuple(r) for r in left.collect()):
        for kind in "xy":
            last = max(((u, v) for a, b, u, v in rows if a == k and b == kind and u <= t), default=None)
            want += [(k, i, t, kind, *last)] if last else []
    for width in (7, 100, 1000):
        out = J.asof_each(left, right, ["k"], "t", "u", ["u", "v", "kind"], {"__x": F.col("kind") == "x", "__y": F.col("kind") == "y"}, width)
        assert "generate" not in plan(out)
        assert sorted((r["k"], r["i"], r["t"], c["kind"], c["u"], c["v"]) for r in out.collect() for c in r["found"]) == sorted(want)


def test_overlap_join_reads_its_levels_off_the_longest_interval(spark):
    """no cells are made to learn which levels there are; near intervals' cells are those of the general rule."""
    rng = random.Random(6)
    spans = lambda most: [(rng.choice("ab"), s, s + rng.choice((0, 3, 11, 40, most))) for s in (rng.randrange(-200, 2000) for _ in range(150))]
    a, b = spans(900), spans(5)
    left, right = spark.createDataFrame(a, "k string, l_start long, l_end long"), spark.createDataFrame(b, "k string, r_start long, r_end long")
    want = sorted((k, s, e, u, v) for k, s, e in a for j, u, v in b if j == k and max(s, u) <= min(e, v))
    for width in (4, 10, 5000):
        out = I.overlap_join(left, right, ["k"], width, closed=True)
        assert got(out.select("k", "l_start", "l_end", "r_start", "r_end")) == want
        assert "collect_set" not in plan(out)


def test_queue_episodes_are_merged_in_buckets(spark, sf_dir, monkeypatch):
    """no window over all of a context's segments; sums and next instants in one pass."""
    rng = random.Random(7)
    rows = spark.createDataFrame([(k, t, rng.randrange(-3, 4)) for k in "ab" for t in rng.sample(range(500), 90)], "k string, t long, n long")
    want = got(I.segments(I.running_sums(rows, ["k"], "t", ["n"]), ["k"], "t"))
    for width in (None, 9, 100, 1000):
        assert got(I.level_segments(rows, ["k"], "t", ["n"], width).select("k", "t", "n", "until")) == want
    widths, merge = [], I.merge_intervals
    monkeypatch.setattr(I, "merge_intervals", lambda *a: widths.append(a[6] if len(a) > 6 else None) or merge(*a))
    Q.QUERIES["queue_episodes"](spark, sf_dir)
    assert widths and None not in widths[:1]


def test_skewed_tasks_takes_a_stages_figures_once(spark, sf_dir):
    """the stages' medians for slowness come from the pass over their tasks that gives their rows."""
    assert plan(Q.QUERIES["skewed_tasks"](spark, sf_dir)).count("lineitem.parquet") <= 5


def test_errors_are_joined_to_what_ran_once(spark, sf_dir):
    """the pairs of a user are read back for the fallback, not joined again."""
    assert "window" not in plan(Q.QUERIES["interval_error_join"](spark, sf_dir))


def made(df, kind, metric="numOutputRows"):
    """Rows that the plan's nodes of a kind made (or another sum of theirs) when df was collected."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            out += node.metrics().apply(metric).value() if name == kind else 0
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_an_effect_meets_an_executor_once_however_many_stages_it_has(spark):
    rng = random.Random(8)
    on = {f"s{i}": sorted({f"e{k}" for k in range(16)} if i else {"e3", "e99"}) for i in range(40)}
    has = {f"p{i}": sorted(rng.sample(sorted(on), 30)) for i in range(20)}
    effects = spark.createDataFrame([(p, "lost", "stage", s, False, None if p == "p0" else 7, None) for p, of in has.items() for s in of], "effect string, effect_kind string, type string, key string, __ei boolean, ts long, __hosts boolean")
    out = N.ran_on(effects, spark.createDataFrame(list(on.items()), "key string, __es array<string>"))
    want = {(p, e) for p, of in has.items() for s in of for e in on[s]}
    found = [(r["effect"], r["__e"]) for r in out.collect()]
    assert len(found) == len(want) and set(found) == want
    # two sets of executors: an effect's 30 stages are not multiplied by 16
    assert made(out, "Generate") <= 20 * (2 + 16 + 2)


def test_points_ask_spans_one_way(spark):
    rng = random.Random(5)
    points = [(i, rng.choice("ab"), rng.randrange(2000)) for i in range(80)] + [(90, "a", None), (91, None, 5)]
    spans = [(i, rng.choice("ab"), t := rng.randrange(2000), t + rng.choice((-3, 0, 7, 40, 900))) for i in range(120)] + [(200, "a", None, 9), (201, "b", 4, None)]
    p, s = spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(spans, "s long, k string, b long, e long")
    for before, after in ((0, 0), (5, 5), (0, 60)):
        want = sorted((i, j) for i, k, t in points for j, g, b, e in spans if k == g and None not in (k, t, b, e) and b - before <= t <= e + after)
        for width in (1, 16, 5000):
            assert got(I.point_join(p, s, ["k"], "at", "b", "e", width, before, after).select("p", "s")) == want
    none = I.point_join(p, s.limit(0), ["k"], "at", "b", "e", 16)
    assert none.count() == 0


def test_errors_meet_spans_that_end_before_they_begin_as_in_sql_and_move_once(spark, tmp_path):
    """A span of negative length is within the slack of an error; points and spans are not shuffled both ways."""
    con = duckdb.connect()
    rows = [(i, i % 3, f"timestamp '2024-01-01' + interval ({i * 700}) millisecond", ("error", "purchase", "click", "view")[i % 4], (-0.01, 0.005, 2.5, 0.0, -0.02)[i % 5]) for i in range(400)]
    con.execute("create table events as " + " union all ".join(f"select {i}::bigint event_id, {u}::bigint user_id, {t} ts, '{k}' event_type, {v}::double \"value\"" for i, u, t, k, v in rows))
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = Q.QUERIES["interval_error_join"](spark, str(tmp_path))
    assert got(df) == sorted(tuple(r) for r in con.execute(Q.SQL["interval_error_join"]).fetchall())
    spans = I.point_join(spark.range(100).select(F.col("id").alias("at")), spark.range(100).select(F.col("id").alias("b"), (F.col("id") + 1).alias("e")), [], "at", "b", "e", 1000)
    assert len(spans.collect()) == 199 and plan(spans).count("union") == 0


def test_candidate_pairs_of_single_scopes_compare_no_arrays(spark):
    """Pairs of one, several and no scopes against brute force; where all have one, a row's scopes travel as plain values."""
    rng = random.Random(9)
    some = lambda top: rng.choice(([], None, [rng.randrange(top)], [rng.randrange(top)], [rng.randrange(top), None, rng.randrange(top), rng.randrange(top)]))
    rows = [(i, rng.choice(("a", "b", "c")), rng.randrange(50), some(4), some(6)) for i in range(70)] + [(90, "a", None, [1], [1]), (91, None, 3, [1], [1])]
    f = spark.createDataFrame(rows, "id long, kind string, at long, x array<long>, y array<long>")
    rules = spark.createDataFrame([("a", "b", 3), ("a", "b", 2), ("b", "c", 1), ("c", "c", 5)], "cause_kind string, effect_kind string, weight int")
    weight = {("a", "b"): 3, ("b", "c"): 1, ("c", "c"): 5}
    real = lambda s: {v for v in s or [] if v is not None}
    want = []
    for i, k, t, x, y in rows:
        for j, m, u, z, w in rows:
            shared = len(real(x) & real(z)) + len(real(y) & real(w))
            if i != j and (k, m) in weight and shared and None not in (t, u) and t <= u + 10:
                want.append((i, j, weight[k, m] + shared))
    assert got(G.candidate_pairs(f, "id", ["x", "y"], "kind", "at", rules, 10)) == sorted(want)
    conditions = [x for x in plan(G.candidate_pairs(f, "id", ["x", "y"], "kind", "at", rules, 10)).splitlines() if "join [__x" in x]
    assert len(conditions) == 2 and all("case when" in x for x in conditions)


def test_no_votes_are_taken_where_no_finding_has_several_lines(spark, monkeypatch):
    def never(*_):
        raise AssertionError("asked")

    monkeypatch.setattr(N, "matching_lines", never)
    findings = spark.createDataFrame([("a", "oom", "executor_oom", 5, 0), ("b", "oom", "executor_oom", 9, 0), ("c", "lost", "executor_lost", 9, 0)], "finding_id string, kind string, category string, ts long, severity int")
    findings = findings.withColumns({"label": F.col("kind"), "level": F.lit(3)})
    scopes = spark.createDataFrame([(f, None, t, k, "executor", "c|1", False) for f, k, t in (("a", "oom", 5), ("b", "oom", 9), ("c", "lost", 9))], "finding_id string, event long, ts long, kind string, type string, key string, inferred boolean")
    members = N.problem_members(findings, scopes)
    assert got(members) == [("a", "a"), ("b", "a"), ("c", "c")]
    problems, about = N.problems_of(findings, scopes, members)
    assert got(problems.select("problem", "n")) == [("a", 2), ("c", 1)] and got(about.select("problem", "key")) == [("a", "c|1"), ("c", "c|1")]
