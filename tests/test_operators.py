"""Operators on small tables: values worked out by hand, empty tables, nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagelens.functions import text as T
from stagelens.operators import aggregates as A
from stagelens.operators import findings as FI
from stagelens.operators import graph as G
from stagelens.operators import intervals as I
from stagelens.operators import joins as J
from stagelens.operators import windows as W


def got(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_lower_percentiles(spark):
    df = spark.createDataFrame([("a", x) for x in range(1, 11)] + [("b", 1), ("b", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert got(A.distribution(df, ["k"], "v").select("k", "p10", "p50", "p90")) == [("a", 1, 5, 9), ("b", 1, 2, 4)]


def test_distribution_where_and_empty(spark):
    df = spark.createDataFrame([("a", 5, True), ("a", 9, False)], "k string, v int, ok boolean")
    assert got(A.distribution(df, ["k"], "v", where=F.col("ok")).select("n", "max")) == [(1, 5)]
    assert got(A.distribution(df.limit(0), ["k"], "v")) == []


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 1), ("a", 9, 8)], "k string, v int, w int")
    assert got(A.weighted_quantile(df, ["k"], "v", "w")) == [("a", 9)]


def test_cause_split_caps(spark):
    df = spark.createDataFrame([(10.0, 8.0, 5.0)], "t double, a double, b double")
    assert got(df.select(*A.cause_split(F.col("t"), {"x": F.col("a"), "y": F.col("b")}))) == [(8.0, 2.0, 0.0)]


SPANS = [("x", 0, 10), ("x", 5, 8), ("x", 12, 20), ("x", 30, 31), ("y", 3, 3)]


def test_merge_with_gap(spark):
    df = spark.createDataFrame(SPANS, "k string, s long, e long")
    assert got(I.merge_intervals(df, ["k"], "s", "e", 2)) == [("x", 0, 20, 3), ("x", 30, 31, 1), ("y", 3, 3, 1)]
    assert got(I.union_length(df, ["k"], "s", "e")) == [("x", 19), ("y", 0)]
    assert got(I.merge_intervals(df.limit(0), ["k"], "s", "e")) == []


def test_subtract(spark):
    a = spark.createDataFrame([("x", 0, 10), ("x", 10, 20)], "k string, s long, e long")
    b = spark.createDataFrame([("x", 3, 5), ("x", 18, 30)], "k string, s long, e long")
    assert got(I.subtract_intervals(a, b, ["k"], "s", "e")) == [("x", 0, 3), ("x", 5, 18)]


@pytest.mark.parametrize("width", [None, 7])
def test_peak_and_tie_order(spark, width):
    df = spark.createDataFrame([("x", 0, 10), ("x", 10, 20), ("x", 12, 20)], "k string, s long, e long")
    assert got(I.peak(df, ["k"], "s", "e", width=width)) == [("x", 2, 12)]
    two = df.filter("s < 12")
    assert got(I.peak(two, ["k"], "s", "e", width=width)) == [("x", 1, 0)]
    assert got(I.peak(two, ["k"], "s", "e", starts_first=True, width=width)) == [("x", 2, 10)]


@pytest.mark.parametrize("width", [None, 4])
def test_capacity(spark, width):
    df = spark.createDataFrame([("x", 0, 10), ("x", 0, 10), ("x", 5, 10)], "k string, s long, e long")
    totals = I.capacity_totals(I.capacity_sweep(df, ["k"], "s", "e", 2, width), ["k"], 2)
    assert got(totals) == [("x", 10, 5, 20, 5, 3)]


def test_bucket_spread(spark):
    df = spark.createDataFrame([("x", 5, 25, 20.0), ("x", 7, 7, 3.0)], "k string, s long, e long, v double")
    assert got(I.bucket_spread(df, ["k"], "s", "e", ["v"], 10)) == [("x", 0, 1, 8.0), ("x", 1, 0, 10.0), ("x", 2, 1, 5.0)]


def test_overlap_join_once(spark):
    a = spark.createDataFrame([("x", 0, 100)], "k string, l_start long, l_end long")
    b = spark.createDataFrame([("x", 50, 200), ("x", 100, 120), ("y", 0, 9)], "k string, r_start long, r_end long")
    assert got(I.overlap_join(a, b, ["k"], 10).select("r_start")) == [(50,)]
    assert got(I.overlap_join(a, b, ["k"], 10, closed=True).select("r_start")) == [(50,), (100,)]


def test_asof(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("z", 9)], "k string, t long")
    right = spark.createDataFrame([("x", 2, "a"), ("x", 5, "b"), ("x", 7, "c")], "k string, u long, v string")
    assert got(J.asof_join(left, right, ["k"], "t", "u", ["v"]).fillna("-")) == [("x", 1, "-"), ("x", 5, "b"), ("z", 9, "-")]
    assert got(J.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True).fillna("-")) == [("x", 1, "-"), ("x", 5, "a"), ("z", 9, "-")]
    assert got(J.asof_join(left, right, ["k"], "t", "u", ["v"], forward=True).fillna("-")) == [("x", 1, "a"), ("x", 5, "b"), ("z", 9, "-")]
    assert got(J.asof_join(left, right, ["k"], "t", "u", ["v"], forward=True, strict=True).fillna("-")) == [("x", 1, "a"), ("x", 5, "c"), ("z", 9, "-")]


def test_start_end_first_start_wins(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id int, seq int, name string")
    e = spark.createDataFrame([(1, 5, None, "ok"), (2, 6, "late", "ok")], "id int, seq int, name string, status string")
    assert got(J.start_end(s, e, ["id"], "seq").drop("seq")) == [(1, "a", "ok"), (2, "late", "ok")]


def test_components_and_roots(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9)], "a long, b long")
    assert got(G.connected_components(e, "a", "b")) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    best = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "effect string, cause string")
    assert got(G.follow_roots(best, "effect", "cause")) == [("b", "a", 1), ("c", "a", 2), ("d", "a", 3)]


def test_candidate_pairs(spark):
    f = spark.createDataFrame([("F1", "oom", 10, ["1"], ["e1"]), ("F2", "lost", 20, ["1"], ["e1"]), ("F3", "lost", 5, ["2"], ["e9"])], "id string, kind string, at long, stages array<string>, executors array<string>")
    rules = spark.createDataFrame([("oom", "lost", 5)], "cause_kind string, effect_kind string, weight int")
    assert got(G.candidate_pairs(f, "id", ["stages", "executors"], "kind", "at", rules, 1000)) == [("F1", "F2", 7)]


def test_exception_groups(spark):
    lines = ["24/01/01 00:00:00 ERROR x: boom", "java.lang.IllegalStateException: bad", "\tat a.b(C.java:1)", "\tat d.e(F.java:2)", "Caused by: java.io.IOException: io", "\tat g.h(I.java:3)", "", '"main" #1 prio=5 tid=1', "\tat not.a(Frame.java:1)", "java.lang.NotInDump: x"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq long, line string")
    out = W.exception_groups(df, "file", "seq", "line", T.EXCEPTION, T.FRAME, T.DUMP_HEADER, F.col("line").rlike(T.LOG4J))
    assert got(out) == [("f", 1, "java.lang.IllegalStateException", "bad", ["at a.b(C.java:1)", "at d.e(F.java:2)"]), ("f", 4, "java.io.IOException", "io", ["at g.h(I.java:3)"])]


def test_retries(spark):
    df = spark.createDataFrame([("s", 1, 0, 5, True, "lost"), ("s", 2, 8, 9, False, None), ("t", 1, 0, 1, False, None)], "k string, n int, s long, e long, bad boolean, why string")
    assert got(W.retries(df, ["k"], ["n"], "s", "e", "bad", "why")) == [("s", 2, 1, "lost", 3, 5, "recovered")]


def test_where_equal(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, [])], "n int, s string, l array<string>")
    assert got(W.where_equal(df, {"s": None}).select("n")) == [(2,)]
    assert got(W.where_equal(df, {"l": "x"}).select("n")) == [(1,)]
    assert got(W.where_equal(df, {"n": "no number"}).select("n")) == []
    assert got(W.where_equal(df, {"n": [1, 2]}).select("n")) == [(1,), (2,)]


def test_natural_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), (None,)], "c string")
    assert [r[0] for r in df.orderBy(*W.natural_order("c")).collect()] == ["9", "10", "b", None]


def test_prefix_forms(spark):
    p = one(spark, "24/03/01 10:20:30 WARN a.B: hello", T.log_prefix)
    assert (p["ts"], p["level"], p["logger"], p["message"], p["kind"]) == (dt.datetime(2024, 3, 1, 10, 20, 30), "WARN", "a.B", "hello", "log4j")
    assert one(spark, "24/13/01 10:20:30 WARN a.B: hello", T.log_prefix)["ts"] is None
    p = one(spark, "2024-03-01 10:20:30,5 ERROR oops", T.log_prefix)
    assert (p["level"], p["message"], p["kind"]) == ("ERROR", "oops", "iso")
    p = one(spark, "[2024-03-01T10:20:30.123+0000][1.5s][info][gc] GC(3) Pause Young (Normal) 10M->5M(20M) 1.5ms", T.log_prefix)
    assert (p["logger"], p["kind"]) == ("gc", "jvm")
    assert one(spark, "\tat x.y", T.log_prefix)["kind"] is None


def test_gc_lines(spark):
    g = one(spark, "GC(3) Pause Young (Normal) (G1 Evacuation Pause) 1024K->512K(2G) 1.5ms", T.gc_event)
    assert tuple(g) == (3, "Pause Young", "Normal, G1 Evacuation Pause", 1.0, 0.5, 2048.0, 1.5)
    g = one(spark, "1.0: [Full GC (Ergonomics) [PSYoungGen: 1K->0K(2K)] 2048K->1024K(4096K)], 0.25 secs]", T.gc_event)
    assert g["kind"] == "Pause Full" and g["pause_ms"] == 250.0


@pytest.mark.parametrize(("text", "want"), [("Container killed by YARN for exceeding memory limits", "oom"), ("exit code 137", "oom"), ("exited with code 9", "killed"), ("heartbeat timed out", "lost"), ("idle for 60 s", "autoscale"), ("hm", "other"), (None, None)])
def test_removal(spark, text, want):
    assert one(spark, text, T.removal_category) == want


@pytest.mark.parametrize(("text", "want"), [("4g", 4 << 30), ("128MB", 128 << 20), ("1.5 KiB", 1536), ("7", 7), ("x", None), (None, None)])
def test_sizes(spark, text, want):
    assert one(spark, text, T.parse_size) == want


@pytest.mark.parametrize(("text", "want"), [("1h 5m", 3_900_000), ("300s", 300_000), ("20ms", 20), ("x5", None)])
def test_durations(spark, text, want):
    assert one(spark, text, T.parse_duration) == want


def test_identities(spark):
    assert one(spark, "SELECT * FROM  T WHERE a = 'x''y' AND b = 12.5", T.query_key) == "select * from t where a = ? and b = ?"
    assert one(spark, "alter table `a`.`b` add column c int", T.ddl_shape) == one(spark, "ALTER TABLE x.y ADD COLUMN d int", T.ddl_shape)
    assert one(spark, "select 1", T.ddl_shape) is None
    frames = lambda n: F.array(F.lit(f"at a.b(C.java:{n})"))
    a, b = (spark.range(1).select(T.fingerprint(F.lit("E"), frames(n))).first()[0] for n in (1, 99))
    assert a == b and len(a) == 12


def test_failure_and_oom(spark):
    df = spark.createDataFrame([("ExceptionFailure", "java.lang.OutOfMemoryError", None), ("ExecutorLostFailure", "exit code 137", None), ("TaskKilled", "another attempt succeeded", None), ("FetchFailed", None, None)], "r string, e string, c string")
    assert [r[0] for r in df.select(T.failure_category(F.col("r"), F.col("e"), F.col("c"))).collect()] == ["oom", "oom", "other", "fetch_failed"]
    site = spark.range(1).select(T.oom_site(F.array(F.lit("x.y"), F.lit("o.a.s.UnsafeExternalSorter.insert")), F.lit("toPandas"))).first()[0]
    assert site == "sort_aggregate"


def test_stage_rules(spark):
    cols = "stage long, failure_reason string, replanned boolean, skew double, max_task_ms long, disk_spill long, gc_ms long, task_ms long, failed_tasks long, tasks long, p50_task_ms long, p50_read_bytes long, duration_ms long, shuffle_read long, input_bytes long"
    df = spark.createDataFrame([(1, None, None, 12.0, 400_000, 0, 0, 10, 0, 5, 900, 0, 1000, 0, 0), (2, "x", True, 1.0, 5, 2 << 30, 30_000, 100_000, 3, 3000, 100, 0, 10, 0, 0)], cols)
    found = FI.detect(df, FI.stage_rules(FI.Thresholds()), F.col("stage"))
    assert got(found.select("entity", "category", "severity")) == [(1, "task_skew", 0), (2, "disk_spill", 1), (2, "gc_pressure", 2), (2, "tiny_tasks", 2)]
    assert got(FI.counts(found, ["entity"])) == [(1, 1, 0, 0), (2, 0, 1, 2)]
