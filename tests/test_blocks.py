"""Giant files in blocks and giant groups by brackets: the same rows as the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from stagelens.operators import aggregates as A
from stagelens.operators import windows as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(2)
    kinds = ["java.lang.IllegalStateException: bad", "\tat app.Main.run(Main.java:1)", "\tat app.Other.go(Other.java:2)", "plain", "", "Full thread dump", "INFO x", "Caused by: java.io.IOException: more"]
    some = [(f, i, rng.choice(kinds), rng.choice([None, None, 1, 2])) for f in ("a", "b", None) for i in range(60)]
    return spark.createDataFrame(some, "file string, seq long, line string, v long").repartition(3).persist()


@pytest.mark.parametrize("width", [7, 20])
def test_a_file_in_blocks_is_as_in_one(lines, width):
    assert rows(W.forward_fill(lines, ["file"], ["seq"], ["v"], width)) == rows(W.forward_fill(lines, ["file"], ["seq"], ["v"]))
    boundary = F.col("line").rlike("^INFO|^java")
    assert rows(W.inherit(lines, ["file"], ["seq"], boundary, ["v", "line"], width)) == rows(W.inherit(lines, ["file"], ["seq"], boundary, ["v", "line"]))
    opens = F.col("line") == "plain"
    assert rows(W.sessions(lines, ["file"], ["seq"], opens, width)) == rows(W.sessions(lines, ["file"], ["seq"], opens))
    groups = lambda w: rows(W.exception_groups(lines, "file", "seq", "line", r"^([\w.]+Exception)(?:: (.*))?", r"^\s+at ", "^Full thread dump", F.col("line").rlike("^INFO"), width=w))
    assert groups(width) == groups(None) != []


def test_a_group_over_the_edge_of_a_block(spark):
    text = ["x", "a.BException: m", "\tat f1", "\tat f2", "\tat f3", "", "y"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, seq long, line string")
    got = W.exception_groups(df, "file", "seq", "line", r"^([\w.]+Exception)(?:: (.*))?", r"^\s+at ", "^dump", F.lit(False), width=2).collect()
    assert [(r["seq"], r["exception"], r["message"], r["frames"]) for r in got] == [(1, "a.BException", "m", ["at f1", "at f2", "at f3"])]


@pytest.mark.parametrize("error", [1 / 2000, 1 / 10])
def test_brackets_give_exact_percentiles(spark, error):
    """Skewed, repeated, single and null values; a rough sketch gives the same."""
    rng = random.Random(5)
    some = [(k, rng.choice([v, 7, None])) for k, n in (("a", 400), (None, 90), ("one", 1), ("same", 30)) for v in (rng.randrange(1000) ** 2 if k != "same" else 3 for _ in range(n))] + [("none", None)] * 3 + [("two", 1), ("two", 2)]
    df = spark.createDataFrame(some, "k string, v long").repartition(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = A.exact_quantiles(df, ["k"], "v", qs, error)
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("min"), *[F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY v) AS BIGINT)").alias(f"p{round(q * 100)}") for q in qs], F.max("v").alias("max"), F.avg("v").alias("avg"))
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(A.distribution(df, ["k"], "v", how="bracket")) == rows(A.distribution(df, ["k"], "v"))
    assert rows(A.exact_quantiles(df, [], "v", [0.5])) == rows(df.agg(F.count("v"), F.min("v"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS BIGINT)"), F.max("v"), F.avg("v")))


def test_numbers_over_all_rows(spark):
    """Ties end in a key; nulls first or last as ordered; a deep page is the same as a sorted one."""
    rng = random.Random(8)
    some = [(i, rng.choice([None, 1, 2, 3, 3, 3])) for i in range(500)]
    df = spark.createDataFrame(some, "id long, v long").repartition(7)
    got = {r["id"]: r["n"] for r in W.numbered(df, [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    want = sorted(some, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    order = [F.col("v"), F.col("id")]
    assert rows(W.page(df, order, 20, 333, deep=100)) == rows(W.page(df, order, 20, 333))
    assert W.numbered(df.limit(0), order).count() == 0
    assert sorted(r["id2"] for r in W.ranked_ids(df.select(F.col("id").alias("k")), [F.col("k")]).select(F.col("id").alias("id2")).collect())[::499] == ["F001", "F500"]


@pytest.mark.parametrize("seed", [1, 2])
def test_first_candidates_against_all_pairs(spark, seed):
    """A hot scope (a third of the rows), rows without a scope or value, ties in the order; a row is no candidate of its own."""
    from stagelens.operators import joins as J

    rng = random.Random(seed)
    some = [(i, rng.choice(["hot", "hot", "x", "y", "z", None]), rng.choice(["p", "q", "r", None]), rng.randrange(6)) for i in range(120)]
    df = spark.createDataFrame(some, "id long, scope string, run string, cost long").repartition(5)
    groups = [J.Candidates(0, ["scope"], 3, differs="run"), J.Candidates(1, ["scope", "run"], 2), J.Candidates(2, ["scope"], 4)]
    got = sorted(tuple(r) for r in J.ranked_candidates(df, df, "id", ["cost"], groups).select("id", "group", "rank", "c_id").collect())
    want = []
    for i, scope, run, _ in some:
        mine = [r for r in some if scope is not None and r[1] == scope and r[0] != i]
        kinds = ([r for r in mine if r[2] is None or run is None or r[2] != run], [r for r in mine if r[2] is not None and r[2] == run], mine)
        for g, rows_, cap in zip((0, 1, 2), kinds, (3, 2, 4), strict=True):
            want += [(i, g, k + 1, r[0]) for k, r in enumerate(sorted(rows_, key=lambda r: (r[3], r[0]))[:cap])]
    assert got == sorted(want)


def test_heap_of_executors_that_are_up(spark):
    from stagelens.operators import intervals as I

    gc = [("c", "1", 10, 50, 100), ("c", "1", 15, 60, 100), ("c", "2", 12, 30, 0), ("c", None, 31, 20, 40), ("c", "1", 45, 10, 100), ("c", "3", 5, None, 100), ("c", "4", None, 5, 100)]
    up = [("c", "1", 20, 39, 80), ("c", "2", 0, None, None)]
    got = I.heap_use(spark.createDataFrame(gc, "context string, executor_id string, ts_ms long, after_mb long, total_mb long"), spark.createDataFrame(up, "context string, executor_id string, added_ms long, removed_ms long, heap_mb long"), 10)
    assert rows(got) == rows(spark.createDataFrame([("c", 20, 60, 80, 0.75, 0.75, "1", None), ("c", 30, 60, 80, 0.75, 0.75, "1", 0.5), ("c", 40, None, None, None, None, None, 0.5)], got.schema))
