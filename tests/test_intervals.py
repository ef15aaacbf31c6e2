"""Two-level islands and the segment-tree interval join: equal to the plain forms under any width, and bounded copies."""

import random

import pytest
from pyspark.sql import functions as F

from stagelens.operators import intervals as I

WIDTHS = [7, 50]


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(3)
    rows = [(k, s, s + rng.choice([0, 1, 3, 20, 200]), rng.randrange(5)) for k in (None, "a", "b") for s in (rng.randrange(600) for _ in range(60))]
    return spark.createDataFrame([*rows, ("c", 5, 900, 1), ("c", 0, 1, 1)], "k string, s long, e long, v long").repartition(3).persist()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("gap", [0, 4])
def test_islands_in_two_levels(spans, width, gap):
    assert rows(I.merge_intervals(spans, ["k"], "s", "e", gap, ["v"], width)) == rows(I.merge_intervals(spans, ["k"], "s", "e", gap, ["v"]))


def test_islands_of_one_giant_key(spans):
    assert rows(I.merge_intervals(spans, [], "s", "e", 2, width=40)) == rows(I.merge_intervals(spans, [], "s", "e", 2))
    assert rows(I.union_length(spans, ["k"], "s", "e", 30)) == rows(I.union_length(spans, ["k"], "s", "e"))


@pytest.mark.parametrize("width", [30])
def test_subtraction_in_two_levels(spans, width):
    a, b = spans.filter("v > 1"), spans.filter("v <= 1")
    assert rows(I.subtract_intervals(a, b, ["k"], "s", "e", width)) == rows(I.subtract_intervals(a, b, ["k"], "s", "e"))


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("width", [1, 40])
def test_join_against_all_pairs(spans, width, closed):
    left, right = spans.select("k", F.col("s").alias("l_start"), F.col("e").alias("l_end"), F.col("v").alias("l")), spans.filter("v < 3").select("k", F.col("s").alias("r_start"), F.col("e").alias("r_end"), F.col("v").alias("r"))
    got = I.overlap_join(left, right, ["k"], width, closed)
    every = [(a, b) for a in left.collect() for b in right.collect() if a["k"] is not None and a["k"] == b["k"]]
    meets = lambda a, b: (lambda lo, hi: lo <= hi if closed else lo < hi)(max(a["l_start"], b["r_start"]), min(a["l_end"], b["r_end"]))
    want = sorted(((a["k"], a["l_start"], a["l_end"], a["l"], b["r_start"], b["r_end"], b["r"]) for a, b in every if meets(a, b)), key=str)
    assert rows(got.select("k", "l_start", "l_end", "l", "r_start", "r_end", "r")) == want


def test_copies_of_long_intervals(spark):
    """A span of 2^k units takes 2 k cells at most, and the cells are its units, each once."""
    rng = random.Random(1)
    some = [(a, a + n) for a, n in ((rng.randrange(10**6), rng.randrange(1, 1 << rng.randrange(1, 12))) for _ in range(80))] + [(0, 31_536_000), (5, 5)]
    df = spark.createDataFrame(some, "s long, e long").withColumn("cells", I.dyadic_cells(F.col("s"), F.col("e"), 1))
    for s, e, cells in df.collect():
        units = e - s + 1
        assert len(cells) <= 2 * max(1, units.bit_length())
        if units < 5000:
            assert sorted(u for c in cells for u in range(c["place"] << c["level"], (c["place"] + 1) << c["level"])) == list(range(s, e + 1))
