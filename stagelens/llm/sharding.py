"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to logical partitions by a hash of their content. How many rows of partition p go to target t is drawn from
the multivariate hypergeometric law given the partitions' counts and the targets' exact sizes, so that the outcome is that of
a uniform permutation of all rows. Each partition permutes its rows locally, sends them by its matrix row, and each target
permutes what it got.

No task draws the whole matrix and the driver holds none of it: partitions form a binary tree, each split of which has a
generator of its own, and a partition draws its row by walking from the root to its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table

#: numpy's hypergeometric sampler takes counts below this; hypergeometric() draws above it.
EXACT_BELOW = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, reach: float = 9, at_once: int = 1 << 20) -> int:
    """How many of n drawn without replacement from good + bad are good, for counts of any size: the law's ratios are summed from its mode on, over all
    values within reach standard deviations (beyond them lies less than double precision can tell), and inverted."""
    if max(good, bad) < EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    lo, hi = max(lo, mode - int(reach * sd) - 20), min(hi, mode + int(reach * sd) + 20)

    def weights(up: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(first value, weights relative to the mode's) of the values above the mode, or of it and those below, downwards."""
        at, log = mode, 0.0
        if not up:
            yield mode, np.ones(1)
        while at < hi if up else at > lo:
            m = min(at_once, hi - at if up else at - lo)
            x = (at + np.arange(m) if up else at - 1 - np.arange(m)).astype(np.float64)  # the ratio of x + 1 to x
            step = np.log((good - x) / (x + 1)) + np.log((n - x) / (bad - n + x + 1))
            logs = log + np.cumsum(step if up else -step)
            yield (at + 1 if up else at - 1), np.exp(logs)
            at, log = (at + m, float(logs[-1])) if up else (at - m, float(logs[-1]))

    sides = {up: sum(float(w.sum()) for _, w in weights(up)) for up in (True, False)}
    u = rng.random() * (sides[True] + sides[False])
    up = u >= sides[False]
    u -= sides[False] if up else 0
    value = mode
    for first, w in weights(up):
        c = np.cumsum(w)
        i = int(np.searchsorted(c, u, side="right"))
        value = first + (min(i, len(w) - 1) if up else -min(i, len(w) - 1))
        if i < len(w):
            break
        u -= float(c[-1])
    return value


def _take(rng: np.random.Generator, capacity: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn without replacement fall to each target."""
    total = int(capacity.sum())
    if total < EXACT_BELOW:
        return rng.multivariate_hypergeometric(capacity, n, method="marginals")
    out = np.zeros_like(capacity)
    for i, c in enumerate(capacity.tolist()):  # one target after the other
        if c and n:
            out[i] = hypergeometric(rng, c, total - c, n)
        n, total = n - int(out[i]), total - c
    return out


def matrix_row(p: int, ends: np.ndarray, targets: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the communication matrix; ends are the running sums of the partitions' counts, with a leading 0."""
    lo, hi, capacity = 0, len(ends) - 1, targets
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _take(np.random.default_rng([seed, lo, hi]), capacity, int(ends[mid] - ends[lo]))
        lo, hi, capacity = (lo, mid, left) if p < mid else (mid, hi, capacity - left)
    return capacity


def uniform_shards(df: DataFrame, n_shards: int, by: list[str], seed: int = 17, rows_per_task: int = 20_000, max_targets: int = 65_536, max_parts: int = 131_072) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) to the rows of df.

    by: columns whose values identify a row; equal rows are interchangeable, so their order has no effect. Shards' row counts
    differ by one at most. A large shard is made of several targets of equal size, so that no task permutes a whole shard. The driver sees one number
    for each of at most max_parts partitions; beyond max_parts * rows_per_task rows the sorts of a task grow (and spill).
    Nulls in by are values like any other; an empty df gives an empty result. Columns shard and slot of df are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    kept = df.columns
    n = df.count()
    parts = min(pieces(n, rows_per_task), max_parts)
    subs = min(pieces(n, rows_per_task * n_shards), max(1, max_targets // n_shards))
    dealt = df.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(parts)).cast("int"))
    counts = np.zeros(parts, dtype=np.int64)
    for p, c in dealt.groupBy("__p").count().collect():  # one number for each partition
        counts[p] = c
    ends = np.concatenate([[0], np.cumsum(counts)])
    shard_rows = np.full(n_shards, n // n_shards) + (np.arange(n_shards) < n % n_shards)
    targets = (shard_rows[:, None] // subs + (np.arange(subs) < (shard_rows % subs)[:, None])).ravel().astype(np.int64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["id"]:
                goes = np.repeat(np.arange(len(targets), dtype=np.int32), matrix_row(int(p), ends, targets, seed))
                yield pd.DataFrame({"__p": [np.int32(p)], "__goes": [goes]})

    # a number for each row of df in all: it goes to the rows, never through the driver
    matrix = spark.range(0, parts, 1, min(parts, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(rows, "__p int, __goes array<int>").hint("merge")
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), *by), *by)
    sent = dealt.withColumn("__r", F.row_number().over(local)).join(matrix, "__p").withColumn("__t", F.element_at("__goes", F.col("__r"))).drop("__goes", "__r", "__p")
    again = Window.partitionBy("__t").orderBy(F.xxhash64(F.lit(seed + 2), *by), *by)
    shard, sub = F.floor(F.col("__t") / F.lit(subs)).cast("int"), F.col("__t") % F.lit(subs)
    size = F.lit(n // n_shards) + F.when(F.col("shard") < F.lit(n % n_shards), 1).otherwise(0)
    return (
        sent.withColumn("__k", F.row_number().over(again) - 1)
        .withColumn("shard", shard)
        .withColumn("__n", size.cast("long"))
        .withColumn("slot", (sub * F.floor(F.col("__n") / subs) + F.least(sub, F.col("__n") % subs) + F.col("__k")).cast("long"))
        .select(*kept, "shard", "slot")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards; the law is `rows`. A null text is as an empty one: size 1, CRC 0."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = uniform_shards(docs, 8, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
