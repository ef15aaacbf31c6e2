"""Grouped statistics: lower percentiles, skew, weighted quantiles, bands, shares, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import by_keys

# fixed values: edges of the size bands
MIB = 1024 * 1024
BANDS = (10 * MIB, 128 * MIB, 256 * MIB)
SKEW_FLOOR = 1


def quantile(c: Column | str, q: float, how: str = "lower", where: Column | None = None) -> Column:
    """lower: a value of the column (the first with a share of at least q at or below it); middle: interpolated; approx: bounded memory, for the largest groups."""
    c = F.col(c) if isinstance(c, str) else c
    c = c if where is None else F.when(where, c)
    if how == "approx":
        return F.percentile_approx(c, q)
    name = "percentile_disc" if how == "lower" else "percentile_cont"
    return F.expr(f"{name}({q}) WITHIN GROUP (ORDER BY {_name(c)})")


def _name(c: Column) -> str:
    """The SQL text of a column that is a plain name or an expression."""
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


#: Ranks that the sketch of exact_quantiles may be wrong by, as a share of a group's rows.
RANK_ERROR = 1 / 2000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], error: float = RANK_ERROR) -> DataFrame:
    """keys, n, min, max, avg and a column for each quantile (p50, ...): lower percentiles, as percentile_disc gives them, without a group's values in one buffer.

    A sketch (percentile_approx, which merges map-side and keeps some 1 / error values a group) brackets each quantile's rank between two values. The second pass counts what lies below a
    bracket, and sums rows by value inside it only: some 4 x error of the group's rows, or one value that repeats. Null keys are a group; null values do not count.
    """
    names = [f"p{round(q * 100)}" for q in quantiles]
    edge = lambda q: [min(1.0, max(0.0, q - 2 * error)), min(1.0, q + 2 * error)]
    sketch = F.percentile_approx(value, [x for q in quantiles for x in edge(q)], F.lit(int(1 / error)))
    heads = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), sketch.alias("__s"))
    # the ends of a group stand for themselves, so that no rank falls outside
    lo = [F.when(F.lit(edge(q)[0] <= 0), F.col("min")).otherwise(F.get("__s", 2 * i)) for i, q in enumerate(quantiles)]
    hi = [F.when(F.lit(edge(q)[1] >= 1), F.col("max")).otherwise(F.get("__s", 2 * i + 1)) for i, q in enumerate(quantiles)]
    brackets = heads.select(*keys, *[x.alias(f"__{side}{i}") for i in range(len(names)) for side, x in (("lo", lo[i]), ("hi", hi[i]))])
    v = F.col(value)
    rows = by_keys(df.select(*keys, value).filter(v.isNotNull()), brackets, keys)
    which = F.array_compact(F.array(*[F.when(v < F.col(f"__lo{i}"), F.struct(F.lit(i).alias("i"), F.lit(True).alias("below"), F.lit(None).cast(df.schema[value].dataType).alias("v"))).when(v <= F.col(f"__hi{i}"), F.struct(F.lit(i).alias("i"), F.lit(False).alias("below"), v.alias("v"))) for i in range(len(names))]))
    counts = rows.select(*keys, F.explode(which).alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("__c")).select(*keys, "x.*", "__c")
    order = Window.partitionBy(*keys, "i").orderBy(F.desc("below"), "v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = by_keys(counts.withColumn("__run", F.sum("__c").over(order)), heads.select(*keys, "n"), keys)
    rank = F.greatest(F.ceil(F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("i") + 1) * F.col("n")), F.lit(1))
    found = ranked.filter(~F.col("below") & (F.col("__run") >= rank)).groupBy(*keys).agg(*[F.min(F.when(F.col("i") == i, F.col("v"))).alias(p) for i, p in enumerate(names)])
    return by_keys(heads.drop("__s"), found, keys, "left").select(*keys, "n", "min", *names, "max", "avg")


def distribution(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), how: str = "lower", where: Column | None = None) -> DataFrame:
    """keys, n, min, p10, p50, p90, max, avg of value (of the rows where the condition holds, if given). how: as in quantile, or bracket (exact_quantiles, for groups too large for a buffer)."""
    kept = df if where is None else df.withColumn(value, F.when(where, F.col(value)))
    if how == "bracket":
        return exact_quantiles(kept, keys, value, quantiles)
    cols = [quantile(value, q, how).cast(df.schema[value].dataType).alias(f"p{round(q * 100)}") for q in quantiles]
    return kept.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), *cols, F.max(value).alias("max"), F.avg(value).alias("avg"))


def skew(df: DataFrame, keys: Sequence[str], value: str, how: str = "lower") -> DataFrame:
    """keys, n, p50, max, skew = max / max(p50, 1), to one decimal, half up."""
    d = distribution(df, keys, value, (0.5,), how)
    return d.select(*keys, "n", "p50", "max", F.round(F.col("max") / F.greatest("p50", F.lit(SKEW_FLOOR)), 1).alias("skew"))


def running_weights(df: DataFrame, keys: Sequence[str], value: str, weight: str, splits: int | None = None) -> DataFrame:
    """keys, value, __run (the weight up to the value) and __all; equal values are summed first.

    splits: for keys with too many values for one task (or none at all), values are cut at so many approximate quantiles into parts of about equal size, whose
    totals are summed first; the result is as exact as without.
    """
    per = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    if splits is None:
        w = Window.partitionBy(*keys)
        return per.withColumn("__run", F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__w").over(w))
    per, keys = per.withColumn("__one", F.lit(0)), [*keys, "__one"]
    cuts = per.groupBy(*keys).agg(F.percentile_approx(value, [i / splits for i in range(1, splits)]).alias("__cuts"))
    per = per.join(cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    totals = per.groupBy(*keys, "__part").agg(F.sum("__w").alias("__t"))
    w = Window.partitionBy(*keys)
    totals = totals.withColumn("__all", F.sum("__t").over(w)).withColumn("__before", F.sum("__t").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).drop("__t")
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(totals, [*keys, "__part"]).withColumn("__run", F.sum("__w").over(inside) + F.col("__before")).drop("__part", "__before", "__one")


def weighted_quantile(df: DataFrame, keys: Sequence[str], value: str, weight: str, q: float = 0.5, splits: int | None = None) -> DataFrame:
    """keys, the smallest value whose running weight reaches q of the whole. Equal values are summed first; splits as in running_weights."""
    per = running_weights(df, keys, value, weight, splits)
    return per.filter(F.col("__run") >= q * F.col("__all")).groupBy(*keys).agg(F.min(value).alias(value))


def size_bands(df: DataFrame, keys: Sequence[str], size: str, edges: Sequence[float] = BANDS) -> DataFrame:
    """keys and, for the bands none, under each edge, and the rest: n_<i> and bytes_<i>."""
    band = F.when(F.coalesce(F.col(size), F.lit(0)) <= 0, 0)
    for i, e in enumerate(edges):
        band = band.when(F.col(size) < e, i + 1)
    band = band.otherwise(len(edges) + 1)
    cols = [x for i in range(len(edges) + 2) for x in (F.count_if(band == i).alias(f"n_{i}"), F.sum(F.when(band == i, F.col(size))).alias(f"bytes_{i}"))]
    return df.groupBy(*keys).agg(*cols)


def share(df: DataFrame, group: Sequence[str], part: Sequence[str], value: str) -> DataFrame:
    """group, part, total and its share of the group's total. Totals are taken before the window, which sees a row for each part."""
    per = df.groupBy(*group, *part).agg(F.sum(value).alias("total"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*group)))


def stage_metrics(tasks: DataFrame, keys: Sequence[str], ms: str, failed: str, executor: str, launched: str) -> DataFrame:
    """Of a stage's tasks: attempts, failures, slowest and fastest good task (of all if none is good), executors, first launch."""
    ok = ~F.col(failed)
    best = lambda f, c: F.coalesce(f(F.when(ok, F.col(c))), f(c))
    return tasks.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failed"), best(F.max, ms).alias("max_ms"), best(F.min, ms).alias("min_ms"), F.countDistinct(executor).alias("executors"), F.min(launched).alias("first_launch"), F.sum(F.when(ok, F.col(ms))).alias("good_ms"), F.sum(ms).alias("all_ms"))


def summary(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], distinct: Sequence[str] = (), sample: Sequence[str] = ()) -> DataFrame:
    """keys, n, first and last time, distinct counts, and the sample columns of the earliest row (null times last)."""
    earliest = F.struct(F.col(at).isNull(), at, *order)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"),
        *[F.countDistinct(c).alias(f"n_{c}") for c in distinct], *[F.min_by(c, earliest).alias(c) for c in sample],
    )


def per_bucket(df: DataFrame, at: str, keys: Sequence[str], unit: str = "minute") -> DataFrame:
    """bucket, keys, n; rows without a time are left out."""
    return df.filter(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, at).alias("bucket"), *keys).agg(F.count("*").alias("n"))


def facets(df: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """value, n of a column (of its elements, if it is a list), most frequent first; a top report of `limit` rows."""
    value = F.explode_outer(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(limit)


def column_stats(df: DataFrame, columns: Sequence[str], splits: int = 64) -> DataFrame:
    """A row for each numeric column: column, n, n_null, min, p50, p90, max, sum.

    One scan; values are counted before they move, and no task sees more than a part of a column's different values.
    """
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = each.groupBy("column", "v").agg(F.count("*").alias("n"))
    present = F.col("v").isNotNull()
    sums = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("n")).alias("sum"),
    )
    run = running_weights(counts.filter(present), ["column"], "v", "n", splits)
    at = lambda q: F.min(F.when(F.col("__run") >= q * F.col("__all"), F.col("v")))
    return sums.join(run.groupBy("column").agg(at(0.5).alias("p50"), at(0.9).alias("p90")), "column", "left")


def typical(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, previous: int = 10, at_least: int = 2) -> DataFrame:
    """df with typical: the lower median of up to so many earlier values of the keys, null with fewer than at_least."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-previous, -1)
    seen = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn("typical", F.when(F.size(seen) >= at_least, F.get(seen, (F.ceil(F.size(seen) / 2) - 1).cast("int"))))


def cause_split(total: Column, parts: dict[str, Column]) -> list[Column]:
    """Each part capped by what the ones before left of the total, and other, the rest; none below zero."""
    out, left = [], total
    for name, c in parts.items():
        own = F.greatest(F.lit(0.0), F.least(c, left))
        out.append(own.alias(name))
        left = left - own
    return [*out, left.alias("other")]


def mode(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """keys and the value with the greatest weight (count), the least of equals."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("__w"))
    return per.groupBy(*keys).agg(F.min(F.struct((-F.col("__w")).alias("w"), F.col(value))).alias("__m")).select(*keys, F.col(f"__m.{value}").alias(value))


def top_executors_text(df: DataFrame, keys: Sequence[str], who: str, value: str, limit: int = 3) -> DataFrame:
    """keys, top (the one with most of value), shares: "a 60%, b 30%" of the largest."""
    s = share(df, keys, [who], value)
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), who)
    ranked = s.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", F.format_string("%s %.0f%%", F.col(who).cast("string"), F.col("share") * 100).alias("t")))), lambda x: x["t"]), ", ")
    return ranked.groupBy(*keys).agg(F.min_by(who, "__r").alias("top"), text.alias("shares"))


def slowness(tasks: DataFrame, stage: Sequence[str], executor: str, ms: str, per_stage: DataFrame | None = None) -> DataFrame:
    """executor, slowness: the median over stages of (its median there / the stage's median), interpolated. per_stage: the stages' medians as __stage, where they are known."""
    if per_stage is None:
        per_stage = tasks.groupBy(*stage).agg(F.median(ms).alias("__stage"))
    per = tasks.groupBy(*stage, executor).agg(F.median(ms).alias("__own")).join(per_stage, list(stage)).filter("__stage > 0")
    return per.groupBy(executor).agg(F.median(F.col("__own") / F.col("__stage")).alias("slowness"))


def pivot_first(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], kind: str, at: str, kinds: Sequence[str]) -> DataFrame:
    """One row a key: the first value that is not null of each column in order, and the earliest time of each kind of event."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*first, *[F.min(F.when(F.col(kind) == k, F.col(at))).alias(f"{k}_time") for k in kinds])


def log_statistics(lines: DataFrame, keys: Sequence[str], at: str, full_gc: Column, heap: str) -> DataFrame:
    """keys, lines, errors, warnings (continuation lines are no records), first, last, full_gcs and the largest heap. lines: level, continuation."""
    record = ~F.coalesce(F.col("continuation"), F.lit(False))
    return lines.groupBy(*keys).agg(
        F.count("*").alias("lines"), F.count_if(record & F.col("level").isin("ERROR", "FATAL")).alias("errors"), F.count_if(record & F.col("level").isin("WARN", "WARNING")).alias("warnings"),
        F.min(at).alias("first"), F.max(at).alias("last"), F.count_if(F.coalesce(full_gc, F.lit(False))).alias("full_gcs"), F.max(heap).alias("max_heap"),
    )
