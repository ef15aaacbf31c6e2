"""Operators on intervals [start, end) given as numbers (milliseconds): merging, subtraction, sweeps, buckets.

Sweeps work on changes summed per instant, so their input is never larger than the number of distinct instants. A running sum over one giant key is
taken in two levels: totals of time buckets first (few rows), then within each bucket on its own. What both levels read is written once, to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

ALL_BEFORE = (Window.unboundedPreceding, -1)
TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the other columns of the right rows of equal keys (null ones are equal too)."""
    other = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return left.join(other, same, how).drop(*[f"__key_{k}" for k in keys])


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, sums: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """keys, start, end, n and sums of each island: a new one begins where start is past the greatest end so far plus gap.

    width: for keys with too many rows for one task. Time is cut into buckets of starts; the islands of a bucket come first, each in a task of its own. An island is
    closed inside its bucket if it is neither the first, which an earlier end may reach, nor one that a later bucket's may: a running greatest end over
    the buckets' summaries (one row a bucket) tells which of them go on, and only islands at edges are merged again.
    """
    if width is None:
        order = Window.partitionBy(*keys).orderBy(start, end)
        fresh = F.coalesce((F.col(start) > F.max(end).over(order.rowsBetween(*ALL_BEFORE)) + gap).cast("int"), F.lit(1))
        marked = df.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(*TO_HERE)))
        return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).drop("__island")
    inner = written(merge_intervals(df.withColumn("__b", F.floor(F.col(start) / width)), [*keys, "__b"], start, end, gap, sums))
    edges = inner.groupBy(*keys, "__b").agg(F.min(start).alias("__first"), F.max(end).alias("__reach"))
    over = Window.partitionBy(*keys).orderBy("__b")
    edges = edges.withColumn("__before", F.max("__reach").over(over.rowsBetween(*ALL_BEFORE))).withColumn("__after", F.lead("__first").over(over)).drop("__first", "__reach")
    inner = by_keys(inner, edges, [*keys, "__b"])
    # reached from before, or reaching the next bucket's first start: stitched; the rest are whole
    open_ = F.coalesce(F.col(start) <= F.col("__before") + gap, F.lit(False)) | F.coalesce(F.col(end) + gap >= F.col("__after"), F.lit(False))
    inner = inner.withColumn("__open", open_).drop("__before", "__after", "__b")
    columns = [*keys, start, end, "n", *sums]
    stitched = merge_intervals(inner.filter("__open").withColumnRenamed("n", "__n"), keys, start, end, gap, ["__n", *sums]).drop("n").withColumnRenamed("__n", "n")
    return inner.filter("NOT __open").select(*columns).unionByName(stitched.select(*columns))


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """keys, covered: the time that at least one interval covers."""
    return merge_intervals(df, keys, start, end, width=width).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def changes(df: DataFrame, keys: Sequence[str], start: str, end: str, values: dict[str, Column]) -> DataFrame:
    """keys, t and, for each value, its sum of starts minus ends at t. Intervals without length change nothing."""
    return change_rows(df, keys, start, end, values).groupBy(*keys, "t").agg(*[F.sum(k).alias(k) for k in values])


def change_rows(df: DataFrame, keys: Sequence[str], start: str, end: str, values: dict[str, Column]) -> DataFrame:
    """changes before they are summed: each interval's two rows."""
    own = df.filter(F.col(end) > F.col(start)).select(*keys, start, end, *[v.alias(k) for k, v in values.items()])
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("s")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("s")))
    rows = own.select(*keys, *values, F.explode(ends).alias("__e"))
    return rows.select(*keys, F.col("__e.t").alias("t"), *[(F.col(k) * F.col("__e.s")).alias(k) for k in values])


def running_sums(df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """df with each column replaced by its running sum in order of t (unique within keys).

    width: take the sums in two levels over buckets of t of this width, for keys with too many rows for one task.
    """
    if width is None:
        w = Window.partitionBy(*keys).orderBy(t).rowsBetween(*TO_HERE)
        return df.withColumns({c: F.sum(c).over(w) for c in columns})
    df = written(df.withColumn("__bucket", F.floor(F.col(t) / width)))
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__sum_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(*ALL_BEFORE)
    totals = totals.withColumns({f"__sum_{c}": F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)) for c in columns})
    w = Window.partitionBy(*keys, "__bucket").orderBy(t).rowsBetween(*TO_HERE)
    return by_keys(df, totals, [*keys, "__bucket"]).withColumns({c: F.sum(c).over(w) + F.col(f"__sum_{c}") for c in columns}).drop("__bucket", *[f"__sum_{c}" for c in columns])


def segments(levels: DataFrame, keys: Sequence[str], t: str, width: int | None = None) -> DataFrame:
    """Rows of running_sums as segments: adds until, the next instant of the keys; the last instant opens none."""
    if width is None:
        return levels.withColumn("until", F.lead(t).over(Window.partitionBy(*keys).orderBy(t))).filter("until IS NOT NULL")
    b = written(levels.withColumn("__b", F.floor(F.col(t) / width)))
    firsts = b.groupBy(*keys, "__b").agg(F.min(t).alias("__first"))
    firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b"))).drop("__first")
    inside = F.lead(t).over(Window.partitionBy(*keys, "__b").orderBy(t))
    return by_keys(b, firsts, [*keys, "__b"]).withColumn("until", F.coalesce(inside, "__next")).drop("__b", "__next").filter("until IS NOT NULL")


def level_segments(df: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """segments of running_sums of df. width: both in one pass, so that a bucket is written and sorted once."""
    if width is None:
        return segments(running_sums(df, keys, t, columns), keys, t)
    df = written(df.withColumn("__b", F.floor(F.col(t) / width)))
    heads = df.groupBy(*keys, "__b").agg(F.min(t).alias("__first"), *[F.sum(c).alias(f"__sum_{c}") for c in columns])
    over = Window.partitionBy(*keys).orderBy("__b")
    heads = heads.select(*keys, "__b", F.lead("__first").over(over).alias("__next"), *[F.coalesce(F.sum(f"__sum_{c}").over(over.rowsBetween(*ALL_BEFORE)), F.lit(0)).alias(f"__sum_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "__b").orderBy(t)
    summed = {c: F.sum(c).over(inside.rowsBetween(*TO_HERE)) + F.col(f"__sum_{c}") for c in columns}
    out = by_keys(df, heads, [*keys, "__b"]).withColumns(summed | {"until": F.coalesce(F.lead(t).over(inside), "__next")})
    return out.drop("__b", "__next", *[f"__sum_{c}" for c in columns]).filter("until IS NOT NULL")


def subtract_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None) -> DataFrame:
    """keys, start, end: the parts of a's union that no interval of b covers. width: in two levels, for keys with too many rows for one task."""
    one, none = F.lit(1), F.lit(0)
    both = changes(a, keys, start, end, {"a": one, "b": none}).unionByName(changes(b, keys, start, end, {"a": none, "b": one}))
    levels = running_sums(both.groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), keys, "t", ["a", "b"], width)
    left = segments(levels, keys, "t", width).filter("a > 0 AND b = 0").select(*keys, F.col("t").alias(start), F.col("until").alias(end))
    return merge_intervals(left, keys, start, end, width=width).drop("n")


def dyadic_cells(start: Column, end: Column, unit: int) -> Column:
    """The cells of a segment tree over units of time that make up the units which [start, end] touches: an array of (level, place), a cell of level k being 2^k units long.

    The least set of cells: two a level at most, so that their number grows with the logarithm of the length. A null or turned interval has none.
    """
    first, behind = F.floor(start / unit), F.floor(end / unit) + 1
    # level by level: an odd left edge and an odd right edge give a cell each; the rest goes up
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(behind - first, F.lit(1)))).cast("int") + 1)
    lo = lambda k: F.ceil(first / F.pow(F.lit(2.0), k)).cast("long")
    hi = lambda k: F.floor(behind / F.pow(F.lit(2.0), k)).cast("long")
    cell = lambda k, place: F.struct(k.alias("level"), place.alias("place"))

    def of(k: Column) -> Column:
        left = F.when((lo(k) < hi(k)) & (lo(k) % 2 != 0), cell(k, lo(k)))
        right = F.when((lo(k) < hi(k)) & (hi(k) % 2 != 0), cell(k, hi(k) - 1))
        return F.array_compact(F.array(left, right))

    # most intervals touch one unit or two: what the levels give for them, without going through them
    near = F.when(behind - first == 1, F.array(cell(F.lit(0), first))).when((behind - first == 2) & (first % 2 == 0), F.array(cell(F.lit(1), F.floor(first / 2)))).when(behind - first == 2, F.array(cell(F.lit(0), first), cell(F.lit(0), first + 1)))
    return F.when(end >= start, F.coalesce(near, F.flatten(F.transform(levels, of))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of rows with equal keys and intervals that meet: left has l_start, l_end, right r_start, r_end.

    Two intervals meet where one begins in the other. So each side's starts ask the other side's intervals: these stand at the cells of a segment tree over units
    of the width that make them up (two a level at most, however long they are),
    and a start asks the one cell of each level in use that holds it.
    A pair is found once: by the later start, and at equal starts by the right one. closed: intervals that only share an instant meet too.
    """
    lo, hi = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    meets = lo <= hi if closed else lo < hi

    def found(spans: DataFrame, points: DataFrame, s: str, e: str, at: str) -> DataFrame:
        cells = spans.withColumn("__c", F.explode(dyadic_cells(F.col(s), F.col(e), width))).withColumns({"__level": F.col("__c.level"), "__place": F.col("__c.place")}).drop("__c")
        # one number: the level of the longest interval's cells at most (the binary digits of its units)
        units = F.floor(F.col(e) / width) - F.floor(F.col(s) / width) + 1
        top = F.broadcast(spans.filter(F.col(e) >= F.col(s)).agg((F.length(F.bin(F.max(units))) - 1).alias("__top")))
        asks = points.join(top).withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__top")
        asks = asks.withColumn("__place", F.floor(F.floor(F.col(at) / width) / F.pow(F.lit(2.0), "__level")).cast("long"))
        return cells.join(asks, [*keys, "__level", "__place"]).drop("__level", "__place").filter(meets)

    by_right = found(left, right, "l_start", "l_end", "r_start").filter("r_start >= l_start")
    by_left = found(right, left, "r_start", "r_end", "l_start").filter("l_start > r_start")
    return by_right.unionByName(by_left.select(*by_right.columns))


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Pairs of a point and the spans of its keys with start - before <= at <= end + after.

    overlap_join for instants: these ask the spans' cells, and nothing asks the other way, so that either side is shuffled once. Other columns must differ.
    """
    s, e = F.col(start) - before, F.col(end) + after
    cells = spans.withColumn("__c", F.explode(dyadic_cells(s, e, width))).withColumns({"__level": F.col("__c.level"), "__place": F.col("__c.place")}).drop("__c")
    units = F.floor(e / width) - F.floor(s / width) + 1
    top = F.broadcast(spans.filter(e >= s).agg((F.length(F.bin(F.max(units))) - 1).alias("__top")))
    asks = points.join(top).withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__top")
    asks = asks.withColumn("__place", F.floor(F.floor(F.col(at) / width) / F.pow(F.lit(2.0), "__level")).cast("long"))
    return asks.join(cells, [*keys, "__level", "__place"]).drop("__level", "__place").filter(F.col(at).between(s, e))


def clip(df: DataFrame, windows: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """df's intervals cut to the windows (same keys and columns) that they overlap."""
    right = windows.select(*keys, F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    joined = overlap_join(df.withColumnsRenamed({start: "l_start", end: "l_end"}), right, keys, width)
    return joined.withColumn(start, F.greatest("l_start", "r_start")).withColumn(end, F.least("l_end", "r_end")).select(*df.columns)


def concurrency(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column | None = None, starts_first: bool = False, width: int | None = None) -> DataFrame:
    """keys, t, level: how many intervals (or what weight) run from t on. starts_first: an interval that ends at t still counts at t."""
    weight = F.lit(1) if weight is None else weight
    c = changes(df, keys, start, end, {"level": weight})
    if starts_first:
        opened = df.filter(F.col(end) > F.col(start)).groupBy(*keys, F.col(start).alias("t")).agg(F.sum(weight).alias("__opened"))
        levels = running_sums(c.withColumn("__change", F.col("level")), keys, "t", ["level"], width)
        return levels.join(opened, [*keys, "t"], "left").withColumn("level", F.col("level") - F.col("__change") + F.coalesce("__opened", F.lit(0))).drop("__change", "__opened")
    return running_sums(c, keys, "t", ["level"], width)


def peak(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None, **how: object) -> DataFrame:
    """keys, peak, peak_at: the greatest level and the first instant that has it."""
    levels = concurrency(df, keys, start, end, width=width, **how)
    best = F.max(F.struct(F.col("level"), (-F.col("t")).alias("nt"))).alias("m")
    return (levels.groupBy(*keys) if keys else levels.groupBy()).agg(best).select(*keys, F.col("m.level").alias("peak"), (-F.col("m.nt")).alias("peak_at"))


def capacity_sweep(df: DataFrame, keys: Sequence[str], start: str, end: str, cores: int, width: int | None = None) -> DataFrame:
    """Demand against a number of cores: keys, t, until, demand, busy, queued of every segment with demand."""
    seg = segments(concurrency(df, keys, start, end, width=width), keys, "t", width).filter("level > 0")
    return seg.select(*keys, "t", "until", F.col("level").alias("demand"), F.least("level", F.lit(cores)).alias("busy"), F.greatest(F.col("level") - cores, F.lit(0)).alias("queued"))


def capacity_totals(sweep: DataFrame, keys: Sequence[str], cores: int) -> DataFrame:
    """Of a capacity_sweep: time at or over capacity, busy and queued task time, and time with a queue."""
    dt = F.col("until") - F.col("t")
    return sweep.groupBy(*keys).agg(F.sum(F.when(F.col("demand") >= cores, dt).otherwise(0)).alias("full_ms"), F.sum(F.when(F.col("queued") > 0, dt).otherwise(0)).alias("queued_wall_ms"), F.sum(dt * F.col("busy")).alias("busy_ms"), F.sum(dt * F.col("queued")).alias("queued_ms"), F.max("demand").alias("peak_demand"))


def bucket_spread(df: DataFrame, keys: Sequence[str], start: str, end: str, measures: Sequence[str], width: int) -> DataFrame:
    """keys, bucket, n and measures: each interval's measures split over the buckets it covers by its share of time there; an interval counts in its last
    bucket, and one without length gives all to its bucket."""
    b0, b1 = F.floor(F.col(start) / width), F.floor(F.when(F.col(end) > F.col(start), F.col(end) - 1).otherwise(F.col(end)) / width)
    rows = df.withColumn("__last", b1).withColumn("bucket", F.explode(F.sequence(b0, b1)))
    inside = F.least(F.col(end), (F.col("bucket") + 1) * width) - F.greatest(F.col(start), F.col("bucket") * width)
    share = F.when(F.col(end) > F.col(start), inside / (F.col(end) - F.col(start))).otherwise(1.0)
    return rows.groupBy(*keys, "bucket").agg(F.count_if(F.col("bucket") == F.col("__last")).alias("n"), *[F.sum(F.col(m) * share).alias(m) for m in measures])


def bursts(df: DataFrame, keys: Sequence[str], t: str, gap: int, at_least: int, width: int | None = None) -> DataFrame:
    """keys, start, end, n: runs of instants each within gap of the one before, of at least so many. width: in two levels, for keys with too many rows for one task."""
    points = df.select(*keys, F.col(t).alias("start"), F.col(t).alias("end"))
    return merge_intervals(points, keys, "start", "end", gap, width=width).filter(F.col("n") >= at_least)


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, at_least: int) -> DataFrame:
    """keys, start, end: stretches of at least so long between a key's islands."""
    islands = merge_intervals(df, keys, start, end)
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return islands.select(*keys, F.col(end).alias("start"), after.alias("end")).filter(F.col("end") - F.col("start") >= at_least)


def idle_stretches(used: DataFrame, keys: Sequence[str], bucket: str, at_least: int) -> DataFrame:
    """keys, start, end, n: runs of at least so many empty buckets between a key's first and last used one. used: one row or more a used bucket."""
    seen = used.select(*keys, bucket).distinct()
    after = F.lead(bucket).over(Window.partitionBy(*keys).orderBy(bucket))
    holes = seen.select(*keys, (F.col(bucket) + 1).alias("start"), (after - 1).alias("end"))
    return holes.withColumn("n", F.col("end") - F.col("start") + 1).filter(F.col("n") >= at_least)


def carried_forward(df: DataFrame, keys: Sequence[str], bucket: str, order: str, value: str, until: str) -> DataFrame:
    """keys, bucket, value: the last value at or before each bucket from a key's first one to `until`. One row a key and bucket at the end, not on the way."""
    last = df.groupBy(*keys, bucket).agg(F.max_by(value, order).alias(value), F.max(until).alias(until))
    w = Window.partitionBy(*keys).orderBy(bucket)
    end = F.coalesce(F.lead(bucket).over(w) - 1, F.greatest(F.col(until), F.col(bucket)))
    return last.withColumn("__end", end).select(*keys, F.explode(F.sequence(F.col(bucket), F.col("__end"))).alias(bucket), value)


def heap_use(gc: DataFrame, executors: DataFrame, width: int = 60_000) -> DataFrame:
    """context, minute: the heap in use after the last collections of the executors that are up (used_mb of up_mb, share), the fullest one of them (max_share, max_exec), and the driver's share.

    An executor keeps its last measured value until its next collection, from its first one on, and counts in the minutes it is up in: added before the minute ends, not removed
    before it begins. Minutes go up to the context's last measured one; those with neither a heap nor a driver are left out. Of equally full executors the least is named.
    gc: context, executor_id (null or 'driver' for the driver), ts_ms, after_mb, total_mb; executors: context, executor_id, added_ms, removed_ms, heap_mb (null: the measured total). One row
    an executor and minute meets before the sum, as in the result's meaning.
    """
    keys = ["context", "executor_id"]
    e = gc.dropna(subset=["ts_ms", "after_mb"]).withColumns({"executor_id": F.coalesce("executor_id", F.lit("driver")), "minute": F.col("ts_ms") - F.pmod("ts_ms", F.lit(width))})
    e = e.groupBy(*keys, "minute").agg(F.max("after_mb").alias("after"), F.max("total_mb").alias("total"))
    top = e.groupBy("context").agg(F.max("minute").alias("__top"))
    w = Window.partitionBy(*keys).orderBy("minute")
    held = e.join(top, "context").withColumn("__to", F.coalesce(F.lead("minute").over(w) - width, "__top")).join(executors.select(*keys, "added_ms", "removed_ms", "heap_mb"), keys, "left")
    driver = F.col("executor_id") == "driver"
    cut = lambda c, first: F.when(driver | F.col(c).isNull(), first)
    down = lambda c: c - F.pmod(c, F.lit(width))
    held = held.withColumns({"__from": F.greatest("minute", cut("added_ms", F.col("minute")).otherwise(down(F.col("added_ms")))), "__to": F.least("__to", cut("removed_ms", F.col("__to")).otherwise(down(F.col("removed_ms") - 1)))})
    each = held.filter("__from <= __to").withColumn("minute", F.explode(F.sequence("__from", "__to", F.lit(width).cast("long"))))
    heap = F.when(~driver, F.coalesce(F.when(F.col("heap_mb") != 0, F.col("heap_mb")), F.when(F.col("total") != 0, F.col("total"))))
    full = F.col("after") / F.col("__heap")
    each = each.withColumn("__heap", heap)
    out = each.groupBy("context", "minute").agg(
        F.sum(F.when(F.col("__heap").isNotNull(), F.col("after"))).alias("used_mb"), F.sum("__heap").alias("up_mb"), F.max(full).alias("max_share"),
        F.min_by("executor_id", F.when(full > 0, F.struct((-full).alias("f"), F.col("executor_id").alias("e")))).alias("max_exec"), F.max(F.when(driver & (F.col("total") > 0), F.col("after") / F.col("total"))).alias("driver_share"),
    ).filter("up_mb IS NOT NULL OR driver_share IS NOT NULL")
    part = lambda c: F.round(F.when(c > 1, 1.0).otherwise(c), 3)
    return out.select("context", "minute", "used_mb", "up_mb", part(F.col("used_mb") / F.col("up_mb")).alias("share"), F.when(F.col("max_exec").isNotNull(), part(F.col("max_share"))).alias("max_share"), "max_exec", F.round("driver_share", 3).alias("driver_share"))


def underused(up: DataFrame, used: DataFrame, keys: Sequence[str], bucket: str, share: float, at_least: int) -> DataFrame:
    """keys, start, end, n: runs of at least so many buckets in a row that are up (rows of up, with capacity `up`) and use less than the share of it. Buckets that are not up end a run."""
    quiet = up.join(used, [*keys, bucket], "left").filter(F.coalesce("used", F.lit(0)) < F.lit(share) * F.col("up"))
    spans = quiet.select(*keys, F.col(bucket).alias("start"), (F.col(bucket) + 1).alias("end"))
    return merge_intervals(spans, keys, "start", "end").filter(F.col("n") >= at_least)
