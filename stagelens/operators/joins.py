"""Joins by time and by lineage: as-of, error to running task, previous attempt, lookups, lists of others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .intervals import by_keys, overlap_join, point_join


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str], forward: bool = False, strict: bool = False, width: int | None = None) -> DataFrame:
    """left with the columns `take` of the last right row of its keys at or before left_time (forward: the first at or after); null if there is none.

    One shuffle by the keys: the sides are stacked and the right values carried along the order of time. strict: not at the same instant. Of right rows at
    one instant, the greatest by the taken columns counts (forward: the least). width: for keys with too many rows for one task, time is cut into buckets of
    this width; each bucket's last right row is carried over the buckets first (one row a bucket), then each bucket is a window of its own.
    """
    carry = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]
    stacked = left.select(*keys, F.col(left_time).alias("__t"), F.lit(0 if strict != forward else 1).alias("__side"), F.struct(*left.columns).alias("__row"), *carry, F.lit(None).cast("boolean").alias("__r"))
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(1 if strict != forward else 0).alias("__side"), F.lit(None).cast(stacked.schema["__row"].dataType).alias("__row"), *take, F.lit(True).alias("__r"))
    both, parts = stacked.unionByName(other), list(keys)
    if width is not None:
        both, parts = both.withColumn("__b", F.floor(F.col("__t") / width)), [*keys, "__b"]
    # forward: the same from behind, as Spark takes a frame of all following rows anew for each row
    turned = (lambda c: F.col(c).desc()) if forward else F.col
    w = Window.partitionBy(*parts).orderBy(*[turned(c) for c in ("__t", "__side", *take)]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last(F.when(F.col("__r"), F.struct(*take)), ignorenulls=True).over(w)).filter("__row IS NOT NULL")
    if width is not None:
        edge = (F.min if forward else F.max)(F.when(F.col("__r"), F.struct("__t", *take)))
        edges = both.groupBy(*parts).agg(edge.alias("__edge"))
        over = Window.partitionBy(*keys).orderBy(turned("__b")).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.withColumn("__edge", F.last("__edge", ignorenulls=True).over(over))
        same = F.lit(True)
        for k in parts:
            same = same & found[k].eqNullSafe(edges[k])
        rest = F.struct(*[F.col(f"__edge.{c}").alias(c) for c in take])
        found = found.join(edges, same, "left").withColumn("__found", F.coalesce("__found", F.when(F.col("__edge").isNotNull(), rest)))
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(f"asof_{c}" if c in left.columns else c) for c in take])


def asof_each(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str], marks: dict[str, Column], width: int) -> DataFrame:
    """left with `found`: an array of the columns `take` of the last right row at or before left_time of each mark (name -> condition on right) that has one.

    asof_join for several sorts of right rows at once: a left row is sorted once, not once a sort. Ties and buckets are as there. Both sides are written once.
    """
    row = F.struct(*[c for c in left.columns if c not in keys])
    carry = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]
    stacked = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), row.alias("__row"), *carry, *[F.lit(False).alias(m) for m in marks])
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(stacked.schema["__row"].dataType).alias("__row"), *take, *[F.coalesce(on, F.lit(False)).alias(m) for m, on in marks.items()])
    # sorts compare a row's first column fast: a number that tells most parts from each other, not a text that many share
    both, parts = stacked.unionByName(other).withColumn("__b", F.floor(F.col("__t") / width)), ["__h", *keys, "__b"]
    both = written(both.withColumn("__h", F.xxhash64(*keys, "__b")))
    w = Window.partitionBy(*parts).orderBy("__t", "__side", *take).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*parts, "__row", *[F.last(F.when(F.col(m), F.struct(*take)), ignorenulls=True).over(w).alias(m) for m in marks]).filter("__row IS NOT NULL")
    edges = both.groupBy(*parts).agg(*[F.max(F.when(F.col(m), F.struct("__t", *take))).alias(m) for m in marks])
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = edges.select(*parts, *[F.last(m, ignorenulls=True).over(over).alias(f"__edge_{m}") for m in marks])
    last = [F.coalesce(F.col(m), F.when(F.col(f"__edge_{m}").isNotNull(), F.struct(*[F.col(f"__edge_{m}.{c}").alias(c) for c in take]))) for m in marks]
    return by_keys(found, before, parts, "left").select(*keys, "__row.*", F.array_compact(F.array(*last)).alias("found"))


def running_at(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, failed: str, slack: int, width: int) -> DataFrame:
    """Pairs of a point and the spans of its keys that run within slack of it: only the failed ones where any has failed. The point has its columns, the span, all but the keys."""
    pairs = point_join(points, spans, keys, at, start, end, width, slack, slack)
    any_failed = F.bool_or(F.col(failed)).over(Window.partitionBy(*points.columns))
    return pairs.withColumn("__any", any_failed).filter(F.col(failed) | ~F.col("__any")).drop("__any")


def with_fallback(points: DataFrame, matched: DataFrame, key: Sequence[str], spans: DataFrame, at: str, start: str, end: str, slack: int, width: int) -> DataFrame:
    """Points that matched nothing, with the spans of any key open at their time, or that ended at most slack before."""
    alone = points.join(matched.select(*key).distinct(), list(key), "left_anti")
    return point_join(alone, spans, [], at, start, end, width, after=slack)


def overlap_share(df: DataFrame, keys: Sequence[str], ident: str, start: str, end: str, width: int) -> DataFrame:
    """ident, others, overlap: how many other intervals of its keys meet each, and the summed time of the overlaps."""
    left = df.select(*keys, F.col(ident).alias("__l"), F.col(start).alias("l_start"), F.col(end).alias("l_end"))
    right = df.select(*keys, F.col(ident).alias("__r"), F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    pairs = overlap_join(left, right, keys, width).filter("__l <> __r")
    return pairs.groupBy(F.col("__l").alias(ident)).agg(F.count("*").alias("others"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("overlap"))


def overlapping(df: DataFrame, keys: Sequence[str], ident: str, start: str, end: str, width: int) -> DataFrame:
    """ident, overlapping: the others that meet it, in order."""
    left = df.select(*keys, F.col(ident).alias("__l"), F.col(start).alias("l_start"), F.col(end).alias("l_end"))
    right = df.select(*keys, F.col(ident).alias("__r"), F.col(start).alias("r_start"), F.col(end).alias("r_end"))
    pairs = overlap_join(left, right, keys, width).filter("__l <> __r")
    return pairs.groupBy(F.col("__l").alias(ident)).agg(F.sort_array(F.collect_set("__r")).alias("overlapping"))


def previous_attempt(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with prev_<column> of the attempt before, in one window instead of a self join."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def lowest_parent(df: DataFrame, child: Sequence[str], parent: str, take: Sequence[str] = ()) -> DataFrame:
    """child, the least parent that lists it, and the columns `take` of that row (the least of equals)."""
    return df.groupBy(*child).agg(F.min(F.struct(parent, *take)).alias("__m")).select(*child, *[F.col(f"__m.{c}").alias(c) for c in (parent, *take)])


def start_end(starts: DataFrame, ends: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Starts (the first of each key) with their ends; where both have a column, the end's value wins if it is not null."""
    first = starts.groupBy(*keys).agg(F.min_by(F.struct(*starts.columns), order).alias("s"))
    last = ends.groupBy(*keys).agg(F.max_by(F.struct(*ends.columns), order).alias("e"))
    both = first.join(last, list(keys), "full")
    rest = [c for c in dict.fromkeys([*starts.columns, *ends.columns]) if c not in keys]
    pick = lambda c: F.coalesce(*[F.col(f"{k}.{c}") for k, df in (("e", ends), ("s", starts)) if c in df.columns])
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """keys and the columns of their last row."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def first_of(df: DataFrame, ident: Sequence[str], lookups: Sequence[tuple[DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """df with value from the first lookup (in order of priority) that has its keys. Lookups must be unique by keys."""
    names = []
    for i, (other, keys) in enumerate(lookups):
        df = df.join(other.select(*keys, F.col(value).alias(f"__v{i}")), list(keys), "left")
        names.append(f"__v{i}")
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def propagate(df: DataFrame, ident: str, parent: str, value: str) -> DataFrame:
    """df with value taken, where it is null, from the nearest row up the chain of parents that has one, however far that is. ident tells rows apart.

    Pointers double until none moves. A chain that ends without a value, or runs into a cycle, gives null.
    """
    from .graph import follow_paths

    ends = follow_paths(df.filter(F.col(value).isNull() & (F.col(parent) != F.col(ident))), ident, parent, paths=False).select(F.col(ident).alias("__i"), F.col("root").alias("__root"))
    known = df.filter(F.col(value).isNotNull()).select(F.col(ident).alias("__r"), F.col(value).alias("__v"))
    far = ends.join(known, F.col("__root") == F.col("__r")).select("__i", "__v")
    return df.join(far, F.col(ident) == F.col("__i"), "left").withColumn(value, F.coalesce(value, "__v")).drop("__i", "__v")


@dataclass(frozen=True)
class Candidates:
    """Rows of the pool equal in all columns of `same` and unequal in `differs` (a row without a value there differs from every row): the first `cap` of them."""

    group: int
    same: Sequence[str]
    cap: int
    differs: str | None = None


def ranked_candidates(query: DataFrame, pool: DataFrame, ident: str, order: Sequence[str], groups: Sequence[Candidates]) -> DataFrame:
    """For each query row, the first candidates of each group in order, with rank; the pool's columns are prefixed c_. ident is unique and never null; a row is no candidate of its own.

    No pairs are made. What any row of a scope can need is cut before the join: of each value that may have to be left out its first cap + 1 rows, of these the scope's first
    2 cap + 1 (at most cap + 1 of them are left out for one row). Spark cuts in the sending tasks. A scope is then one row with a short list, which each query row filters by itself.
    Query rows of a hot scope meet that one row, so the join can be split or the lists sent to all tasks.
    """
    out = None
    for g in groups:
        first = [*[F.col(c) for c in order], F.col(ident)]
        differs = g.differs if g.differs and g.differs != ident else None
        kept = pool.dropna(subset=list(g.same))
        if differs:
            kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*g.same, differs).orderBy(*first))).filter(F.col("__r") <= g.cap + 1).drop("__r")
        most = 2 * g.cap + 1 if differs else g.cap + 1
        kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*g.same).orderBy(*first))).filter(F.col("__r") <= most)
        lists = kept.groupBy(*g.same).agg(F.sort_array(F.collect_list(F.struct("__r", *[F.col(c).alias(f"c_{c}") for c in pool.columns]))).alias("__c"))

        def other(x):
            apart = x[f"c_{ident}"] != F.col(ident)
            return apart & ~F.coalesce(x[f"c_{differs}"] == F.col(differs), F.lit(False)) if differs else apart

        mine = F.slice(F.filter("__c", other), 1, g.cap)
        found = query.join(lists, list(g.same)).select(*query.columns, F.posexplode(mine).alias("__p", "__x"))
        one = found.select(*query.columns, *[F.col(f"__x.c_{c}").alias(f"c_{c}") for c in pool.columns], F.lit(g.group).alias("group"), (F.col("__p") + 1).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out
