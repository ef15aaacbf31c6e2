"""Row order: forward fill, sessions by content, retries, top n, samples, ranks, plan differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import by_keys, running_sums


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int | None = None) -> DataFrame:
    """df with, for each name, the last value that is not null at or before the row, in order within the keys.

    width: for keys with too many rows for one task (a giant file). The first order column, a row number, is cut into blocks of this width. What a block hands on is its
    last value; those are carried over the blocks (one row a block), and each block, a window of its own, begins with what came before it.
    """
    df = df.withColumns(values)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in values})
    df = df.withColumn("__block", F.floor(F.col(order[0]) / width))
    at = F.struct(*order)
    edges = df.groupBy(*keys, "__block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__in_{c}") for c in values])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({f"__in_{c}": F.last(f"__in_{c}", ignorenulls=True).over(before) for c in values})
    w = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = by_keys(df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in values}), edges, [*keys, "__block"])
    return out.withColumns({c: F.coalesce(c, f"__in_{c}") for c in values}).drop("__block", *[f"__in_{c}" for c in values])


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int | None = None) -> DataFrame:
    """Nulls take the last value before them. width: as in last_known."""
    return last_known(df, keys, order, {c: F.col(c) for c in columns}, width)


def inherit(df: DataFrame, keys: Sequence[str], order: Sequence[str], boundary: Column, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """Rows that are no boundary take the columns of the last boundary row, and continuation says whether that has a first column. width: as in last_known."""
    out = last_known(df.withColumn("__b", boundary), keys, order, {"__last": F.when(F.col("__b"), F.struct(*columns))}, width)
    out = out.withColumn("continuation", ~F.col("__b") & F.col(f"__last.{columns[0]}").isNotNull())
    return out.withColumns({c: F.when(F.col("__b"), F.col(c)).otherwise(F.col(f"__last.{c}")) for c in columns}).drop("__b", "__last")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, width: int | None = None) -> DataFrame:
    """df with session: how many rows up to here open one (0 before the first). width: in two levels over blocks of the first order column, which then orders alone."""
    df = df.withColumn("session", F.when(opens, 1).otherwise(0))
    if width is not None:
        return running_sums(df, keys, order[0], ["session"], width)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum("session").over(w))


def exception_groups(lines: DataFrame, file: str, seq: str, line: str, header: str, frame: str, dump: str, prefixed: Column, top: int = 5, width: int | None = None) -> DataFrame:
    """Occurrences of exceptions: file, seq, exception, message, frames (the first `top`).

    A header opens an occurrence; its frames are the frame lines behind it. A blank line, a line with a prefix of its own, a thread dump's
    header or the next header closes it. Lines of a thread dump belong to none: a dump lasts from its header to a blank or prefixed line.
    width: a giant file in blocks of so many lines, as in last_known; an occurrence may lie over a block's edge.
    """
    c = F.col(line)
    blank = c.rlike(r"^\s*$")
    state = F.when(c.rlike(dump), 1).when(blank | prefixed, 0)
    marked = last_known(lines, [file], [seq], {"__dump": state}, width).withColumn("__dump", F.coalesce("__dump", F.lit(0)))
    opens = c.rlike(header) & (F.col("__dump") == 0)
    closes = blank | (prefixed & ~opens) | (F.col("__dump") == 1)
    marked = last_known(marked, [file], [seq], {"__group": F.when(opens, F.col(seq)).when(closes, F.lit(-1))}, width).filter("__group >= 0")
    frames = F.sort_array(F.collect_list(F.when(c.rlike(frame), F.struct(F.col(seq).alias("s"), F.regexp_replace(c, r"^\s+|\s+$", "").alias("f")))))
    out = marked.groupBy(file, F.col("__group").alias(seq)).agg(F.min_by(c, seq).alias("__head"), frames.alias("__f"))
    return out.select(file, seq, F.regexp_extract("__head", header, 1).alias("exception"), F.nullif(F.regexp_extract("__head", header, 2), F.lit("")).alias("message"), F.slice(F.transform("__f", lambda x: x["f"]), 1, top).alias("frames"))


def retries(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, failed: str, reason: str) -> DataFrame:
    """Of keys with a failure or more than one attempt: attempts, failures, first_reason, delay to the launch after the first failure, final status, wasted time."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = attempts.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(start).over(w))
    bad = F.col(failed)
    first = F.when(bad, F.col("__n"))
    out = a.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(bad).alias("failures"), F.min_by(reason, first).alias("first_reason"), F.min_by(F.col("__next") - F.col(end), first).alias("retry_delay"), F.max_by(failed, "__n").alias("__last"), F.sum(F.when(bad, F.col(end) - F.col(start)).otherwise(0)).alias("wasted"))
    return out.filter("failures > 0 OR attempts > 1").withColumn("final", F.when(F.col("__last"), "failed").when(F.col("failures") > 0, "recovered").otherwise("succeeded")).drop("__last")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, with rank. Spark keeps n rows of a key in each task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def systematic_sample(df: DataFrame, keys: Sequence[str], order: Sequence[Column], every: int, always: Column) -> DataFrame:
    """Every so many-th row in order within keys, and all rows where the condition holds."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__p", place).filter((F.col("__p") % every == 0) | always).drop("__p")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """df with its place (from 1) in the order over all rows, without one task that sees them all. Equal rows in the order may change places by run: end it with a key.

    Rows are sorted by ranges and written once with their place inside their range; the counts of the ranges before (one row a range) give the rest.
    """
    from .graph import written

    part, local = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())).withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, "__part").select(*df.columns, (F.col("__before") + local + 1).alias(name))


def ranked_ids(df: DataFrame, order: Sequence[Column], prefix: str = "F", digits: int = 3) -> DataFrame:
    """df with id: prefix and number in order, over any number of rows."""
    n = F.col("__id").cast("string")
    return numbered(df, order, "__id").withColumn("id", F.concat(F.lit(prefix), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n))).drop("__id")


def collapse(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for repeats of the keys: the columns of the first, and n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min_by(c, F.struct(*order)).alias(c) for c in columns])


def series_gaps(df: DataFrame, keys: Sequence[str], at: str, factor: float = 1.8) -> DataFrame:
    """keys, start, end, step: steps of at least factor times the key's usual (median) one."""
    w = Window.partitionBy(*keys).orderBy(at)
    steps = df.withColumn("__end", F.lead(at).over(w)).withColumn("__step", F.col("__end") - F.col(at)).filter("__step IS NOT NULL")
    usual = steps.groupBy(*keys).agg(F.median("__step").alias("usual"))
    return steps.join(usual, list(keys)).filter(F.col("__step") >= factor * F.col("usual")).select(*keys, F.col(at).alias("start"), F.col("__end").alias("end"), F.col("__step").alias("step"), "usual")


def natural_order(c: str, descending: bool = False) -> list[Column]:
    """Sort columns: numbers written as text by value, then other text; nulls last."""
    number, text = F.col(c).try_cast("bigint"), F.col(c)
    return [x.desc_nulls_last() if descending else x.asc_nulls_last() for x in (number, text)]


def plan_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, line, side (removed, added), n: lines that one of two plans of a key has more often than the other."""
    both = a.groupBy(*keys, line).agg(F.count("*").alias("na")).join(b.groupBy(*keys, line).agg(F.count("*").alias("nb")), [*keys, line], "full")
    n = F.coalesce("nb", F.lit(0)) - F.coalesce("na", F.lit(0))
    return both.withColumn("__n", n).filter("__n <> 0").select(*keys, line, F.when(F.col("__n") > 0, "added").otherwise("removed").alias("side"), F.abs("__n").alias("n"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, deep: int = 10_000) -> DataFrame:
    """The rows after offset, at most limit. Spark sorts a page near the start in one task (offset + limit rows); one that ends beyond `deep` rows is found by number instead."""
    if offset + limit <= deep:
        return df.orderBy(*order).offset(offset).limit(limit)
    return numbered(df, order, "__n").filter(F.col("__n").between(offset + 1, offset + limit)).drop("__n")


def where_equal(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that meet all filters: a value, a list of values, None for null; list columns by membership. A value that does not fit the column's type matches nothing."""
    for c, want in filters.items():
        kind = df.schema[c].dataType
        if want is None:
            df = df.filter(F.col(c).isNull())
        elif kind.typeName() == "array":
            df = df.filter(F.array_contains(c, want))
        else:
            values = want if isinstance(want, list | tuple | set) else [want]
            df = df.filter(F.coalesce(F.col(c).isin(*[F.lit(str(v)).try_cast(kind) for v in values]), F.lit(False)))
    return df
