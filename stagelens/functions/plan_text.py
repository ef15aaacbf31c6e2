"""Facts from the text of a physical plan, taken line by line with patterns; a plan is never parsed into a tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: forms in plan text
OPERATOR = r"^[\s:+\-*()\d]*([A-Z][A-Za-z]+)"
SCAN = r"(?:FileScan|BatchScan|Scan) \w* ?([\w$]+(?:\.[\w$]+){1,2})"
WRITE = r"(?:InsertIntoHadoopFsRelationCommand|SaveIntoDataSourceCommand|CreateDataSourceTableAsSelectCommand|AppendData|OverwriteByExpression|MergeIntoCommand)\W+([\w$:/.\-]+)"
JDBC = r"JDBCRelation\((.*?)\) \[numPartitions=(\d+)\]"
CACHE = r"(?i)InMemoryTableScan|InMemoryRelation"
WINDOW = r"(row_number|rank|dense_rank)\([^\n]*?\) windowspecdefinition\([^\n]*?specifiedwindowframe\([^\n]*?\)\)\)(?: AS \w+#)?"
GROUP_LIMIT = r"WindowGroupLimit (\[[^\n]*)"


def final_plan(final: Column, initial: Column) -> Column:
    return F.coalesce(F.nullif(final, F.lit("")), F.nullif(initial, F.lit("")))


def operators(plan: Column, limit: int = 40) -> Column:
    """Distinct operator names in the order of the data: the plan is printed root first."""
    names = F.transform(F.split(F.split_part(plan, F.lit("\n\n"), F.lit(1)), "\n"), lambda x: F.regexp_extract(x, OPERATOR, 1))
    return F.slice(F.array_distinct(F.reverse(F.filter(names, lambda n: (n != "") & ~n.isin("AdaptiveSparkPlan", "Final", "Initial", "Plan")))), 1, limit)


def tables_read(plan: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plan, F.lit(SCAN), 1)))


def tables_written(plan: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plan, F.lit(WRITE), 1)))


def jdbc(plan: Column) -> Column:
    """struct(source, partitions, kind) of the plan's first read of another database; null without one."""
    source = F.regexp_extract(plan, JDBC, 1)
    kind = F.when(source.rlike(r"(?i)count\(\s*(\*|1)\s*\)"), "count").when(source.rlike(r"(?i)\bmin\(.*\bmax\("), "key_range").when(source.rlike(r"(?i)where\s+1\s*=\s*0"), "probe").otherwise("read")
    return F.when(plan.rlike(JDBC), F.struct(F.regexp_replace(source, r"(?i)(password|user)=[^;&\s]*", "$1=?").alias("source"), F.regexp_extract(plan, JDBC, 2).cast("int").alias("partitions"), kind.alias("kind")))


def count_only(plan: Column) -> Column:
    """An ungrouped count and nothing written."""
    ungrouped = plan.rlike(r"Aggregate\(keys=\[\], functions=\[(?:\w*_?count\([^\]]*\))\]") | plan.rlike(r"Keys(?: \[0\])?: \[\]\nFunctions \[\d+\]: \[\w*_?count\(")
    return F.coalesce(ungrouped & ~plan.rlike(WRITE), F.lit(False))


def uses_cache(plan: Column) -> Column:
    return F.coalesce(plan.rlike(CACHE), F.lit(False))


def adaptive(plan: Column) -> Column:
    return F.coalesce(plan.contains("AdaptiveSparkPlan"), F.lit(False))


def arguments(text: Column) -> Column:
    """The parts of a list, cut at the commas outside brackets, up to a bracket that closes more than is open: a fold over the tokens with a depth."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\[\](),]|[^\[\](),]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(x: Column, t: Column) -> Column:
        depth = x["depth"] + F.when(t.isin("[", "("), 1).when(t.isin("]", ")"), -1).otherwise(0)
        over, comma = (x["depth"] < 0) | (depth < 0), (t == ",") & (x["depth"] == 0)
        return F.struct(
            F.when(over, -1).otherwise(depth).alias("depth"), F.when(over, x["part"]).when(comma, "").otherwise(F.concat(x["part"], t)).alias("part"),
            F.when(comma & ~over, F.array_append(x["parts"], F.trim(x["part"]))).otherwise(x["parts"]).alias("parts"),
        )

    return F.filter(F.aggregate(tokens, start, step, lambda x: F.array_append(x["parts"], F.trim(x["part"]))), lambda p: p != "")


def plain_names(parts: Column) -> Column:
    """Expressions without the ids that a plan puts behind names."""
    return F.transform(parts, lambda p: F.regexp_replace(p, r"#\d+L?", ""))


def ranking_windows(plan: Column) -> Column:
    """An array of (function, partition_keys, order_keys, alias, limit, keeps_ties) of a plan's ranking windows, different ones in order.

    The limit is that of a group limit on the same keys and function, or of a filter on the alias; null if all ranks are kept. rank and dense_rank that keep the first
    keep all that tie for it.
    """
    found = F.regexp_extract_all(plan, F.lit(WINDOW), F.lit(0))
    ordered = r" (ASC|DESC)( NULLS (FIRST|LAST))?$"

    def window(text: Column) -> Column:
        spec = F.filter(arguments(F.split_part(text, F.lit("windowspecdefinition("), F.lit(2))), lambda p: ~p.startswith("specifiedwindowframe"))
        return F.struct(
            F.regexp_extract(text, WINDOW, 1).alias("function"), plain_names(F.filter(spec, lambda p: ~p.rlike(ordered))).alias("partition_keys"), plain_names(F.filter(spec, lambda p: p.rlike(ordered))).alias("order_keys"),
            F.nullif(F.regexp_extract(text, r"\) AS (\w+)#", 1), F.lit("")).alias("alias"),
        )

    limits = F.transform(F.regexp_extract_all(plan, F.lit(GROUP_LIMIT), F.lit(1)), arguments)
    inner = lambda part: plain_names(arguments(F.regexp_replace(part, r"^\[|\]$", "")))
    limits = F.transform(limits, lambda p: F.struct(inner(F.get(p, 0)).alias("keys"), F.regexp_extract(F.get(p, F.size(p) - 3), r"^(\w+)", 1).alias("function"), F.get(p, F.size(p) - 2).try_cast("int").alias("limit")))

    def limited(w: Column) -> Column:
        by_group = F.array_min(F.transform(F.filter(limits, lambda g: (g["keys"] == w["partition_keys"]) & (g["function"] == w["function"])), lambda g: g["limit"]))
        test = F.concat(F.lit(r"\b"), w["alias"], F.lit(r"(?:#\d+L?)? (=|<=|<) (\d+)\b"))
        part = lambda i: F.call_function("regexp_extract", plan, test, F.lit(i))
        by_filter = part(2).try_cast("int") - F.when(part(1) == "<", 1).otherwise(0)
        limit = F.coalesce(by_group, by_filter)
        return F.struct(w["function"].alias("function"), w["partition_keys"].alias("partition_keys"), w["order_keys"].alias("order_keys"), w["alias"].alias("alias"), limit.alias("limit"), (w["function"].isin("rank", "dense_rank") & F.coalesce(limit == 1, F.lit(False))).alias("keeps_ties"))

    return F.transform(F.array_distinct(F.transform(found, window)), limited)


def dedup_window(plan: Column) -> Column:
    """The first ranking window that keeps one rank a key; null without one."""
    return F.get(F.filter(ranking_windows(plan), lambda w: w["limit"] == 1), 0)


def description_label(text: Column) -> Column:
    """A query's label: of a streaming batch the query's name, else the first line that says something, at most 200 characters."""
    batch = r"(?s)^\s*(?:id = [\w-]+\s*)?(?:runId = [\w-]+\s*)?batch = (\d+)"
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 0)
    return F.when(text.rlike(batch), F.lit("streaming batch")).otherwise(F.substring(F.regexp_replace(F.trim(first), r"^(--|#|//)\s*", ""), 1, 200))


def micro_batch(text: Column) -> Column:
    """struct(stream, batch) of a streaming batch's description; null for others."""
    run = r"(?s)runId = ([\w-]+).*?batch = (\d+)"
    return F.when(text.rlike(run), F.struct(F.regexp_extract(text, run, 1).alias("stream"), F.regexp_extract(text, run, 2).cast("long").alias("batch")))
