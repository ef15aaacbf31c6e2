"""Plan trees as rows, their metrics, and the containment of jobs, stages and queries as nodes and edges."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Depth of the plans that tests build their deepest from, and nodes that a task sends on at once.
LEVELS, AT_ONCE = 12, 20_000


def _no_number(text: str) -> float:
    raise ValueError(text)


_read, _write = json.JSONDecoder(parse_constant=_no_number).decode, json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True, check_circular=False).encode


def _said(x: object) -> str | None:
    """A string as it is (half a surrogate pair is no text), null as null, anything else as JSON."""
    x = x if isinstance(x, str) or x is None else _write(x)
    return x if x is None or x.isascii() else x.encode("utf-8", "replace").decode()


def _nodes(text: str | None) -> Iterator[tuple[int | None, str | None, str | None, str | None]]:
    """parent's number, name, detail, metrics (JSON) of a plan's nodes in pre-order; none if it is not JSON."""
    try:
        left = [] if text is None else [(None, _read(text))]
    except (ValueError, RecursionError):
        return
    n = 0
    while left:
        up, x = left.pop()
        x = x if isinstance(x, dict) else {}
        metrics = x.get("metrics")
        yield up, _said(x.get("nodeName")), _said(x.get("simpleString")), "[]" if metrics == [] else _said(_write(metrics)) if "metrics" in x else None
        if isinstance(below := x.get("children"), list):
            left += [(n, c) for c in reversed(below)]
        n += 1


def plan_nodes(plans: DataFrame, keys: Sequence[str], plan: str) -> DataFrame:
    """keys, node_id (in pre-order, from 0), parent_id, name, detail, metrics (JSON) of plans given as JSON trees of nodeName, simpleString, metrics, children.

    A plan is parsed once and taken apart inside its row, as deep as it goes; rows stay where they are. keys tell plans apart.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, nodes = [], [], []

            def rows() -> pa.RecordBatch:
                columns = zip(*nodes, strict=True) if nodes else [()] * 4
                up, *texts = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.string()] * 3), strict=True)]
                out = [*(b.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))), pa.array(number, pa.int32()), up, *texts]  # noqa: B023
                return pa.RecordBatch.from_arrays(out, [*keys, "node_id", "parent_id", "name", "detail", "metrics"])

            for r, text in enumerate(b.column(len(keys)).to_pylist()):
                for i, node in enumerate(_nodes(text)):
                    row.append(r)
                    number.append(i)
                    nodes.append(node)
                    if len(row) == AT_ONCE:
                        yield rows()
                        row, number, nodes = [], [], []
            yield rows()

    given = plans.select(*keys, F.col(plan).alias("__plan"))
    return given.mapInArrow(apart, StructType([*given.schema.fields[:-1], *(StructField(c, IntegerType()) for c in ("node_id", "parent_id")), *(StructField(c, StringType()) for c in ("name", "detail", "metrics"))]))


def node_metrics(nodes: DataFrame, keys: Sequence[str], totals: DataFrame, driver: DataFrame) -> DataFrame:
    """keys, node_id, metric, type, value: each operator metric with its accumulated value, of tasks, else of the driver; where both have it, their sum.

    nodes: metrics as JSON of (name, accumulatorId, metricType); totals and driver: context, accumulator, total.
    """
    each = nodes.filter("metrics <> '[]'").select(*keys, "node_id", F.explode(F.from_json("metrics", "array<struct<name: string, accumulatorId: long, metricType: string>>")).alias("m"))
    each = each.select(*keys, "node_id", F.col("m.name").alias("metric"), F.col("m.accumulatorId").alias("accumulator"), F.col("m.metricType").alias("type"))
    added = totals.select("context", "accumulator", "total").unionByName(driver.select("context", "accumulator", "total")).groupBy("context", "accumulator").agg(F.sum("total").alias("value"))
    return each.join(added, ["context", "accumulator"], "left").select(*keys, "node_id", "metric", "type", "value")


# fixed values: sizes of an operator, the first that it has counts
SIZES = ("data size", "size of files read", "shuffle bytes written")
# end of fixed values


def headline(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node_id: rows out, time in ms, peak memory, spill and data size of each operator.

    Rows, spills and times add up; an operator's own clock (duration) stands before the sum of its other timings. Peak memory is the greatest there is. Sizes are
    of the first name in SIZES that has one. An operator without such metrics has nulls. metrics: name, type and value; `most` (a task's greatest) where it is known.
    """
    m = metrics if "most" in metrics.columns else metrics.withColumn("most", F.lit(None).cast("long"))
    name, timing = F.lower("metric"), F.col("type").isin("timing", "nsTiming")
    ms = F.when(F.col("type") == "nsTiming", F.col("value") / 1_000_000).otherwise(F.col("value").cast("double"))
    total = lambda where, v: F.sum(F.when(where, v))
    time = F.coalesce(total(timing & (name == "duration"), ms), total(timing & (name != "duration"), ms))
    peak = F.max(F.when(~timing & name.contains("peak memory"), F.coalesce("most", "value")))
    sizes = [F.max(F.when((F.col("type") == "size") & (name == n), F.col("value"))) for n in SIZES]
    return m.groupBy(*keys, "node_id").agg(
        total(name == "number of output rows", F.col("value")).cast("long").alias("rows_out"), F.round(time, 3).alias("time_ms"), peak.cast("long").alias("peak_mem"),
        total(~timing & name.contains("spill size") & ~name.contains("peak memory"), F.col("value")).cast("long").alias("spill_bytes"), F.coalesce(*sizes).cast("long").alias("data_bytes"),
    )


def hierarchy(jobs: DataFrame, stages: DataFrame, queries: DataFrame) -> DataFrame:
    """id, parent, kind, status: applications hold queries (under their root), queries or applications hold jobs, jobs hold stages.

    jobs: context, job_id, sql_execution_id, status; stages: context, stage_id, stage_attempt, job_id, status; queries: context, sql_execution_id, root_execution_id, status.
    """
    ident = lambda kind, *cols: F.concat_ws(":", F.lit(kind), "context", *cols)
    app = ident("app")
    q = queries.select(ident("query", "sql_execution_id").alias("id"), F.when(F.col("root_execution_id") != F.col("sql_execution_id"), ident("query", "root_execution_id")).otherwise(app).alias("parent"), F.lit("query").alias("kind"), "status")
    j = jobs.select(ident("job", "job_id").alias("id"), F.when(F.col("sql_execution_id").isNotNull(), ident("query", "sql_execution_id")).otherwise(app).alias("parent"), F.lit("job").alias("kind"), "status")
    s = stages.select(ident("stage", "stage_id", "stage_attempt").alias("id"), F.when(F.col("job_id").isNotNull(), ident("job", "job_id")).otherwise(app).alias("parent"), F.lit("stage").alias("kind"), "status")
    a = q.unionByName(j).unionByName(s).filter(F.col("parent").startswith("app:")).select(F.col("parent").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("parent"), F.lit("app").alias("kind"), F.lit(None).cast("string").alias("status"))
    return a.unionByName(q).unionByName(j).unionByName(s)


def flow(inside: DataFrame, table: DataFrame, shuffle: DataFrame) -> DataFrame:
    """src, dst, kind, n: a run's flow, from edges (src, dst) of three kinds: contained, by a table written and read, by a shuffle used again."""
    parts = [df.select("src", "dst", F.lit(kind).alias("kind")) for df, kind in ((inside, "inside"), (table, "table"), (shuffle, "shuffle"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.filter("src IS NOT NULL AND src <> dst").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
