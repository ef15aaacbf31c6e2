"""Views on tables and reads: statistics per table, JDBC sources, MERGE facts and cycles, who read and wrote what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.operators import graph as G

# fixed values: credentials in a JDBC address, and the steps of a MERGE by how their description begins
CREDENTIAL = r"(?i)(password|user)=[^;&\s]+"
MATERIALIZE, SCANNING, REWRITING = "MERGE: materialize", "MERGE: scanning files", "MERGE: rewriting"
SOURCE_LENGTH = 120
# end of fixed values


def table_stats(scans: DataFrame) -> DataFrame:
    """table: scans, runs, size and files (of the largest scan; of one stream's batches together), files read and pruned, smallest and largest file, rows per file of the scan that saw most.

    scans, one row a query's scan of a table: table, run_key, query, stream and batch (null for none), files_read, files_pruned, bytes_read, bytes_pruned,
    min_file, max_file, rows.
    """
    s = scans.withColumn("size", F.col("bytes_read") + F.col("bytes_pruned")).withColumn("n_files", F.col("files_read") + F.col("files_pruned"))
    best = F.when((F.col("files_read") > 0) & (F.col("rows") > 0), F.struct("size", "query"))
    out = s.groupBy("table").agg(
        F.count("*").alias("scans"), F.countDistinct("run_key").alias("runs"), F.max("size").alias("size"), F.max_by("n_files", F.struct("size", "n_files")).alias("files"),
        F.sum("files_read").alias("files_read"), F.sum("files_pruned").alias("files_pruned"), F.min(F.when(F.col("files_read") > 0, F.nullif("min_file", F.lit(0)))).alias("min_file"), F.max("max_file").alias("max_file"),
        F.max_by(F.round(F.col("rows") / F.nullif("files_read", F.lit(0))), best).cast("long").alias("rows_per_file"), F.countDistinct("stream").alias("__streams"), F.bool_and(F.col("stream").isNotNull()).alias("__all"),
    )
    batches = s.filter("stream IS NOT NULL").groupBy("table", "stream", "batch").agg(F.max("size").alias("size"), F.max("n_files").alias("n"))
    batches = batches.groupBy("table").agg(F.count("*").alias("batches"), F.sum("size").alias("__size"), F.sum("n").alias("__files"))
    out = out.join(batches, "table", "left")
    streamed = F.coalesce(F.col("__all") & (F.col("__streams") == 1) & (F.col("batches") > 1), F.lit(False))
    out = out.withColumns({"size": F.when(streamed, F.col("__size")).otherwise(F.col("size")), "files": F.when(streamed, F.col("__files")).otherwise(F.col("files")), "batches": F.when(streamed, F.col("batches"))})
    return out.drop("__streams", "__all", "__size", "__files")


def masked_source(address: Column) -> Column:
    """A JDBC source without user names and passwords."""
    return F.substring(F.regexp_replace(address, CREDENTIAL, "$1=..."), 1, SOURCE_LENGTH)


def jdbc_reads(reads: DataFrame) -> DataFrame:
    """source: rows, queries, runs, most partitions, time, and the largest task's rows with the median beside it. reads: address, run_key, rows, partitions, ms, max_task_rows, p50_task_rows."""
    return reads.groupBy(masked_source(F.col("address")).alias("source")).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("queries"), F.countDistinct("run_key").alias("runs"), F.max("partitions").alias("partitions"), F.sum("ms").alias("ms"),
        F.max("max_task_rows").alias("max_task_rows"), F.max_by("p50_task_rows", F.struct("max_task_rows", "p50_task_rows")).alias("p50_task_rows"),
    )


def jdbc_steps(reads: DataFrame, query_key: str, order: Sequence[str]) -> DataFrame:
    """reads with repeat: how many earlier reads sent the same query, and first_query: the one that did first."""
    w = Window.partitionBy(query_key).orderBy(*order)
    return reads.withColumn("repeat", F.row_number().over(w) - 1).withColumn("first_query", F.first("sql_execution_id").over(w))


def read_split(stages: DataFrame, plan_metrics: DataFrame) -> DataFrame:
    """context, sql_execution_id: bytes from storage, from a DataFrame cache (null where no stage knows), and the disk cache's hits (of the stages, else of the plan), misses and writes.

    stages: storage_bytes, df_cache_bytes, disk_cache_bytes, failed; plan_metrics: name, total.
    """
    keys = ["context", "sql_execution_id"]
    s = stages.filter(~F.col("failed")).groupBy(*keys).agg(F.sum("storage_bytes").alias("storage_read"), F.sum("df_cache_bytes").alias("cache_read"), F.sum("disk_cache_bytes").alias("__hit"))
    of = lambda n: F.sum(F.when(F.col("name") == n, F.col("total")))
    m = plan_metrics.groupBy(*keys).agg(of("cache hits size").alias("__plan_hit"), of("cache misses size").alias("miss"), of("cache writes size").alias("written"))
    return s.join(m, keys, "full").withColumn("hit", F.coalesce("__hit", "__plan_hit")).drop("__hit", "__plan_hit")


def learnt_names(paths: DataFrame) -> DataFrame:
    """table_id, name: the name that a table's id goes by in most plans. paths: table_id, name."""
    per = paths.filter("table_id IS NOT NULL AND name IS NOT NULL").groupBy("table_id", "name").agg(F.count("*").alias("n"))
    return per.groupBy("table_id").agg(F.max_by("name", F.struct("n", "name")).alias("name"))


def with_names(df: DataFrame, ident: Sequence[str], column: str, names: DataFrame, pattern: str) -> DataFrame:
    """ident, column: the list with paths (whose id the pattern takes) replaced by names; others stay, order and repeats too."""
    rows = df.select(*ident, F.posexplode(column).alias("__p", "__x")).withColumn("table_id", F.regexp_extract("__x", pattern, 1))
    rows = rows.join(names, "table_id", "left").withColumn("__x", F.coalesce("name", "__x"))
    return rows.groupBy(*ident).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__x"))), lambda r: r["__x"]).alias(column))


def merge_cycles(queries: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, cycle, steps, first and last statement, start, end, bytes of the source's copy and scans of the target that read something.

    A cycle begins where a MERGE materializes its source, or at the key's first MERGE step. queries: sql_execution_id, description, input_bytes, start_ms, end_ms.
    """
    d = F.col("description")
    m = queries.filter(d.startswith("MERGE"))
    w = Window.partitionBy(*keys).orderBy(*order)
    m = m.withColumn("cycle", F.sum((d.startswith(MATERIALIZE) | (F.row_number().over(w) == 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(*keys, "cycle").agg(
        F.count("*").alias("steps"), F.min("sql_execution_id").alias("first_step"), F.max("sql_execution_id").alias("last_step"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.sum(F.when(d.startswith(MATERIALIZE), F.col("input_bytes"))).alias("source_copy_bytes"), F.count_if((d.startswith(SCANNING) | d.startswith(REWRITING)) & (F.col("input_bytes") > 0)).alias("target_scans"),
    )


def merge_facts(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """context, sql_execution_id of each MERGE write step: bytes and rows read of the target and of the source's copy, files it rewrites, source rows, and rows updated and inserted.

    steps: description, output_records, dv_on, cdf_on; stages: kind ('target', 'copy', else), failed, input_bytes, input_records, shuffle_write_records.
    Updated and inserted are known only with deletion vectors, where the rows out are the source's, plus twice the updated ones and the inserted ones
    with a change feed; else they are null.
    """
    keys = ["context", "sql_execution_id"]
    ok = stages.filter(~F.col("failed"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.coalesce(c, F.lit(0))))
    s = ok.groupBy(*keys).agg(
        *[of(k, F.col(c)).alias(n) for k, c, n in (("target", "input_bytes", "target_bytes"), ("target", "input_records", "target_rows"), ("copy", "input_bytes", "copy_bytes"), ("copy", "input_records", "copy_rows"), ("target", "shuffle_write_records", "matched"))],
        F.nullif(of("copy", F.coalesce(F.nullif("shuffle_write_records", F.lit(0)), "input_records")), F.lit(0)).alias("source_rows"),
    )
    out = steps.filter(F.col("description").startswith(REWRITING)).join(s, keys, "left")
    out = out.withColumn("files_touched", F.regexp_extract("description", r"(?i)rewriting (\d+) files", 1).try_cast("long")).withColumn("output", F.nullif("output_records", F.lit(0)))
    src, hit, rows = F.col("source_rows"), F.col("matched"), F.col("output")
    known = F.coalesce(F.col("dv_on") & (hit <= src) & F.when(F.col("cdf_on"), rows == src + 2 * hit + (src - hit)).otherwise(rows == src), F.lit(False))
    return out.select(*keys, "target_bytes", "target_rows", "copy_bytes", "copy_rows", "files_touched", "source_rows", F.when(known, hit).alias("updated"), F.when(known, src - hit).alias("inserted"))


def duplicate_causes(failed: DataFrame, dedups: DataFrame, batch: Sequence[str]) -> DataFrame:
    """failed MERGEs (batch, merge_keys) with how their source was deduplicated (batch, function, partition_keys, keeps_ties): extra and missing keys, and the cause."""
    out = failed.join(dedups, list(batch), "left")
    extra, missing = F.array_except("partition_keys", "merge_keys"), F.array_except("merge_keys", "partition_keys")
    cause = F.when(F.col("partition_keys").isNull(), "not deduplicated").when(F.size(extra) > 0, "deduplicated on more keys than the MERGE joins").when(F.col("keeps_ties"), "ties kept").otherwise("unclear")
    return out.withColumns({"extra_keys": extra, "missing_keys": missing, "cause": cause})


def run_tables(facts: DataFrame) -> DataFrame:
    """run_key, table: queries that read and wrote it, bytes read, and fed_by: the last run that had finished writing it before this one first read it.

    facts: run_key, sql_execution_id, table, how ('read' or 'write'), bytes, start_ms, end_ms.
    """
    per = facts.groupBy("run_key", "table").agg(F.count_if(F.col("how") == "read").alias("reads"), F.count_if(F.col("how") == "write").alias("writes"), F.sum(F.when(F.col("how") == "read", F.col("bytes"))).alias("bytes"), F.min(F.when(F.col("how") == "read", F.col("start_ms"))).alias("__first"))
    reads = per.filter("__first IS NOT NULL").select("table", F.col("__first").alias("start_ms"), "run_key")
    writes = facts.filter("how = 'write'").select("table", "end_ms", "run_key")
    fed = G.lineage_edges(writes, reads, "table", "run_key", "start_ms", "end_ms").select(F.col("dst").alias("run_key"), "table", F.col("src").alias("fed_by"))
    return per.drop("__first").join(fed, ["run_key", "table"], "left")
