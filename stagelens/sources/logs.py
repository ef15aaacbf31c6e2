"""Text logs as tables: files, lines with a global sequence, parsed prefixes, signals, exceptions, collector pauses.

Lines keep their order in a file by the block they come from and their place in it: each block is a window of its own, and blocks and files are numbered by
their counts, so a large file is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelens.functions import text as T
from stagelens.operators import windows as W

#: Lines of a file that are one task's work where rows inherit from rows before them.
BLOCK_LINES = 1_000_000


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """file_path, size, modified, top (first folder below path) of every file; contents are not read."""
    base = path.rstrip("/").split("/")[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("top"))


def path_attributes(path: Column) -> list[Column]:
    """source, app_id, executor_id, spark_context_id from the folders of a path."""
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    source = F.when(path.rlike("/driver/"), "driver").when(path.rlike("/executor/"), "executor").when(path.rlike("/eventlog/"), "eventlog").when(path.rlike("/init_scripts/"), "init_script").otherwise("other")
    return [source.alias("source"), part(r"/executor/([^/]+)/").alias("app_id"), part(r"/executor/[^/]+/([^/]+)/").alias("executor_id"), part(r"/eventlog/[^/]+/([^/]+)/").alias("spark_context_id")]


def order_key(path: Column) -> Column:
    """Sorts files of a folder as written: by family, rolled ones before the active one, runs of digits by value."""
    name = F.element_at(F.split(path, "/"), -1)
    rolled = r"[-._]+\d[\d\-_T]*(?=\.|$)"
    family = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"^events_\d+_", "events_"), rf"[-._]+active(?=\.|$)|{rolled}", "")
    digits = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda d: F.lpad(d, 20, "0"))
    return F.struct(F.regexp_replace(path, r"/[^/]*$", "").alias("folder"), family.alias("family"), (~name.rlike(rolled)).alias("active"), F.array_join(digits, ".").alias("digits"), name.alias("name"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_no (from 1), seq (over all files in order) and line. Plain and .gz files; a carriage return at the end goes; a corrupt file ends early."""
    raw = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    numbered = raw.withColumn("__no", F.row_number().over(Window.partitionBy("file_path", "__block").orderBy("__id"))).drop("__id")
    blocks = numbered.groupBy("file_path", "__block").agg(F.count("*").alias("n"))
    in_file = Window.partitionBy("file_path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy(order_key(F.col("file_path")), "__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = blocks.select("file_path", "__block", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("__before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__start"))
    out = numbered.join(starts, ["file_path", "__block"])
    return out.select("file_path", (F.col("__before") + F.col("__no")).alias("line_no"), (F.col("__start") + F.col("__no")).alias("seq"), "line")


def log_lines(raw: DataFrame) -> DataFrame:
    """lines() with source attributes, ts, level, logger, message, continuation: a line without a prefix takes level and logger of the record above it, and its time."""
    parsed = raw.withColumn("__p", T.log_prefix(F.col("line"))).select(*raw.columns, *path_attributes(F.col("file_path")), "__p.*")
    indented = F.col("line").rlike(r"^\s+\S|^Caused by: ") | F.col("line").rlike(T.EXCEPTION)
    out = W.inherit(parsed.withColumn("__known", F.col("kind").isNotNull()), ["file_path"], ["seq"], F.col("__known") | ~indented, ["level", "logger"], BLOCK_LINES)
    return W.forward_fill(out.drop("__known"), ["file_path"], ["seq"], ["ts"], BLOCK_LINES)


def signals(lines: DataFrame, rules: Sequence[T.Signal], ignore: str | None = None) -> DataFrame:
    """Lines with the first signal that matches: the line's columns, signal, severity, fix. One combined pattern is tried first."""
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)
    return lines.filter(F.col("line").rlike(any_rule)).withColumn("__t", T.tag(F.col("line"), rules, ignore)).filter("__t IS NOT NULL").select(*lines.columns, "__t.*")


def errors(lines: DataFrame, framework: Sequence[str] = ("java.", "javax.", "jdk.", "sun.", "scala.", "org.apache.", "py4j.")) -> DataFrame:
    """Exception occurrences of log_lines: file_path, seq, exception, message, frames, fingerprint, user_frame."""
    own_time = F.col("kind").isNotNull()
    out = W.exception_groups(lines, "file_path", "seq", "line", T.EXCEPTION, T.FRAME, T.DUMP_HEADER, own_time, width=BLOCK_LINES)
    return out.withColumn("fingerprint", T.fingerprint(F.col("exception"), F.col("frames"))).withColumn("user_frame", T.user_frame(F.col("frames"), framework))


def gc_events(lines: DataFrame) -> DataFrame:
    """file_path, seq, ts and the pause's figures of collector lines."""
    text = F.when(F.col("kind") == "jvm", F.when(F.col("logger").startswith("gc"), F.col("message"))).otherwise(F.col("line"))
    return lines.withColumn("__g", T.gc_event(text)).filter("__g IS NOT NULL").select("file_path", "seq", "ts", "__g.*")


def conform(df: DataFrame, schema: object) -> DataFrame:
    """df with the schema's columns, types and order: missing ones null, others dropped, NaN null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.when(~F.isnan(c), c) if f.dataType.typeName() in ("double", "float") else c).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, schema: object, partition: str = "cluster_id") -> None:
    """A table of fixed schema as zstd Parquet; a run replaces only the partitions that it writes."""
    writer = conform(df, schema).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition in schema.fieldNames() else writer).parquet(path)
