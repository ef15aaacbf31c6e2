"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, in a fixed order of its documents, are a stream cut into blocks of equal length. An output of as many
blocks as the targets ask for is cut into shards; how many slots of a shard each source gets is a multinomial draw
conditioned on the sources' totals (independent draws would miss the targets by the square root of their counts and could
use a block a third time): the slots of all sources are dealt over the output by a pseudorandom permutation and counted by
shard. A source numbers its slots over the shards, maps each number to a block by a permutation of its own block indices (a
new pass begins when all have been used), and the blocks are joined by index.

The permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012): bijections of any range without a search, with
hashes of (key, round, index) as coins. So reruns agree, and no task keeps a table of indices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, table, words

ROUNDS = 12
#: Sources up to this many are sent to all tasks; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0 to n - 1, chosen by key, sends index."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(key, r, F.lit("k")) % n - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, partner)) % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with sid (0, 1, ... by code point, null last) and target.

    The weights repeat over the sources. The targets sum to share of all sizes; none exceeds cap times its source's size, what is
    above goes to the others by weight. One row a source: the windows without keys see nothing larger.
    """
    all_rows = Window.partitionBy()
    by_room = Window.orderBy("room", "sid")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("w", w)
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("most") / F.col("w"))
    ranked = ranked.withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("rest_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.col("rest") / F.col("rest_w")
    ranked = ranked.withColumn("level", F.max(F.when(level <= F.col("room"), level)).over(all_rows))
    return ranked.select("sid", "source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("level"))).alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 128, blocks_at_least: int = 256, slots_per_shard: int = 4096, rows_per_task: int = 20_000, seed: int = 7, ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """sized: (doc_id, source, size, ...) -> pieces of documents and uses of blocks.

    pieces has a row for each document and block it reaches into (one with null block for a document without words): the columns
    of sized, sid, source_size, target, row (a key of the document's row), b, from_word, n_words. uses: sid, b, pass (0, 1), shard, g.
    A source shorter than block * blocks_at_least words has shorter blocks, so that its target is met as finely. ties: columns of sized that
    order documents of equal doc_id and size.
    """
    n = sized.count()
    bins = pieces(n, rows_per_task)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(by_source, weights, share, cap)
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / blocks_at_least))).cast("long")
    src = src.withColumn("len", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("len")).cast("long"))
    slots = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("blocks") * F.lit(float(cap))), F.round(F.col("target") * F.col("blocks") / F.col("source_size"))))
    src = src.withColumn("slots", slots.cast("long"))
    src = src.withColumn("slots_before", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    src = materialize(src.withColumn("all_slots", F.sum("slots").over(Window.partitionBy())).coalesce(1))
    few = src.count() <= BROADCAST_SOURCES
    sent = F.broadcast(src) if few else src

    # where each document's words stand in its source's stream: a running sum in each bin, after the bins before it
    in_bin = Window.partitionBy("sid", "bin").orderBy("doc_id", "size", *ties)
    docs = sized.join(sent.select("sid", F.col("source").alias("__s"), "source_size", "target", "len"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    docs = docs.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(bins)))
    totals = docs.groupBy("sid", "bin").agg(F.sum("size").alias("bin_size"))
    totals = totals.select("sid", "bin", F.coalesce(F.sum("bin_size").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bin_start"))
    docs = docs.withColumn("rn", F.row_number().over(in_bin)).withColumn("before", F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    docs = docs.join(totals, ["sid", "bin"]).withColumn("at", F.col("before") + F.col("bin_start")).withColumn("row", F.struct("sid", "bin", "rn"))
    last = F.floor((F.col("at") + F.col("size") - 1) / F.col("len"))
    parts = docs.withColumn("b", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / F.col("len")), last))))
    start, end = F.greatest(F.col("b") * F.col("len"), F.col("at")), F.least((F.col("b") + 1) * F.col("len"), F.col("at") + F.col("size"))
    parts = parts.withColumn("from_word", start - F.col("at")).withColumn("n_words", F.coalesce(end - start, F.lit(0)))
    parts = parts.drop("len", "bin", "rn", "before", "bin_start", "at")

    # slots of each source in each output shard
    step = 8192
    chunks = src.filter("slots > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / step))))
    chunks = chunks.repartition(spread(sized), "sid", "c")
    g = chunks.withColumn("g", F.explode(F.sequence(F.col("c") * step, F.least(F.col("slots"), (F.col("c") + 1) * step) - 1)))
    place = permuted(F.col("slots_before") + F.col("g"), F.col("all_slots"), F.lit(seed))
    counts = g.groupBy("sid", F.floor(place / slots_per_shard).alias("shard")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.join(sent.select("sid", "blocks"), "sid").repartition(spread(sized), "sid", "shard")
    uses = counts.withColumn("g", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    uses = uses.withColumn("pass", F.floor(F.col("g") / F.col("blocks")))
    uses = uses.withColumn("b", permuted(F.col("g") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "sid", "pass")))
    # as many rows as blocks are used: Spark takes them for few, as their ranges are, and would send all of them through the driver
    return parts, uses.select("sid", "b", "pass", "shard", "g").hint("merge")


def spread(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def taken(sized: DataFrame, **params: object) -> DataFrame:
    """The rows of sized (doc_id, source, size) with source_size, target and taken: how many words the mix takes of each.

    A null source is a source, the last in order; a document of size 0 is taken 0 times; rows that repeat count each for itself;
    an empty table gives an empty result. taken is at most cap * size.
    """
    parts, uses = plan(sized, **params)
    used = uses.groupBy("sid", "b").agg(F.count("*").alias("times")).hint("merge")
    joined = parts.join(used, ["sid", "b"], "left")
    return joined.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).drop("row")


#: Where a new word begins: behind white space, before anything else.
WORD_START = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def mixed_documents(docs: DataFrame, **params: object) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the mix as rows of the same columns: for each document and pass, its words that the pass takes, in order.

    A document that a pass takes whole keeps its text; of others the words keep the white space behind them. n_chars, if there, is the new text's
    length. Documents without words are not in a mix. Other columns stay; names of docs that begin with two underscores are reserved.
    """
    h = F.xxhash64("text")
    keyed = docs.withColumn("__h", h)
    if docs.groupBy("doc_id", h.alias("__h")).count().filter("count > 1").isEmpty():
        keyed = keyed.withColumn("__copy", F.lit(0))
    else:
        keyed = keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("source")))
    sized = materialize(keyed.select("doc_id", "source", words(F.col("text")).alias("size"), "__h", "__copy"))
    parts, uses = plan(sized, ties=("__h", "__copy"), **params)
    taken = parts.join(uses, ["sid", "b"]).groupBy("doc_id", "__h", "__copy", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__cut"), F.sum("n_words").alias("__n"))
    taken = taken.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__g"), F.col("__copy").alias("__c"), "__cut", (F.col("__n") == F.col("size")).alias("__whole"))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g")) & (F.col("__copy") == F.col("__c")))
    split = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), WORD_START, -1)
    cut = F.array_join(F.transform("__cut", lambda c: F.array_join(F.slice(F.col("__words"), (c["from_word"] + 1).cast("int"), c["n_words"].cast("int")), "")), "")
    out = joined.withColumn("__words", F.when(~F.col("__whole"), split)).withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size")))
    return taken(sized)
