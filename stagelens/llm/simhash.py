"""SimHash near-duplicates with pigeonring candidate filtering (Qin and Xiao, 2018).

A 64-bit fingerprint is cut into m segments on a ring. If two fingerprints differ in at most t bits, then from some segment on, every chain
of l consecutive segments differs in at most l * t / m bits. Chains shorter than m / t must so be equal: they are the join keys. The longer
chains prune the candidates before the full Hamming distance is taken.

Equal fingerprints are one class before any of this. Keys that many classes share are not joined pair by pair: two fingerprints are within t
bits (t even) if and only if some value is within t / 2 bits of both, and any two with such a value in common are within t. So each class with a
crowded key is sent to all values within t / 2 bits and linked to the least class it meets at each: exact, and linear in the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

SEED = 42


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        rows = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of width words, A-Z in lower case; of the whole sequence where it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= width:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    runs = zip(*(w[i:] for i in range(width)), strict=False)
    return np.array([xxh64_intdigest(b" ".join(r), SEED) for r in runs], dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text -> doc_id, fp (the fingerprint as a signed long)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([bit_majority(shingle_hashes(t.as_py(), width)) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fp long")


def _turned(fp: Column, bits: Column) -> Column:
    """fp turned left on the ring of its 64 bits."""
    return F.when(bits == 0, fp).otherwise(F.call_function("shiftleft", fp, bits).bitwiseOR(F.call_function("shiftrightunsigned", fp, F.lit(64) - bits)))


def pigeonring_links(classes: DataFrame, max_distance: int = 2, segments: int = 8, crowded: int = 32) -> DataFrame:
    """classes: rep (long), fp (distinct) -> u, v: links that join the same classes as all pairs within max_distance bits (0, or even) do.

    A key shared by at most `crowded` classes gives all its pairs within the distance; a crowded one, links through common midpoints.
    """
    if max_distance % 2 or not 0 < max_distance < segments or 64 % segments:
        raise ValueError("max_distance must be even and less than segments, which must divide 64")
    width = 64 // segments
    equal = -(-segments // max_distance) - 1  # so many segments in a row have no difference in common budget
    turn = (F.col("i") * width).cast("int")
    keys = classes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).withColumn("ring", _turned(F.col("fp"), turn))
    keys = keys.withColumn("key", F.call_function("shiftrightunsigned", "ring", F.lit(64 - equal * width))).select("i", "key", "ring", "rep", "fp")
    shared = keys.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keys = materialize(keys.join(shared, ["i", "key"]))

    few = keys.filter(F.col("n") <= crowded).drop("n")
    a, b = few.select("i", "key", F.col("ring").alias("ra"), F.col("rep").alias("u")), few.select("i", "key", F.col("ring").alias("rb"), F.col("rep").alias("v"))
    differ = F.col("ra").bitwiseXOR(F.col("rb"))
    viable = F.lit(True)
    for n in range(equal + 1, segments + 1):
        chain = F.call_function("shiftrightunsigned", differ, F.lit(64 - n * width)) if n < segments else differ
        viable = viable & (F.bit_count(chain) <= n * max_distance // segments)
    pairs = a.join(b, ["i", "key"]).filter((F.col("u") < F.col("v")) & viable).select("u", "v")

    near = keys.filter(F.col("n") > crowded).select("rep", "fp").distinct().withColumn("mid", F.col("fp"))
    flip = F.explode(F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {j})") for j in range(64)]))
    for _ in range(max_distance // 2):
        near = near.withColumn("flip", flip).select("rep", F.col("mid").bitwiseXOR(F.col("flip")).alias("mid"))
    least = near.groupBy("mid").agg(F.min("rep").alias("v"), F.count("*").alias("n")).filter("n > 1").select("mid", "v")
    met = near.join(least, "mid").filter("rep <> v").select(F.col("rep").alias("u"), "v")
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_distance: int = 2) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint (16 hexadecimal digits), component_id: the least doc_id reachable over links of at most max_distance bits.

    A null text is as one without words: fingerprint zero, linked like any other. Repeated doc_ids and texts give a row each; a document without
    id has a component only through others. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(pigeonring_links(classes.filter("rep IS NOT NULL"), max_distance))
    classes = classes.join(labels, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
