"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a local one only where that is unset and the executors are threads (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once below the shared folder and reads it back: cuts the lineage and survives a lost executor."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(n: int, size: int) -> int:
    """How many pieces of about size rows hold n rows; 1 at least."""
    return max(1, -(-n // size))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, end to end, and each row's start with the end of the last (null rows are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bits of the tables that say which values may be in a set. They are of fixed size, whatever the set; what they let through is joined with the set after.
TABLE_BITS = 1 << 27


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Packed:
    """An array that travels compressed; a worker unpacks it once."""

    def __init__(self, array: np.ndarray) -> None:
        self.kind, self.size = array.dtype.str, array.nbytes
        self.raw = pa.compress(np.ascontiguousarray(array).tobytes(), "zstd", asbytes=True)

    def array(self) -> np.ndarray:
        if not hasattr(self, "_array"):
            self._array = np.frombuffer(pa.decompress(self.raw, self.size, "zstd", asbytes=True), self.kind)
        return self._array

    def __getstate__(self) -> dict:
        return {"kind": self.kind, "size": self.size, "raw": self.raw}


def bit_table(values: DataFrame) -> Packed:
    """A table with a bit set for each value of the one long column of values. A few tables, each compressed, come to the driver one by one."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TABLE_BITS // 8, np.uint8)
        for b in batches:
            slot = mixed(b.column(0).to_numpy().view(np.uint64)) % np.uint64(TABLE_BITS)
            np.bitwise_or.at(held, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(held.tobytes(), "zstd", asbytes=True)], pa.binary())], ["bits"])

    out = np.zeros(TABLE_BITS // 8, np.uint8)
    for r in values.coalesce(8).mapInArrow(bits, "bits binary").toLocalIterator():
        out |= np.frombuffer(pa.decompress(r["bits"], TABLE_BITS // 8, "zstd"), np.uint8)
    return Packed(out)


@contextmanager
def sent(df: DataFrame, value: object) -> Iterator[Broadcast]:
    """A broadcast of value that is gone from all executors and their workers afterwards; what reads it must be written by then."""
    out = df.sparkSession.sparkContext.broadcast(value)
    try:
        yield out
    finally:
        out.destroy()


def in_bits(table: Packed, values: np.ndarray) -> np.ndarray:
    """Which values (long) may be in the set of a bit_table."""
    slot = mixed(values.view(np.uint64)) % np.uint64(TABLE_BITS)
    return table.array()[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0
