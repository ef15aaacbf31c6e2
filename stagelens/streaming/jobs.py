"""The batch operators that make sense on a stream, as Structured Streaming jobs with watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signals_per_minute(stream: DataFrame, at: str, keys: Sequence[str], late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """bucket, keys, n over tumbling windows; rows later than the watermark are left out."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), *keys, "n")


def busy_stretches(stream: DataFrame, at: str, keys: Sequence[str], gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """keys, start, end, n: sessions of rows within gap of each other; end is the last row's time plus the gap."""
    counted = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_fingerprints(stream: DataFrame, at: str, fingerprint: str, late: str = "1 hour") -> DataFrame:
    """The first row of each fingerprint within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([fingerprint])


def latest_per_key(stream: DataFrame, at: str, keys: Sequence[str], value: str, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """bucket, keys, value: the last value of each key in each window."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.max_by(value, at).alias(value))
    return w.select(F.col("w.start").alias("bucket"), *keys, value)
