"""Operators on streams that keep state of their own: values carried forward by event-time timers, and interval joins of two streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _CarriedForward(StatefulProcessor):
    """Per key: the buckets seen but not closed (bucket -> time, value), and the last closed one with its value. A timer stands at the end of the next bucket to close."""

    def __init__(self, keys: Sequence[str], bucket: str, value: str, width: int):
        self.keys, self.bucket, self.value, self.width = list(keys), bucket, value, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket long", "at long, value double, ended boolean")
        self.closed = handle.getValueState("closed", "bucket long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news: dict[int, tuple] = {}
        for part in rows:
            for at, value, ended in zip(*(part.iloc[:, i] for i in (-3, -2, -1)), strict=True):
                if pd.isna(value) and not ended:
                    continue
                b = int(at) // self.width * self.width
                row = (None, None, True) if pd.isna(value) else (int(at), float(value), bool(ended))
                news[b] = _both(news.get(b), row)
        fresh = not self.closed.exists() and not any(True for _ in self.open.keys())
        for b, row in news.items():
            self.open.updateValue((b,), _both(tuple(self.open.getValue((b,))) if self.open.containsKey((b,)) else None, row))
        if news and fresh:
            self.handle.registerTimer(min(news) + self.width)
        elif news and not self.closed.exists():  # an earlier first bucket than the one that the timer stands at
            timers = list(self.handle.listTimers())
            if not timers or min(news) + self.width < min(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(min(news) + self.width)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = expiredTimerInfo.getExpiryTimeInMs() - self.width
        now = timerValues.getCurrentWatermarkInMs()
        value = self.closed.get()[1] if self.closed.exists() else None
        waiting = sorted((k[0], tuple(v)) for k, v in self.open.iterator())
        out, going = [], True
        while going and b + self.width <= now:
            if waiting and waiting[0][0] <= b:
                _, (_, last, ended) = waiting.pop(0)
                value = value if last is None else last
                self.open.removeKey((b,))
                going = not ended
            if value is not None:
                out.append((b, value))
            b += self.width
        if going:
            self.closed.update((b - self.width, value))
            self.handle.registerTimer(b + self.width)
        else:  # it ended; what came for later buckets begins anew
            self.closed.clear()
            if waiting:
                self.handle.registerTimer(waiting[0][0] + self.width)
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=[*self.keys, self.bucket, self.value])


def _both(a: tuple | None, b: tuple) -> tuple:
    """Of two rows (time, value, ended) of a bucket: the later one with a value (of equal times the greater value), ended if either is."""
    if a is None:
        return b
    last = max(((r[0], r[1]) for r in (a, b) if r[1] is not None), default=(None, None))
    return (*last, a[2] or b[2])


def carried_forward(stream: DataFrame, at: str, keys: Sequence[str], value: str, ended: str | None = None, late: str = "10 minutes", width: int = 60_000) -> DataFrame:
    """keys, bucket (epoch ms), value: the last value of each key at or before the end of each bucket, from its first one on, given out once the watermark has passed the bucket.

    A key goes on in buckets without rows until a row where `ended` (a boolean column) holds; that row's bucket is its last one, and a value in it counts. Rows without a value change nothing; of equal times
    the greatest value counts. Rows later than the watermark are left out. State is one value a key and those of buckets still open. The state store must be RocksDB.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    end = F.coalesce(F.col(ended), F.lit(False)) if ended else F.lit(False)
    rows = stream.withWatermark(at, late).select(at, *keys, F.unix_millis(at).alias("__ms"), F.col(value).cast("double").alias("__value"), end.alias("__ended"))
    fields = [stream.schema[k] for k in keys]
    schema = StructType(fields).add("bucket", "long").add("value", "double")
    return rows.groupBy(*keys).transformWithStateInPandas(_CarriedForward(keys, "bucket", "value", width), schema, "Append", "EventTime")


def during(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """points with the columns of each span of their keys that they fall in (start <= at <= end): the interval join of two streams.

    A span is at most `longest`; one that is longer is found for points within `longest` of its start. Points and spans may come in any order, each as late as the watermark; both sides' state is let go once
    no partner can come any more. Null keys and times meet nothing.
    """
    p = points.withWatermark(at, late).alias("p")
    s = spans.withWatermark(start, late).select(*[F.col(k).alias(f"__{k}") for k in keys], start, end, *[c for c in spans.columns if c not in (*keys, start, end)]).alias("s")
    meet = F.expr(f"`{start}` <= `{at}` AND `{at}` <= `{end}` AND `{at}` <= `{start}` + INTERVAL {longest}")
    for k in keys:
        meet = meet & (F.col(f"p.{k}") == F.col(f"s.__{k}"))
    return p.join(s, meet).drop(*[f"__{k}" for k in keys])
