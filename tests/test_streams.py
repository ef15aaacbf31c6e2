"""Stateful streams against their batch forms: late rows, keys that end, a restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagelens.operators import intervals as I
from stagelens.streaming import stateful as S

T0 = datetime(2024, 1, 1)
MINUTE = 60_000


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, df, folder, out):
    q = df.writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/{out}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


GC = "k string, at timestamp, v double, gone boolean"


def heaps(spark, folder):
    return S.carried_forward(spark.readStream.schema(GC).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in"), "at", ["k"], "v", "gone", "2 minutes")


def test_values_carried_forward_as_in_batch(rocksdb, tmp_path):
    """Two files before a restart, two after; the last row of all only moves the watermark."""
    spark, rng = rocksdb, random.Random(4)
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    some = sorted((at(rng.uniform(0, 40)), rng.choice("ab"), float(rng.randrange(100))) for _ in range(60))
    some = [(k, t, v, False) for t, k, v in some]
    files = [some[:20] + [("c", at(1), 5.0, False), ("n", at(2), None, False)], some[20:40] + [("c", at(some[20][1].minute + 3), None, True)], some[40:], [("z", at(90), 1.0, False), ("z", at(91), 1.0, False)]]
    for i in (0, 1):
        put(spark, files[i], GC, f"{tmp_path}/in", f"f{i}")
    run(spark, heaps(spark, tmp_path), tmp_path, "out")
    first = spark.read.parquet(f"{tmp_path}/out").count()
    for i in (2, 3):
        put(spark, files[i], GC, f"{tmp_path}/in", f"f{i}")
    put(spark, [("a", at(3), 999.0, False)], GC, f"{tmp_path}/in", "late")
    run(spark, heaps(spark, tmp_path), tmp_path, "out")
    got = {(r["k"], r["bucket"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 0 < first < len(got) == spark.read.parquet(f"{tmp_path}/out").count()
    rows = spark.createDataFrame([r for f in files for r in f], GC).withColumn("ms", F.unix_millis("at"))
    stops = {r["k"]: r["ms"] // MINUTE for r in rows.filter("gone").collect()}
    closed = max(b for _, b in got) // MINUTE
    df = rows.filter("v IS NOT NULL").withColumns({"b": F.floor(F.col("ms") / MINUTE), "o": F.struct("ms", "v"), "until": F.lit(closed)})
    want = {(r["k"], r["b"] * MINUTE): r["v"] for r in I.carried_forward(df, ["k"], "b", "o", "v", "until").collect() if r["b"] <= min(stops.get(r["k"], closed), closed)}
    assert got == want and closed >= (T0.timestamp() * 1000) // MINUTE + 40


def test_points_meet_spans_as_in_batch(spark, tmp_path):
    rng = random.Random(6)
    at = lambda s: T0 + timedelta(seconds=s)
    points = [(i, rng.choice(["a", "b", None]), at(rng.randrange(3000))) for i in range(80)]
    spans = [(i, rng.choice(["a", "b", None]), at(s), at(s + rng.randrange(600))) for i, s in enumerate(rng.randrange(3000) for _ in range(60))]
    ps, ss = "id long, k string, at timestamp", "span long, k string, s timestamp, e timestamp"
    for i in (0, 1):
        put(spark, sorted(points, key=lambda r: r[2])[i * 40 : i * 40 + 40], ps, f"{tmp_path}/p", f"f{i}")
        put(spark, sorted(spans, key=lambda r: r[2])[i * 30 : i * 30 + 30], ss, f"{tmp_path}/s", f"f{i}")
        read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
        run(spark, S.during(read("p", ps), read("s", ss), ["k"], "at", "s", "e", "1 hour", "30 minutes"), tmp_path, "out")  # the second run goes on from the first one's checkpoint
    got = sorted((r["id"], r["span"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((p[0], s[0]) for p in points for s in spans if p[1] and p[1] == s[1] and s[2] <= p[2] <= s[3])
    assert got == want != []
