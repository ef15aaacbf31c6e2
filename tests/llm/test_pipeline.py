"""The pipeline's stages on a small folder of tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from stagelens.llm import mixing, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.first()["text"]
    first = docs.filter("doc_id = 1").first()
    extra = [(5001, None, "en", "src0", None), (5002, "12 34 !!", "en", "src0", 8), (5003, first["text"], "en", "src1", 1), (5004, docs.filter("doc_id = 2").first()["text"] + " " + item, "en", None, 1), (None, "And then of the with an this that in on and the of it.", "en", "src1", 2)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert not {5001, 5002} & ids and before.count() - docs.count() <= 2 + 0.05 * before.count()
        if name == "near_duplicates":
            assert (1 in ids) != (5003 in ids) and len(ids) == docs.count()
        if name == "decontamination":
            assert 5004 not in ids and docs.count() >= 0.8 * before.count()
        if name != "sharding":
            assert docs.columns == COLUMNS
    shards = docs.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("k")).collect()
    assert len(shards) == 8 and all(r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["k"] == r["n"] for r in shards)
    assert max(r["n"] for r in shards) - min(r["n"] for r in shards) <= 1


def test_repeated_ids_and_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.unionByName(docs.limit(5)).unionByName(docs.filter("doc_id = 4").withColumn("text", F.lit("of the and to in that " * 9)))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, twice, folder).count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_benchmark_in_a_shared_id(spark, folder):
    """Of documents that share an id, or have none, only those that hold an item go."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    rows = [(i, t, "en", "src0", 1) for i in (None, 7) for t in ("a clean text of no item", "held: " + item, "another clean text")] + [(8, "a third", "en", "src0", 1)]
    kept = corpus_pipeline.remove_benchmark(spark, spark.createDataFrame(rows, docs.schema), folder).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((r[0], r[1]) for r in rows if not r[1].startswith("held")), key=str)


def test_what_grows_with_the_rows_is_not_sent_to_the_driver(spark, folder):
    """Uses of blocks and the communication matrix have a row or a number for each row of the input, whatever size Spark expects."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joins = lambda df, key: [x.strip(" +-:") for x in plan(df).splitlines() if "Join [" in x and key in x]
    for mix in (mixing.mixed_documents(docs), mixing.op7_mixing(spark, folder)):
        found = joins(mix, ", b#")
        assert found and all(x.startswith("SortMergeJoin") for x in found)
    found = joins(sharding.uniform_shards(docs, 8, ["doc_id", "text"]), "__p#")
    assert found and all(x.startswith("SortMergeJoin") for x in found)
