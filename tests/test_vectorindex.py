"""The stored vector index: recall against exact search, pruning, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.config import VectorIndexConfig
from lodestone.operators import retrieval, vectorindex

VECTOR = "chunk_id long, vector array<float>"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(12, 16))
    x = (heart[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    chunks = spark.createDataFrame(rows, VECTOR).withColumn("code", F.lit("clash")).withColumn("list", F.lit(-1))
    path = f"{tmp_path_factory.mktemp('vectors')}/i"
    vectorindex.build(chunks, path, VectorIndexConfig(dim=16, lists=12), rounds=6)
    return path, chunks


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def test_all_lists_give_the_exact_result(spark, index, monkeypatch):
    path, chunks = index
    asked = chunks.where("chunk_id % 30 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    want = rows(retrieval.vector_topk(asked, chunks.where("chunk_id < 900"), 10))
    assert rows(vectorindex.search(asked, path, 10, probes=12)) == want
    monkeypatch.setattr(vectorindex, "QUERY_BLOCK", 7)
    assert rows(vectorindex.search(asked, path, 10, probes=12)) == want


def test_recall_and_pruning_with_few_probes(spark, index):
    path, chunks = index
    asked = chunks.where("chunk_id < 200").select(F.col("chunk_id").alias("query_id"), "vector")
    want = {r[:2] for r in rows(retrieval.vector_topk(asked, chunks.where("chunk_id < 900"), 10))}
    got = {r[:2] for r in rows(vectorindex.search(asked, path, 10, probes=4))}
    assert len(got & want) >= 0.9 * len(want)
    plan = vectorindex.search(asked.where("query_id = 3"), path, 10, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "code" in plan


def test_odd_queries_and_an_empty_index(spark, index, tmp_path):
    path, chunks = index
    odd = chunks.where("chunk_id >= 900 OR chunk_id IS NULL").select(F.col("chunk_id").alias("query_id"), "vector")
    assert vectorindex.search(odd, path, 3).count() == 0
    vectorindex.build(chunks.where("chunk_id >= 900"), f"{tmp_path}/none", VectorIndexConfig(dim=16, lists=3))
    assert vectorindex.search(chunks.select(F.col("chunk_id").alias("query_id"), "vector"), f"{tmp_path}/none", 3).count() == 0
    with pytest.raises(ValueError):
        vectorindex.build(chunks, f"{tmp_path}/x", VectorIndexConfig(dim=1 << 13, lists=1 << 13))


def test_more_copies_than_candidates_give_the_smallest_ids(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 16)).astype(np.float32)
    far_first = spark.createDataFrame([(i, x[i % 30].tolist()) for i in range(2999, -1, -1)], VECTOR).coalesce(1)
    vectorindex.build(far_first, f"{tmp_path}/copies", VectorIndexConfig(dim=16, lists=4), rounds=2)
    asked = far_first.where("chunk_id < 30").select(F.col("chunk_id").alias("query_id"), "vector")
    assert rows(vectorindex.search(asked, f"{tmp_path}/copies", 10, probes=4)) == rows(retrieval.vector_topk(asked, far_first, 10))


def test_a_task_passes_on_the_best_of_all_its_batches(spark, index):
    path, chunks = index
    lists = spark.read.parquet(f"{path}/lists").coalesce(1)
    centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()])
    q = np.random.default_rng(6).normal(size=(3, 16))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = vectorindex._scan(lists, [5, 6, 7], q, centers, {c: np.arange(3) for c in range(12)}, 4, LongType(), "bigint")
        assert max(r["count"] for r in found.groupBy("query_id", "list").count().collect()) == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
