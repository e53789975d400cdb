"""Requests and frozen rankings stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVAL_REQUEST, REQUEST, SNAPSHOT


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Questions, one JSON object a line; malformed JSON stops the job, absent fields are null."""
    return spark.read.schema(REQUEST).option("mode", "FAILFAST").json(path)


def read_eval_requests(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation requests, one JSON object a line; ``evaluation.validate_requests`` says which may run."""
    return spark.read.schema(EVAL_REQUEST).option("mode", "FAILFAST").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``(sha256, snapshot)``: one row a file, the digest of its bytes and its content."""
    raw = spark.read.format("binaryFile").load(path)
    parsed = F.from_json(F.col("content").cast("string"), SNAPSHOT, {"mode": "FAILFAST"})
    return raw.select(F.sha2("content", 256).alias("sha256"), parsed.alias("snapshot"))


def snapshot_tables(snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, judgments and ranked lists of a snapshot; a query's place is its ``query_id``."""
    q = snapshots.select(F.posexplode("snapshot.queries").alias("query_id", "q"))
    samples = q.select("query_id", "q.question", "q.category")
    qrels = q.select("query_id", F.explode("q.relevantChunkIds").alias("chunk_id"))
    lists = [q.select("query_id", F.lit(r).alias("route"), F.posexplode(f"q.{r}").alias("pos", "chunk_id")) for r in ("vector", "bm25")]
    runs = lists[0].unionByName(lists[1]).withColumn("pos", F.col("pos") + 1)
    return samples, qrels, runs
