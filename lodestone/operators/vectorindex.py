"""A stored vector index: lists around trained centroids as partitions on disk, residual codes, exact reranking.

Under a path: ``centers`` ``(list, center)``, and ``lists``, partitioned by ``list``, with ``chunk_id``,
``vector`` and what approximates it without reading it: ``code``, the signed bytes of its
residual from the centroid, and ``step``, what one unit of the code is worth.
``units`` holds the unit vectors that a build trains and places, dealt by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..config import VectorIndexConfig
from ..functions.vectors import cosine, unit
from . import scoring
from .retrieval import DIGITS, top_k

#: Queries that are compared with a list at once; of more, blocks are taken one after the other.
QUERY_BLOCK = 2_000
#: Candidates by code that are compared exactly, for each result asked for.
REFINE = 4
#: Rows that are compared with a block of queries at once.
ROWS = 1024
#: Centroids times dimensions that an index may have: they are in every task.
MAX_CENTERS = 1 << 25


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, v)``: unit vectors of ``dim`` finite components; others are left out."""
    v = unit(F.col(vector_col))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.0 + 1e-9))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dim)).where(whole)


def train(units: DataFrame, config: VectorIndexConfig, rounds: int = 10) -> np.ndarray:
    """Centroids of ``(id, v)`` by k-means on the sphere over all rows.

    It begins with the ``config.lists`` vectors of smallest hash.  A round is one pass: each task adds up its
    vectors by nearest centroid, the sums of the tasks are added by list, and what comes to
    the driver is a row for each list.  A list that gets no vector keeps its centroid.
    """
    first = units.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(config.lists).select("v").collect()
    centers = np.array([r["v"] for r in first], np.float64).reshape(len(first), config.dim)
    for _ in range(rounds if len(first) else 0):
        now = centers

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)  # noqa: B023 - used in this round only
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0))
                    np.add.at(total, np.argmax(x @ now.T, axis=1), x)  # noqa: B023
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["list", "s"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"list": t.column("list")[:1], "s": pa.array([_matrix(t.column("s").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

        got = units.select("v").mapInArrow(sums, "list int, s array<double>").groupBy("list").applyInArrow(add, "list int, s array<double>").collect()
        centers = now.copy()
        for r in got:
            s = np.array(r["s"])
            centers[r["list"]] = s / max(np.linalg.norm(s), 1e-12)
    return centers


def build(vectors: DataFrame, path: str, config: VectorIndexConfig, rounds: int = 10, vector_col: str = "vector") -> None:
    """Index ``vectors(chunk_id, vector)`` at ``path``, replacing what is there.

    Vectors that are null, zero, of another length or with components that are null or not finite
    match nothing and are left out.  Large lists are spread over several files.  Vectors are dealt by id
    and made unit vectors once, however few tasks their files make; each round of training reads those.
    """
    spark = vectors.sparkSession
    if config.lists * config.dim > MAX_CENTERS:
        raise ValueError(f"lists times dim must be at most {MAX_CENTERS}")
    dealt = vectors.select("chunk_id", vector_col).repartition("chunk_id")
    made = _units(dealt, "chunk_id", vector_col, config.dim)
    made.write.mode("overwrite").parquet(f"{path}/units")
    units = spark.read.schema(made.schema).parquet(f"{path}/units")
    kind = units.schema["id"].dataType.simpleString()
    centers = train(units, config, rounds)
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            own = np.argmax(x @ centers.T, axis=1)
            rest = x - centers[own]
            step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            code = np.rint(rest / step[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(own.astype(np.int32))], ["chunk_id", "vector", "code", "step", "list"])

    placed = units.mapInArrow(place, f"chunk_id {kind}, vector array<double>, code binary, step double, list int")
    placed.withColumn("vector", F.col("vector").cast("array<float>")).repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    if placed.limit(1).isEmpty():
        spark.createDataFrame([], f"chunk_id {kind}, vector array<float>, code binary, step double").write.mode("overwrite").parquet(f"{path}/lists/list=0")


def search(queries: DataFrame, path: str, k: int = 20, probes: int = 10, threshold: float = 0.0, vector_col: str = "vector") -> DataFrame:
    """``(query_id, chunk_id, score, rank, source)``: the best by cosine in the ``probes`` lists nearest to each query.

    Only those lists' folders are read, and of them the codes; the ``REFINE * k`` best by code are compared
    exactly.  Queries that are null or not of the index's dimension find nothing; rows that
    repeat a query id are searched as one, by the largest vector.
    """
    spark = queries.sparkSession
    read = spark.read.parquet(f"{path}/centers").orderBy("list").collect()  # MAX_CENTERS bounds it
    dim = len(read[0]["center"]) if read else 0
    centers = np.array([r["center"] for r in read], np.float64).reshape(len(read), dim)
    lists = spark.read.parquet(f"{path}/lists")
    chunk = lists.schema["chunk_id"].dataType.simpleString()
    asked = _units(queries, "query_id", vector_col, dim).groupBy("id").agg(F.max("v").alias("v"))
    kind = asked.schema["id"].dataType
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for n in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)).orderBy("id").collect()  # about QUERY_BLOCK
        ids, q = [r["id"] for r in part], np.array([r["v"] for r in part], np.float64).reshape(len(part), dim)
        near = np.argsort(-(q @ centers.T), axis=1, kind="stable")[:, :probes]
        probing = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
        found_in = _scan(lists.where(F.col("list").isin(list(probing))), ids, q, centers, probing, k * REFINE, kind, chunk)
        found = found_in if found is None else found.unionByName(found_in)
    best = top_k(found.withColumn("score", F.round("near", DIGITS)), k * REFINE).select("query_id", "chunk_id", "list")
    exact = best.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(lists.select("chunk_id", "list", "vector"), ["list", "chunk_id"])
    scored = exact.select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("vector")), DIGITS).alias("score")).where(F.col("score") >= threshold)
    return top_k(scored.dropDuplicates(["query_id", "chunk_id"]), k).withColumn("source", F.lit("vector"))


def _scan(lists: DataFrame, ids: list, q: np.ndarray, centers: np.ndarray, probing: dict[int, np.ndarray], most: int, kind: DataType, chunk: str) -> DataFrame:
    """``(query_id, chunk_id, list, near)``: of each task and list the best by code for every query that probes the list; of equal ones the smaller ids."""
    names = pa.array(ids, to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, scoring.Best] = {}
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(scoring.ascending(b.column(0))))
            own, step = b.column(3).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8).reshape(b.num_rows, q.shape[1])
            for c in np.unique(own).tolist():
                rows, who = np.flatnonzero(own == c), probing[c]
                kept = best.setdefault(c, scoring.Best(len(who), most))
                for a in range(0, len(rows), ROWS):
                    at = rows[a : a + ROWS]
                    x, chunks = code[at].T.astype(np.float64), b.column(0).take(pa.array(at))
                    for first in range(0, len(who), scoring.QUERIES):
                        asked = q[who[first : first + scoring.QUERIES]]
                        kept.offer(first, chunks, (asked @ centers[c])[:, None] + (asked @ x) * step[at])
        for c, kept in best.items():
            for found in scoring.emitted(kept, names.take(pa.array(probing[c]))):
                yield pa.RecordBatch.from_arrays([*found.columns[:2], pa.array(np.full(found.num_rows, c, np.int32)), found.column(2)], ["query_id", "chunk_id", "list", "near"])

    return lists.select("chunk_id", "code", "step", F.col("list").cast("int").alias("list")).mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id {chunk}, list int, near double")
