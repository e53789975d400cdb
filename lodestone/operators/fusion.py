"""Reciprocal rank fusion of any number of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUTES = ("vector", "bm25")


def fuse(runs: DataFrame, k: int = 60, final_top_k: int = 8, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """``runs(query_id, route, pos, chunk_id, ...)`` to ``(query_id, chunk_id, score, rank, source, ...)``.

    A chunk scores the sum of ``1 / (k + pos)`` over routes, by its first position in
    each; positions count from 1 and duplicates do not move those behind them.  Further
    columns come from the first route (in order of ``routes``) that has the chunk.
    """
    if k <= 0 or final_top_k <= 0:
        raise ValueError("k and final_top_k must be positive")
    payload = [c for c in runs.columns if c not in ("query_id", "route", "pos", "chunk_id", "score", "rank", "source")]
    order = F.coalesce(F.array_position(F.array(*map(F.lit, routes)), F.col("route")), F.lit(len(routes) + 1))
    firsts = runs.groupBy("query_id", "chunk_id", "route").agg(F.min("pos").alias("pos"), *([F.min_by(F.struct(*payload), "pos").alias("p")] if payload else []))
    fused = firsts.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (k + F.col("pos"))), 15).alias("score"),
        *([F.min_by("p", F.struct(order.alias("o"), "pos")).alias("p")] if payload else []),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= final_top_k)
    return ranked.select("query_id", "chunk_id", "score", "rank", F.lit("fusion").alias("source"), *[F.col(f"p.{c}").alias(c) for c in payload])
