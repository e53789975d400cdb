"""Reranking, thresholds, near-duplicate removal and token budgets over ranked hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, overlap_ratio


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")


def rerank(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame], top_k: int, threshold: float = 0.45) -> DataFrame:
    """Score ``(question, content)`` anew, keep ``threshold`` or more, cut to ``top_k``.

    ``scorer`` adds ``new_score`` and ``failed``.  A query with any failure falls back
    to its original scores, without a threshold.  A missing score counts 0.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    scored = scorer(hits)
    failed = F.max(F.coalesce(F.col("failed"), F.lit(False))).over(Window.partitionBy("query_id"))
    judged = scored.withColumn("fallback", failed).withColumn("score", F.when(F.col("fallback"), F.col("score")).otherwise(F.coalesce("new_score", F.lit(0.0))))
    kept = judged.where(F.col("fallback") | (F.col("score") >= threshold)).withColumn("place", F.row_number().over(_by_score()))
    return kept.where(F.col("place") <= top_k).drop("new_score", "failed", "place")


def filter_by_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.where(F.col("score") >= threshold)


def overlap(a: str, b: str, least_step: int) -> float:
    """Share of the shorter text whose sampled windows occur in the longer.

    With ``least_step=1`` the share is of all characters, else of those in windows.
    """
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    step = min(len(short), max(least_step, len(short) // 100))
    windows = range(0, len(short) - step + 1, step)
    return sum(short[i : i + step] in long_ for i in windows) * step / (len(short) if least_step == 1 else len(windows) * step)


def deduplicate(hits: DataFrame, threshold: float = 0.9, least_step: int = 8) -> DataFrame:
    """Best first, drop a hit whose text overlaps a kept one of its query by more than ``threshold``.

    Each decision rests on those before it, so a query's hits (a top-k list) are one array and
    one ordered fold inside the JVM.  Without a score a hit comes last.  ``least_step=1`` compares single characters of short
    texts; the default of 8 does not take unrelated short texts for duplicates.
    """
    score = lambda h: F.coalesce(h["score"].cast("double"), F.lit(float("-inf")))

    def before(a: Column, b: Column) -> Column:
        less = F.when(score(a) != score(b), score(a) > score(b)).when(a["rank"] != b["rank"], a["rank"] < b["rank"]).otherwise(a["chunk_id"] < b["chunk_id"])
        same = (score(a) == score(b)) & (a["rank"] == b["rank"]) & (a["chunk_id"] == b["chunk_id"])
        return F.when(same, 0).when(less, -1).otherwise(1)

    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in hits.columns])), before).alias("hs"))
    start = F.slice("hs", 1, 0)
    alike = lambda h, o: overlap_ratio(h["content"], o["content"], least_step) > threshold
    kept = F.aggregate("hs", start, lambda kept, h: F.when(F.exists(kept, lambda o: alike(h, o)), kept).otherwise(F.array_append(kept, h)))
    return ordered.select(F.inline(kept)).select(*[F.col(f"`{c}`") for c in hits.columns])


def limit_tokens(hits: DataFrame, max_tokens: int) -> DataFrame:
    """Best first, up to the first hit that would exceed the budget."""
    if max_tokens <= 0:
        return hits.where("false")
    w = _by_score().rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(estimate_tokens("content")).over(w)).where(F.col("used") <= max_tokens).drop("used")


def combine_and_filter(hits: DataFrame, threshold: float, overlap_threshold: float = 0.9, max_tokens: int = 4096, least_step: int = 8) -> DataFrame:
    return limit_tokens(deduplicate(filter_by_threshold(hits, threshold), overlap_threshold, least_step), max_tokens)


def batch_scorer(score: Callable[[list[str], list[str]], list[float | None]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``rerank`` from a function over a batch of questions and texts; its exceptions mark the batch failed."""

    def apply(hits: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                try:
                    got, bad = score(f["question"].tolist(), f["content"].tolist()), False
                except Exception:  # noqa: BLE001 - whatever a remote model raises
                    got, bad = [None] * len(f), True
                yield f.assign(new_score=pd.Series(got, index=f.index, dtype="float64"), failed=bad)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
        return hits.mapInPandas(run, f"{fields}, new_score double, failed boolean")

    return apply
