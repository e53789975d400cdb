"""Ranking metrics of one or several routes against relevance judgments, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "mrr", "ndcg")


def _positive(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def _gains(n: Column) -> Column:
    """Sum of 1 / log2(i + 1) for i up to ``n``."""
    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.lit(0.0), lambda s, i: s + F.when(i == 0, 0.0).otherwise(F.ln(F.lit(2.0)) / F.ln(i + 1.0)))


def per_query(samples: DataFrame, qrels: DataFrame, runs: DataFrame, k: int, ideal: str = "returned") -> DataFrame:
    """``(route, query_id, recall, precision, mrr, ndcg, hits, relevant, returned)``.

    ``samples(query_id)`` names all queries, so that those without any hit count with
    zeros; ``qrels(query_id, chunk_id)`` are the relevant chunks, repeated ones count
    once; ``runs(route, query_id, pos, chunk_id)`` are ranked lists, cut to ``k``.  The
    ideal gain has as many places as the fewer of relevant and returned chunks
    (``ideal='returned'``), or of relevant chunks and ``k`` (``ideal='k'``).
    """
    _positive(k)
    if ideal not in ("returned", "k"):
        raise ValueError("ideal must be 'returned' or 'k'")
    cut = runs.where((F.col("pos") >= 1) & (F.col("pos") <= k))
    routes = runs.select("route").distinct()
    judged = qrels.select("query_id", "chunk_id").distinct()
    relevant = judged.groupBy("query_id").agg(F.count("*").alias("relevant"))
    returned = cut.groupBy("route", "query_id").agg(F.count("*").alias("returned"))
    first = cut.groupBy("route", "query_id", "chunk_id").agg(F.min("pos").alias("pos")).join(judged, ["query_id", "chunk_id"])
    found = first.groupBy("route", "query_id").agg(F.count("*").alias("hits"), F.min("pos").alias("best"), F.sum(F.ln(F.lit(2.0)) / F.ln(F.col("pos") + 1.0)).alias("dcg"))
    # Routes are few (one row a ranking compared), so pairing them with all samples only repeats the samples.
    base = samples.select("query_id").distinct().crossJoin(F.broadcast(routes)).join(relevant, "query_id", "left").join(returned, ["route", "query_id"], "left").join(found, ["route", "query_id"], "left")
    base = base.na.fill(0, ["relevant", "returned", "hits"])
    places = F.least(F.col("relevant"), F.col("returned") if ideal == "returned" else F.lit(k))
    idcg = _gains(places)
    return base.select(
        "route", "query_id",
        F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"),
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"), F.when(idcg > 0, F.coalesce("dcg", F.lit(0.0)) / idcg).otherwise(0.0).alias("ndcg"),
        "hits", "relevant", "returned")


def macro(scores: DataFrame, by: tuple[str, ...] = ("route",)) -> DataFrame:
    """``(route, metric, value, total, correct, hits)``: averages over all queries.

    ``correct`` is the rounded sum of the metric; ``hits`` the relevant chunks found.
    """
    wide = scores.groupBy(*by).agg(F.count("*").alias("total"), F.sum("hits").alias("hits"), *[F.avg(m).alias(m) for m in METRICS])
    long_ = wide.select(*by, "total", "hits", F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("no", "m"))
    value = F.col("m.value")
    return long_.select(*by, F.col("m.metric").alias("metric"), value.alias("value"), "total", F.floor(F.round(value * F.col("total"), 9) + 0.5).cast("long").alias("correct"), "hits", "no")


def evaluate(samples: DataFrame, qrels: DataFrame, runs: DataFrame, k: int, ideal: str = "returned") -> DataFrame:
    """Check the judgments, then the macro metrics of every route.

    Errors: no samples, a sample without relevant chunks, or a blank chunk id.
    """
    _positive(k)
    if samples.isEmpty():
        raise ValueError("no samples")
    if not samples.select("query_id").distinct().join(qrels, "query_id", "left_anti").isEmpty():
        raise ValueError("a sample has no relevant chunk")
    if not qrels.where(~F.coalesce(F.col("chunk_id").rlike(r"\S"), F.lit(False))).isEmpty():
        raise ValueError("a relevant chunk id is blank")
    return macro(per_query(samples, qrels, runs, k, ideal))


def report_lines(metrics: DataFrame) -> DataFrame:
    """Metrics as text, one line each."""
    return metrics.withColumn("line", F.format_string("%s: %.4f (%d/%d)", "metric", "value", "correct", "total"))


def retrieved_lists(runs: DataFrame, k: int) -> DataFrame:
    """``(route, query_id, retrieved)``: chunk ids in order."""
    _positive(k)
    cut = runs.where(F.col("pos") <= k)
    return cut.groupBy("route", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]).alias("retrieved"))


def sample_lists(samples: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """``samples`` once for each route with ``retrieved``, which is empty where nothing was found."""
    routes = runs.select("route").distinct()
    found = retrieved_lists(runs, k)
    rows = samples.crossJoin(F.broadcast(routes)).join(found, ["route", "query_id"], "left")
    return rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Evaluation requests with an ``error`` column: null where the request may run."""
    s = F.col("samples")
    bad = lambda cond, text: F.when(cond, F.lit(text))
    error = F.coalesce(
        bad(F.col("topK").isNull() | ~F.col("topK").between(1, 100), "topK must be from 1 to 100"),
        bad(s.isNull() | (F.size(s) == 0), "samples must not be empty"),
        bad(F.exists(s, lambda x: x.isNull()), "a sample is null"),
        bad(F.exists(s, lambda x: ~F.coalesce(x["question"].rlike(r"\S"), F.lit(False))), "a question is blank"),
        bad(F.exists(s, lambda x: F.coalesce(F.size(x["relevantChunkIds"]) <= 0, F.lit(True))), "a sample has no relevant chunk"),
        bad(F.exists(s, lambda x: F.exists(x["relevantChunkIds"], lambda i: ~F.coalesce(i.rlike(r"\S"), F.lit(False)))), "a relevant chunk id is blank"),
    )
    return requests.withColumn("error", error)
