"""Evaluate BM25, vector and fused retrieval on a question set, and write rankings, scores and a report.

    python -m jobs.evaluate_retrieval --config jobs/evaluate_retrieval.json [--documents PATH] [--questions PATH] [--embeddings PATH] [--output PATH]

Reads ``documents(doc_id, text)``, ``questions(item_id, text)`` and ``embeddings(vec_id,
embedding)``; a question's vector is that of its number, as a document's is.  A
document that contains a question's text is relevant to it; questions without
any such document are not judged.  Below the output:

* ``index``          the BM25 index of the documents' texts, built in this run;
* ``routes/route=R`` the rankings of the two routes before they are fused;
* ``runs/route=R``   the rankings ``(query_id, pos, chunk_id)`` of ``bm25``, ``vector`` and ``rrf``;
* ``judgments``      ``(query_id, chunk_id)``;
* ``scores/route=R`` recall, precision, MRR and nDCG at ``k`` by question;
* ``report``         a JSON line for each route and metric.

A run replaces what an earlier one wrote and gives the same for the same input; runs are
written before they are scored, so each ranking is computed once.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import contains, evaluation, fusion, retrieval, textindex

LOG = logging.getLogger("evaluate_retrieval")
#: ``k``: places that are scored; ``depth``: places of a ranking; ``fused``: places of the fused one.
DEFAULTS = {"k": 5, "depth": 20, "fused": 8, "rrf_k": 60, "buckets": textindex.BUCKETS}


def rankings(spark: SparkSession, documents: DataFrame, questions: DataFrame, embeddings: DataFrame, config: Mapping, index: str) -> DataFrame:
    """``(route, query_id, pos, chunk_id)`` of the BM25 and vector routes."""
    textindex.add_segment(index, 0, documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), buckets=config["buckets"])
    asked = questions.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    bm25 = textindex.search(asked, index, config["depth"], buckets=config["buckets"])
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    of_docs = documents.select(F.col("doc_id").alias("id")).join(vectors, "id").withColumnRenamed("id", "chunk_id")
    of_questions = asked.select(F.col("query_id").alias("id")).join(vectors, "id").withColumnRenamed("id", "query_id")
    vector = retrieval.vector_topk(of_questions, of_docs, config["depth"])
    both = bm25.unionByName(vector.withColumn("chunk_id", F.col("chunk_id").cast("string")))
    return both.select(F.col("source").alias("route"), "query_id", F.col("rank").alias("pos"), "chunk_id")


def _replace(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write ``df`` in place of what is at ``path``, folders by ``by``, and read it back."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    LOG.info("wrote %d rows to %s", out.count(), path)
    return out


def run(spark: SparkSession, config: Mapping) -> DataFrame:
    """Write everything below ``config["output"]`` and return the scores by route and question, read back."""
    config = DEFAULTS | dict(config)
    output = config["output"].rstrip("/")
    documents, questions, embeddings = (spark.read.parquet(config[n]) for n in ("documents", "questions", "embeddings"))
    LOG.info("read %d documents, %d questions, %d vectors", documents.count(), questions.count(), embeddings.count())
    routes = _replace(rankings(spark, documents, questions, embeddings, config, f"{output}/index"), f"{output}/routes", "route")
    fused = fusion.fuse(routes, config["rrf_k"], config["fused"]).select(F.lit("rrf").alias("route"), "query_id", F.col("rank").alias("pos"), "chunk_id")
    runs = _replace(routes.unionByName(fused), f"{output}/runs", "route")
    pairs = contains.contained_items(documents.select(F.col("doc_id").cast("string").alias("text_id"), "text"), questions.select(F.col("item_id").alias("item_id"), F.col("text").alias("item")))
    judged = _replace(pairs.select(F.col("item_id").alias("query_id"), F.col("text_id").alias("chunk_id")), f"{output}/judgments")
    scores = _replace(evaluation.per_query(judged.select("query_id").distinct(), judged, runs, config["k"]), f"{output}/scores", "route")
    evaluation.report_lines(evaluation.macro(scores)).coalesce(1).write.mode("overwrite").json(f"{output}/report")
    LOG.info("wrote the report to %s", f"{output}/report")
    return scores


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--config", required=True)
    for name in ("documents", "questions", "embeddings", "output"):
        p.add_argument(f"--{name}")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f) | {k: v for k, v in vars(args).items() if v and k != "config"}
    spark = SparkSession.builder.appName("evaluate_retrieval").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
