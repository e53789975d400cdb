"""The jobs as queries: each runs twice over whole tables into one new folder, and gives what the folder then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.evaluation import METRICS
from lodestone.plans import oracle
from lodestone.plans.folders import new_folder

from . import evaluate_retrieval, index_documents


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"documents": f"{sf_dir}/documents.parquet", "output": new_folder(spark, "job1")}
    index_documents.run(spark, config)
    again = index_documents.run(spark, config)
    return again.select("doc_id", "chunk_index", "chunk_id", "content", "content_type", "source", "lang")


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"documents": f"{sf_dir}/documents.parquet", "questions": f"{sf_dir}/benchmark.parquet", "embeddings": f"{sf_dir}/embeddings.parquet", "output": new_folder(spark, "job2")}
    evaluate_retrieval.run(spark, config)
    again = evaluate_retrieval.run(spark, config)
    return again.select("route", "query_id", *[F.round(m, 9).alias(m) for m in METRICS], "hits", "relevant", "returned")


QUERIES = {"job1_index_documents": job1_index_documents, "job2_evaluate_retrieval": job2_evaluate_retrieval}

_PLAIN_LINES = rf"""
kept AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(coalesce(text, '')) DESC) = 1),
plain AS (SELECT doc_id, {oracle.NORMAL} AS t FROM kept),
line0 AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS seg_idx, unnest(l) AS content FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM plain)),
seg AS (SELECT *, CAST(NULL AS VARCHAR) AS title, 'text' AS kind, 0 AS page, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM line0 WHERE regexp_matches(content, '\S'))"""

#: Ids are text in the stored index, so ties go by text.
_EVAL = oracle.EVAL.replace("chunk_id) AS INTEGER) AS rank FROM bm)", "CAST(chunk_id AS VARCHAR)) AS INTEGER) AS rank FROM bm)").replace("chunk_id) AS INTEGER) AS rank FROM sums", "CAST(chunk_id AS VARCHAR)) AS INTEGER) AS rank FROM sums")

ORACLE_SQL = {
    "job1_index_documents": f"""WITH RECURSIVE {oracle.packed(128, _PLAIN_LINES)}
SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, sha256(concat_ws('|', doc_id, 'fixed', CAST(idx AS VARCHAR), content)) AS chunk_id, content, chunks.kind AS content_type, source, lang
FROM chunks JOIN kept USING (doc_id) WHERE length(content) >= 50""",
    "job2_evaluate_retrieval": f"WITH {_EVAL} SELECT route, query_id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg, hits, relevant, returned FROM scores",
}
