"""Whole flows over batches: answer questions, ingest and update documents, evaluate requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkConfig, RetrievalConfig
from ..functions.text import clean_segments
from ..operators import chunking, context, evaluation, fusion, indexing, retrieval, validation
from ..sources import files as file_source
from ..sources import json_inputs
from ..streaming import sync

#: Adds ``output`` to rows with ``prompt``.
Generator = Callable[[DataFrame], DataFrame]


def extractive(df: DataFrame) -> DataFrame:
    """A stand-in for a model: answers with the first source."""
    return df.withColumn("output", F.concat(F.regexp_extract("prompt", r"(?m)^\[1\] ?(.*)$", 1), F.lit(" [1]")))


def answer(requests: DataFrame, chunks: DataFrame, generate: Generator = extractive, config: RetrievalConfig | None = None, verify: Generator | None = None, equals: dict | None = None) -> DataFrame:
    """``requests(query_id, question, vector)`` to answers with citations; every request gives a row.

    A blank question has ``error`` and no answer.  Requests without hits, and
    answers that cite what is not there, get the rejection.
    """
    asked = requests.withColumn("error", F.when(~F.coalesce(F.col("question").rlike(r"\S"), F.lit(False)), "the question is blank"))
    hits = retrieval.hybrid_search(asked.where("error IS NULL"), chunks, config, equals)
    full = hits.join(chunks.select("chunk_id", *[c for c in ("doc_id", "doc_name", "content", "section_title", "page_num") if c in chunks.columns]), "chunk_id")
    told = context.build_context(full).join(context.build_citations(full), "query_id")
    rows = asked.select("query_id", "question", "error").join(told, "query_id", "left").withColumn("sources", F.coalesce(F.size("citations"), F.lit(0)))
    rows = rows.withColumn("sources", F.when(F.col("citations").isNull(), 0).otherwise(F.col("sources")))
    rows = generate(rows.withColumn("prompt", validation.prompt_with_constraints(F.col("question"), F.col("context")))).withColumnRenamed("output", "answer").drop("prompt")
    if verify is not None:
        rows = verify(rows.withColumn("prompt", validation.fill_prompt(validation.VERIFICATION_PROMPT, context=F.col("context"), answer=F.col("answer"))))
        rows = rows.withColumn("verdict", validation.check_answer("context", "answer", "output")).withColumn("has_hallucination", F.col("verdict.has_hallucination")).drop("prompt", "output")
    else:
        rows = rows.withColumn("has_hallucination", F.lit(False))
    gated = validation.gate(rows)
    return gated.select("query_id", "question", F.when(F.col("error").isNull(), F.col("final_answer")).alias("answer"), "citations", "flag", "error")


def ingest(files: DataFrame, config: ChunkConfig | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``files(doc_id, doc_name, content)``, and the files that could not be parsed."""
    segments, errors = file_source.segments(files)
    return chunking.chunk(segments, config or ChunkConfig(), **options), errors


def update(files: DataFrame, documents: DataFrame, chunks: DataFrame, config: ChunkConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New chunk table, new ``(doc_id, md5)`` table, and errors; unchanged files are never parsed."""
    changed = indexing.changed_only(files, documents)
    fresh, errors = ingest(changed, config)
    marks = changed.select("doc_id", "md5")
    kept = chunks.join(marks.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(fresh), indexing.upsert(documents.select("doc_id", "md5"), marks), errors


_MARKS = "doc_id string, timestamp long, deleted boolean, md5 string"
#: Of two messages for a document the one with the larger mark holds: later, then a deletion, then the larger md5, as within a batch.
_MARK = f"struct(coalesce(timestamp, {-(1 << 63) + 1}L) AS timestamp, deleted, coalesce(md5, '') AS md5)"


def _last_marks(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """``(doc_id, mark, batch)``: each document's largest mark, of the batches before one."""
    log = spark.read.schema(f"{_MARKS}, batch int").parquet(f"{table}/marks")
    if before is not None:
        log = log.where(F.col("batch") < before)
    last = log.groupBy("doc_id").agg(F.max(F.struct(F.expr(_MARK).alias("mark"), F.col("batch"))).alias("m"))
    return last.select("doc_id", "m.mark", "m.batch")


def sync_documents(messages: DataFrame, table: str, dead_letters: str, checkpoint: str, config: ChunkConfig | None = None, available_now: bool = True) -> StreamingQuery:
    """Read, parse and chunk the files that a stream of changes names, into the log at ``table``.

    Each micro-batch adds ``parsed`` (segments and errors of the files, each read and parsed once),
    ``chunks`` with the message's ``tenant_id``, ``failures`` (files that could not be read or
    parsed; such documents keep what they had) and, last, ``marks`` of the messages that were
    applied.  A message that comes in a later batch but is older than the document's mark is
    not applied, so the state follows the messages' order and not that of their arrival.
    Nothing older is rewritten, and a batch that is delivered again replaces its own folders
    only.  ``synced_chunks`` reads the present state.
    """

    def apply(upserts: DataFrame, deletions: DataFrame, batch_id: int) -> None:
        spark, at = upserts.sparkSession, f"batch={batch_id}"
        if batch_id == 0:
            spark.createDataFrame([], _MARKS).write.mode("overwrite").parquet(f"{table}/marks/batch=-1")
        marked = upserts.withColumn("deleted", F.lit(False)).unionByName(deletions.withColumn("deleted", F.lit(True))).withColumnRenamed("docId", "doc_id").withColumn("own", F.expr(_MARK))
        last = _last_marks(spark, table, batch_id).select("doc_id", "mark")
        news = marked.join(last, "doc_id", "left").where("mark IS NULL OR own >= mark").drop("mark", "own")
        stored = file_source.read_stored(news.where("NOT deleted").withColumnRenamed("doc_id", "docId"))
        file_source.parse_files(stored).write.mode("overwrite").parquet(f"{table}/parsed/{at}")
        parsed = spark.read.parquet(f"{table}/parsed/{at}")
        parsed.where("error IS NOT NULL").select("doc_id", "doc_name", "error").write.mode("overwrite").parquet(f"{table}/failures/{at}")
        failed = parsed.where("error IS NOT NULL").select("doc_id").distinct()
        chunks = chunking.chunk(clean_segments(parsed.where("error IS NULL").drop("error")), config or ChunkConfig())
        tenants = news.select("doc_id", F.col("tenantId").alias("tenant_id"))
        chunks.join(failed, "doc_id", "left_anti").join(tenants, "doc_id").write.mode("overwrite").parquet(f"{table}/chunks/{at}")
        # Marks come last: without them a batch's chunks are not seen.
        news.join(failed, "doc_id", "left_anti").select("doc_id", "timestamp", "deleted", "md5").write.mode("overwrite").parquet(f"{table}/marks/{at}")

    return sync.apply_stream(messages, apply, dead_letters, checkpoint, available_now)


def synced_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Chunks of the log at ``table`` that their document's largest mark left."""
    last = _last_marks(spark, table).where("NOT mark.deleted").select("doc_id", "batch")
    return spark.read.parquet(f"{table}/chunks").join(last, ["doc_id", "batch"]).drop("batch")


def compact_synced(spark: SparkSession, table: str, target: str) -> None:
    """Write the log at ``table`` to ``target``, a path of its own, with the last marks and their chunks only, as one batch.

    Marks of deleted documents stay, so that late messages still lose.  The stream is to be
    stopped meanwhile and to go on with ``target`` and the same checkpoint.
    """
    last = _last_marks(spark, table)
    batch = last.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    chunks = spark.read.parquet(f"{table}/chunks").join(last.select("doc_id", "batch"), ["doc_id", "batch"]).drop("batch")
    chunks.write.parquet(f"{target}/chunks/batch={batch}")
    marks = last.select("doc_id", F.when(F.col("mark.timestamp") > 1 - (1 << 63), F.col("mark.timestamp")).alias("timestamp"), "mark.deleted", "mark.md5")
    marks.write.parquet(f"{target}/marks/batch={batch}")


def run_evaluation(requests: DataFrame, retrieve: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Evaluate requests (``EVAL_REQUEST``) whose ``error`` is null with any retriever of ``(query_id, question)``."""
    checked = evaluation.validate_requests(requests).where("error IS NULL")
    samples = checked.select(F.explode("samples").alias("s")).select(F.sha2("s.question", 256).alias("query_id"), F.col("s.question").alias("question"), F.col("s.relevantChunkIds").alias("ids"))
    runs = retrieve(samples.select("query_id", "question"))
    qrels = samples.select("query_id", F.explode("ids").alias("chunk_id"))
    return evaluation.evaluate(samples, qrels, runs, k)


def ablation(spark: SparkSession, snapshot: str, report: str) -> None:
    """Compare the rankings of one snapshot file with each other and with their fusion.

    Writes JSON lines below ``report``: ``metrics`` (a row for each route and metric) and
    ``samples`` (a row for each route and query, with the ids it retrieved), every row
    with the digest of the snapshot's bytes.  A report is replaced when written again.
    """
    frozen = json_inputs.read_snapshot(spark, snapshot)
    heads = frozen.select("sha256", "snapshot.snapshotId", "snapshot.topK", "snapshot.rankConstant").take(2)
    if len(heads) != 1:
        raise ValueError("a report needs exactly one snapshot")
    head = heads[0]
    samples, qrels, routes = json_inputs.snapshot_tables(frozen)
    fused = fusion.fuse(routes, head.rankConstant, head.topK).select("query_id", F.lit("rrf").alias("route"), F.col("rank").alias("pos"), "chunk_id")
    runs = routes.unionByName(fused)
    marks = [F.lit(head.sha256).alias("snapshotSha256"), F.lit(head.snapshotId).alias("snapshotId"), F.lit(head.topK).alias("topK")]
    metrics = evaluation.report_lines(evaluation.evaluate(samples, qrels, runs, head.topK))
    metrics.select(*marks, "route", "no", "metric", "value", "correct", "total", "line").write.mode("overwrite").json(f"{report}/metrics")
    relevant = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("relevant"))
    lists = evaluation.sample_lists(samples.join(relevant, "query_id", "left"), runs, head.topK)
    lists.select(*marks, "route", "query_id", "question", "category", "relevant", "retrieved").write.mode("overwrite").json(f"{report}/samples")
