"""Keep a chunk table and its BM25 index in step with a growing folder of documents.

    python -m jobs.index_documents --config jobs/index_documents.json [--documents PATH] [--output PATH] [--checkpoint PATH]

The folder's Parquet files ``(doc_id, text, lang, source)`` are a file stream; a run takes
what is new since the last one and stops (``availableNow``).  Of each micro-batch only
documents whose text changed are chunked.  Below the output:

* ``chunks/batch=N/lang=L``  the chunks of the documents that batch N brought or changed;
* ``marks/batch=N``          ``(doc_id, md5)`` of these documents, written last;
* ``rejected/batch=N``       rows without an id;
* ``index``                  segment N of the stored index, without the chunks they replace.

Nothing older is rewritten.  A batch that is delivered again after a failure writes its own
folders again, so the outcome is the same; a run without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig
from lodestone.functions import text as T
from lodestone.operators import chunking, indexing, textindex
from lodestone.sources import segments

LOG = logging.getLogger("index_documents")
DOCUMENTS = "doc_id long, text string, lang string, source string"
CHUNKS = "doc_id string, chunk_index int, chunk_id string, content string, content_type string, source string, batch int, lang string"
MARKS = "doc_id string, md5 string, batch int"
DEFAULTS = {"chunk_size": 512, "overlap": 128, "min_chunk": 50, "files_per_batch": 100, "buckets": textindex.BUCKETS}


def _marks(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """``(doc_id, md5, batch)`` as of the last batch, or as of those before a batch."""
    log = spark.read.schema(MARKS).parquet(f"{output}/marks")
    if before is not None:
        log = log.where(F.col("batch") < before)
    return log.groupBy("doc_id").agg(F.max_by("md5", "batch").alias("md5"), F.max("batch").alias("batch"))


def _chunks(spark: SparkSession, output: str, marks: DataFrame) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{output}/chunks").join(marks.select("doc_id", "batch"), ["doc_id", "batch"])


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of every document as the last batch that changed it left them."""
    return _chunks(spark, output, _marks(spark, output))


def _first_folders(spark: SparkSession, output: str) -> None:
    """Folders with an empty file where a first batch may have no rows, so that readers find the tables."""
    spark.createDataFrame([], CHUNKS).drop("batch", "lang").write.mode("overwrite").parquet(f"{output}/chunks/batch=-1/lang=none")
    spark.createDataFrame([], MARKS).drop("batch").write.mode("overwrite").parquet(f"{output}/marks/batch=-1")


def _fresh(named: DataFrame, changed: DataFrame) -> DataFrame:
    """One row of ``named`` for each of ``changed(doc_id, md5)``, whose digest is the id's largest.

    An equality of digests would become a key of the join, and texts be dealt twice: by both keys, then by id.
    """
    newest = changed.select("doc_id", F.col("md5").alias("newest"))
    return named.join(newest, "doc_id").where("md5 >= newest").drop("newest").dropDuplicates(["doc_id"])


def apply_batch(docs: DataFrame, batch: int, output: str, config: Mapping) -> None:
    """Bring the tables at ``output`` up to a batch of documents.

    Of rows of one id the one with the largest digest of its text counts; a null text is an empty one, and
    a document without text keeps a mark and has no chunks.
    """
    spark = docs.sparkSession
    if batch == 0:
        _first_folders(spark, output)
    docs.where("doc_id IS NULL").write.mode("overwrite").parquet(f"{output}/rejected/batch={batch}")
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    # The texts stay where they are: what a document is to become is decided on digests.
    newest = named.groupBy("doc_id").agg(F.max("md5").alias("md5"))
    changed = indexing.detect_changes(newest, _marks(spark, output, batch)).where("changed").select("doc_id", "md5")
    fresh = _fresh(named, changed)
    sizes = ChunkConfig("fixed", config["chunk_size"], config["overlap"], config["min_chunk"])
    lines = segments.line_segments(fresh.withColumn("text", T.normalize("text")))
    made = chunking.chunk(lines, sizes).join(fresh.select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("lang")), "doc_id")
    columns = [c for c in spark.createDataFrame([], CHUNKS).columns if c != "batch"]
    made.select(*columns).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/chunks/batch={batch}")
    added = spark.read.schema(CHUNKS).parquet(f"{output}/chunks").where(F.col("batch") == batch)
    replaced = _chunks(spark, output, _marks(spark, output, batch).join(changed.select("doc_id"), "doc_id", "left_semi"))
    textindex.add_segment(f"{output}/index", batch, added, replaced, buckets=config["buckets"])
    changed.write.mode("overwrite").parquet(f"{output}/marks/batch={batch}")
    done = spark.read.schema(MARKS).parquet(f"{output}/marks").where(F.col("batch") == batch)
    LOG.info("batch %d: %d documents read, %d new or changed, %d chunks written, %d chunks replaced", batch, docs.count(), done.count(), added.count(), replaced.count())


def run(spark: SparkSession, config: Mapping) -> DataFrame:
    """Take what is new in ``config["documents"]`` and return the chunks at ``config["output"]`` as they then are.

    Without ``checkpoint`` the stream's checkpoint is below the output.  Session settings stay as they are.
    """
    config = DEFAULTS | dict(config)
    output = config["output"].rstrip("/")
    checkpoint = config.get("checkpoint") or f"{output}/_stream"
    # As a pattern, which matches nothing else, the path may also be that of a single file.
    source = config["documents"].rstrip("/")
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{source[:-1]}[{source[-1]}]")
    LOG.info("reading %s, writing %s", config["documents"], output)
    stream = docs.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    now = current_chunks(spark, output)
    LOG.info("%s holds %d chunks of %d documents", output, now.count(), _marks(spark, output).count())
    return now


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--config", required=True)
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f) | {k: v for k, v in vars(args).items() if v and k != "config"}
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
