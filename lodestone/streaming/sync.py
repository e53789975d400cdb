"""A stream of document changes applied to a table of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SYNC_MESSAGE

ACTIONS = ("ADD", "UPDATE", "DELETE")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as a stream of change messages, earliest first."""
    return spark.readStream.schema(SYNC_MESSAGE).option("maxFilesPerTrigger", 100).json(path)


def read_kafka(spark: SparkSession, servers: str, topic: str = "rag-doc-sync") -> DataFrame:
    """The same from Kafka, where its connector is on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), SYNC_MESSAGE).alias("m")).select("m.*")


def latest_action(messages: DataFrame, by: str = "docId", order: str = "timestamp") -> DataFrame:
    """The last message of each document; of messages of one time a deletion goes first, then the larger md5.

    A message without a time is older than any with one.  Each task keeps one message a document before the
    shuffle; of messages that are alike in all of this the largest by its columns is taken.
    """
    rank = F.struct(F.col(order).isNotNull().alias("timed"), F.col(order).alias("at"), F.coalesce(F.col("action") == "DELETE", F.lit(False)).alias("deleted"), F.coalesce("md5", F.lit("")).alias("md5"))
    last = messages.groupBy(F.col(by).alias("_of")).agg(F.max(F.struct(rank.alias("rank"), F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"))).alias("m"))
    return last.select("m.row.*")


def split_batch(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upserts, deletions, and messages that cannot be applied with their ``error``."""
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    named = F.coalesce(F.col("docId").rlike(r"\S"), F.lit(False))
    good = latest_action(messages.where(known & named))
    error = F.when(~named, "no document id").otherwise("unknown action")
    return good.where("action <> 'DELETE'"), good.where("action = 'DELETE'"), messages.where(~(known & named)).withColumn("error", error)


def apply_stream(messages: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], dead_letters: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``apply(upserts, deletions, batch_id)`` on each micro-batch; bad messages go to ``dead_letters``.

    A micro-batch may be delivered again after a failure: ``apply`` must replace
    whole documents (as ``upsert`` and ``delete`` do), and a batch's dead letters
    overwrite those of its first delivery.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            upserts, deletions, bad = split_batch(df)
            apply(upserts, deletions, batch_id)
            bad.write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
        finally:
            df.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of one message dropped while within the watermark."""
    timed = messages.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["docId", "action", "md5", "timestamp"])
