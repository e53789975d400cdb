"""Folders for tables that a call writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing uses yet, in the folder that driver and executors share (``spark.checkpoint.dir`` of the session)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
