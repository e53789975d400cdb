"""Files into segments: detection, dispatch, parsing and cleaning, with errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_segments, file_type, fingerprint
from .parsers import PARSERS, Parsed, parse_file

_OUT = "doc_id string, doc_name string, md5 string, seg_idx int, content string, content_type string, page_num int, section_title string, heading_level int, table_markdown string, metadata map<string,string>, error string"

_SCHEMA = pa.schema([("doc_id", pa.string()), ("doc_name", pa.string()), ("md5", pa.string()), ("seg_idx", pa.int32()), ("content", pa.string()), ("content_type", pa.string()), ("page_num", pa.int32()), ("section_title", pa.string()), ("heading_level", pa.int32()), ("table_markdown", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, doc_name, source_path, file_type, file_size, md5, updated_at, content)`` of every file under ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.sha2("path", 256).alias("doc_id"), name.alias("doc_name"), F.col("path").alias("source_path"), file_type(name).alias("file_type"), F.col("length").alias("file_size"), fingerprint("content").alias("md5"), F.col("modificationTime").alias("updated_at"), "content")


def read_stored(messages: DataFrame) -> DataFrame:
    """``(doc_id, doc_name, content, error)`` of the files that ``messages(docId, docName, storedPath)`` name.

    Paths are absolute or URIs and are opened by the tasks.  A file that cannot be read
    (no path, missing, no rights) has null content and an ``error``; a message without a
    name goes by the last part of its path.
    """
    rows = messages.select(F.col("docId").alias("doc_id"), F.coalesce("docName", F.element_at(F.split("storedPath", "/"), -1)).alias("doc_name"), "storedPath")
    schema = pa.schema([("doc_id", pa.string()), ("doc_name", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, name, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, error = None, None
                try:
                    if path is None:
                        raise FileNotFoundError("no stored path")
                    where, inside = fs.FileSystem.from_uri(path)
                    with where.open_input_stream(inside) as f:
                        data = f.read()
                except (OSError, ValueError) as e:
                    error = f"cannot read: {e}"
                # One file a batch, so that only one is held at a time.
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "doc_name": name, "content": data, "error": error}], schema)

    return rows.mapInArrow(run, "doc_id string, doc_name string, content binary, error string")


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """Segments of ``files(doc_id, doc_name, content)``; unknown types and broken files give a row with ``error``.

    So does a file that comes with an ``error`` of its own, as ``read_stored`` gives it; it is not parsed.
    """
    known = PARSERS if parsers is None else parsers
    before = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.col("doc_id").cast("string"), "doc_name", file_type("doc_name").alias("file_type"), fingerprint("content").alias("md5"), "content", before.alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, name, kind, md5, data, error in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_name", "file_type", "md5", "content", "error")), strict=True):
                for s in [{"error": error}] if error is not None else parse_file(kind, data, known):
                    out.append({"doc_id": doc_id, "doc_name": name, "md5": md5} | s | {"metadata": list(s.get("metadata", {}).items())})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    parsed = rows.mapInArrow(run, _OUT)
    return parsed.withColumn("seg_id", F.sha2(F.concat_ws("|", "doc_id", F.col("seg_idx").cast("string"), "content"), 256))


def segments(files: DataFrame, preserve_code: bool = False, parsers=None) -> tuple[DataFrame, DataFrame]:
    """Cleaned segments, and ``(doc_id, doc_name, error)`` of the files that gave none."""
    parsed = parse_files(files, parsers)
    good = clean_segments(parsed.where("error IS NULL").drop("error"), preserve_code)
    return good, parsed.where("error IS NOT NULL").select("doc_id", "doc_name", "error")


def ocr(images: DataFrame, engine: Callable[[bytes, str], str], language: str = "eng") -> DataFrame:
    """Add ``text`` read from ``content`` by a pluggable engine; an unreadable image gives the empty text."""

    def read(col: pd.Series) -> pd.Series:
        def one(data):
            try:
                return engine(bytes(data), language) or ""
            except Exception:  # noqa: BLE001 - any engine error means unreadable
                return ""

        return col.map(one)

    return images.withColumn("text", F.pandas_udf(read, "string")("content"))
