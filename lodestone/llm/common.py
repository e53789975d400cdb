"""Shared helpers: durable intermediate tables, text splitting, column checks."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate data: ``spark.checkpoint.dir`` of the session.

    Where that is unset and no checkpoint folder was set either, there is no folder
    that is known to be shared, and an error says so; tests set one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Send rows to Python a thousand or 4 MB at a time in this session, where it has Spark's defaults of 10,000 and 64 MB.

    The defaults buffer as many whole texts on both sides of the pipe.  This changes
    the session's settings; one that is to stay at 10,000 can say 9,999.
    """
    for key, default, bound in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", bound)


def give_back() -> None:
    """Return freed memory of this Python process, a worker or the driver, to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with freed memory given back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def stored(df: DataFrame, label: str, compression: str = "snappy", measures: dict[str, Column] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    Unlike ``checkpoint()`` the table carries no partitioning, so a later join
    deals both sides anew and adaptive execution can split hot keys.  ``measures``
    are aggregates taken while writing; ``measured`` has them.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    rows = df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if measures else df
    rows.write.option("compression", compression).parquet(path)
    note(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at, out._measured = path, dict(seen.get) if measures else {}
    return out


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stored``, and how many rows were written."""
    out = stored(df, label, measures={"n": F.count(F.lit(1))})
    return out, out._measured.get("n", 0)


class _Lists(threading.local):
    """Of each thread, the lists of tables that are being written to; the last is the present one."""

    def __init__(self):
        self.open: list[list[str]] = [[]]


_LISTS = _Lists()


def note(path: str) -> None:
    """Remember an intermediate table as one of the present list."""
    _LISTS.open[-1].append(path)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The intermediate tables that this thread writes inside are a list of their own, which is given.

    ``release`` them once what was made from them is saved; tables of other calls and threads stay.
    """
    own: list[str] = []
    _LISTS.open.append(own)
    try:
        yield own
    finally:
        _LISTS.open.pop()


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, done: list[str] | None = None) -> int:
    """Delete the tables of a list that ``tables`` gave, or those that this thread wrote outside of any; results from them must be saved.

    Shuffle files and broadcasts of what is done with go when the driver's collector finds that nothing
    refers to them; Spark asks for that now and then, and so does this, once a call.
    """
    done = _LISTS.open[0] if done is None else done
    n = 0
    while done:
        n += _delete(spark, done.pop())
    spark.sparkContext._jvm.System.gc()
    give_back()
    return n


def marked() -> int:
    """Where the present list of intermediate tables ends now, for ``discard``."""
    return len(_LISTS.open[-1])


def discard(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete this thread's tables written since ``mark`` but those of ``kept``, which were written from them."""
    keep = {df._stored_at for df in kept}
    own = _LISTS.open[-1]
    for t in [t for t in own[mark:] if t not in keep]:
        _delete(spark, t)
        own.remove(t)


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(F.col(text) if isinstance(text, str) else text, _UPPER, _UPPER.lower())


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; null counts as empty.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is what is wanted.
    """
    return text.encode().lower().split() if text else []


def bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id falls in no bucket (null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def need(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that further columns of any name do no harm."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])
