"""What the training-data operators share: ASCII case, white space, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.session import scratch_path

# Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"

ROWS_A_FILE = 50_000  # of stored frames whose size is known
BATCH_BYTES = "4m"  # of the rows that a Python task is handed at once
_MAX_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lower_ascii(column: Column) -> Column:
    """``A`` to ``Z`` in lower case, every other character as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def release_arrow_memory() -> None:
    """Give back what Arrow's pool and the allocator keep of the batches a Python task has read.

    Workers wait for other tasks beside an executor whose heap is full; the C
    library by itself keeps freed memory at the top of its own heap.
    """
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python tasks ``BATCH_BYTES`` at once, not all rows of a partition."""
    before = spark.conf.get(_MAX_BYTES, None)
    spark.conf.set(_MAX_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_MAX_BYTES) if before is None else spark.conf.set(_MAX_BYTES, before)


def few_tasks(frame: DataFrame, rows: int, each: int) -> DataFrame:
    """The frame in no more tasks than hold about ``each`` of its ``rows``, though never below one a core.

    What is small after an exchange is else dealt over every shuffle partition.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.coalesce(max(cores, -(-rows // each)))


def kept(frame: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here.

    A lost executor costs later stages one read of the files.  The folder is
    scratch; who owns ``spark.checkpoint.dir`` clears it when results are stored.
    Where it is known about how many ``rows`` there are, files are as few as that.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    if rows is not None:
        frame = few_tasks(frame, rows, ROWS_A_FILE)
    with small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
