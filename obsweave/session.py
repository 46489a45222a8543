"""Session construction and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "obsweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Times are UTC.  AQE sizes shuffles and splits skewed joins and writes, so
    no operator hard-codes a partition count.  ``conf`` takes further settings
    with dots written as double underscores.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Feature rows are built from hundreds of column calls; without the
        # call-site capture they cost half as much.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, the same choice under every master.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a folder set with
    ``setCheckpointDir`` is taken, else one below the warehouse, which Spark
    shares between executors as well; a warehouse on the driver's own disk serves
    a local master only.  Checkpoints go there too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/obsweave-scratch"
        own_disk = folder.startswith(("/", "file:"))
        if own_disk and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_scratch: dict[str, list[str]] = {}  # by application


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this application has put below the shared folder, and say how many paths that were.

    Results that still read from there are lost, so store them first.
    """
    made = _scratch.pop(spark.sparkContext.applicationId, [])
    at = spark._jvm.org.apache.hadoop.fs.Path
    for path in made:
        at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(path), True)
    return len(made)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


CACHED_AQE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
SHUFFLES_PASS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _switched_on(spark: SparkSession, name: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cached(frame: DataFrame) -> DataFrame:
    """The frame persisted in as many partitions as its size asks for.

    Spark keeps a cached frame in all its shuffle partitions unless told that they
    may change; every shuffle of a small one then writes their number squared of files.
    """
    with _switched_on(frame.sparkSession, CACHED_AQE):
        return frame.persist()


def passing_shuffles(spark: SparkSession):
    """Within, what a write has shuffled is deleted when the write ends.

    Otherwise it stays until the driver happens to collect its garbage, and a job of
    several writes has the shuffles of all of them on disk.
    """
    return _switched_on(spark, SHUFFLES_PASS)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the finished folder ``fresh`` in the place of ``path``; what was there goes last.

    Between the two renames the old folder lies beside, under ``fresh`` + ``-old``.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    before = fresh + "-old"
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(before)):
        raise OSError(f"cannot move {path}")
    if not files.rename(at(fresh), at(path)):
        raise OSError(f"cannot move {fresh}; the table before lies at {before}")
    if had:
        files.delete(at(before), True)
