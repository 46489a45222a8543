"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text.  A batch is reduced to one row per digest before it meets the
index, so a group of copies never makes a partition heavy; digests the index
lacks are found by a sort-merge anti join of equal buckets and appended under the
name of their batch, so a batch that is run again finds its own entries.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm.common import kept, lower_ascii, whole_text
from obsweave.session import swap_in


@dataclass(frozen=True)
class DigestIndex:
    """Where an index lies; its name in the session's catalog follows from that."""

    path: str
    buckets: int = 64

    @property
    def name(self) -> str:
        return "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    def open(self, spark: SparkSession) -> DataFrame:
        """Attach the table, making it if nothing is there yet."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            "(digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )
        return spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        self.open(rows.sparkSession)
        rows.select("digest", "keep_id", "group_size", "batch").write.insertInto(self.name)

    def compact(self, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """One sorted file a bucket, however many batches came; with ``buckets``, that many from now on.

        The new files are written beside the old ones and take their place when
        they are complete.  Returns the index to go on with.
        """
        after = replace(self, buckets=buckets or self.buckets)
        fresh = f"{self.path.rstrip('/')}-{uuid.uuid4().hex}"
        # Read as plain files, or Spark would take the shuffle for done.
        rows = spark.read.schema(self.open(spark).schema).parquet(self.path).repartition(after.buckets, "digest")
        writer = rows.write.bucketBy(after.buckets, "digest").sortBy("digest").option("path", fresh)
        writer.saveAsTable(f"{self.name}_compacted")
        for name in (f"{self.name}_compacted", self.name):  # the files stay
            spark.sql(f"DROP TABLE {name}")
        swap_in(spark, fresh, self.path)
        after.open(spark)
        spark.catalog.refreshTable(after.name)
        return after


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (digest, id) with the number of its rows, ``copies``."""
    digest = F.unhex(F.sha2(lower_ascii(whole_text(text_col)), 256))
    return (
        docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count("*").alias("copies"))
    )


def ingest(
    docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Add a batch to the index; one verdict per row of the batch.

    Columns ``doc_id, keep_id, group_size, kept, text_sha256``.  Of equal texts
    within the batch the row with the largest id stays, if no other batch brought
    the text; else none does, and ``keep_id`` and ``group_size`` tell of the batch
    that did.  ``batch`` names the rows: running them again under their name, after
    a failure at whatever point, appends what is missing and gives the same
    verdicts; other rows need another name.  A null text counts as empty.  Of rows that repeat both id
    and text one stays.  A null id loses to every other; a group of null ids
    keeps one row, with ``keep_id`` null.  Other columns are not read.  An empty
    batch leaves the index alone and returns no rows.
    """
    spark = docs.sparkSession
    rows = kept(digests(docs, id_col, text_col), "digests")
    groups = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("copies").alias("group_size"),
        F.lit(batch).alias("batch"),
    )
    known = index.open(spark).select("digest").hint("merge")
    index.append(groups.repartition(index.buckets, "digest").join(known, "digest", "left_anti"))
    # Read as plain files: both sides of this join are exchanged, so AQE can
    # split the digest that a third of the rows may share.
    entries = spark.read.schema(spark.table(index.name).schema).parquet(index.path)
    first = F.col("copy") == 1
    return (
        rows.join(entries, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (first & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
