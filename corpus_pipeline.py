"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` stores what a stage returns and hands the stored table on, so a
lost executor never costs more than one stage.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import line_dedup, mixing, ngram_join, packing, quality
from obsweave.llm.common import kept, table, whole_text
from obsweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, keeps."""
    docs = _own(docs)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _own(quality.classify(docs, model).filter("kept"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that fell; ``n_chars`` is that of the new text."""
    lines = line_dedup.dedup_lines(_own(docs))
    return _own(lines.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("bigint")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Where an id is repeated, a row is known by id and text: of rows equal in both
    the least stays, and unrelated texts of one id all stay.
    """
    docs = _own(docs)
    groups = ngram_join.join_components(docs, ngram_join.Similarity(width=5, percent=80))
    first = kept(groups.filter("first").select("id", "body").distinct(), "firsts")
    body = F.xxhash64(whole_text("text"))
    named = docs.withColumn("id", ngram_join.identity("doc_id", "text")).withColumn("body", body)
    alike = named.join(first, ["id", "body"], "left_semi").groupBy("id", "body")
    return alike.agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of one id are taken alike."""
    docs = _own(docs)
    named = docs.withColumn("id", ngram_join.identity("doc_id", "text"))
    mixed = mixing.mix(named, weights=(3, 1, 2), share=1.5, most=2.0, id_col="id")
    copies = mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    taken = kept(copies.withColumnRenamed("doc_id", "id"), "copies")
    return _own(named.join(taken, "id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place in a sequence."""
    return packing.pack(_own(docs), tokenizer_path(), 4096)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing to target weights", mixed_documents),
    ("best-fit packing", packed_documents),
]

# A fitted model and random rounding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = kept(stage(spark, docs, sf_dir), f"stage-{place}")
    return docs
