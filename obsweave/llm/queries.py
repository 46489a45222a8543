"""The queries of the training-data operators over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm import (
    exact_dedup,
    graph_search,
    html_text,
    infill,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    packing,
    quality,
    secret_scan,
    url_filter,
    warc,
)
from obsweave.llm.common import lower_ascii, table
from obsweave.session import scratch_path

# Fixed rules of the contract.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


URL_RULES_SQL = "SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)"

TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where the public vocabulary lies; every machine has it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and indexed."""
    index = warc.capture_history(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a new digest index."""
    index = exact_dedup.DigestIndex(scratch_path(spark, "digest-index"))
    return exact_dedup.ingest(table(spark, sf_dir, "documents"), index, "documents")


def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all others."""
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, spark.sql(URL_RULES_SQL))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the classifier keeps, with what decided."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.classify(docs, model)
    return judged.filter("kept").select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its repeated lines fell."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component its links put it in."""
    similar = ngram_join.Similarity(width=4, percent=85)
    joined = ngram_join.join_components(table(spark, sf_dir, "documents"), similar)
    return joined.select("doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; a third of them come back with other letters."""
    text = F.col("text")
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    proven = merkle.manifest(
        table(spark, sf_dir, "documents"),
        ("doc_id", "source", "lang", "n_chars", "text"),
        group="lang",
        id_col="doc_id",
        received={"text": F.when(altered, lower_ascii(text)).otherwise(text)},
    )
    digests = {name: merkle.hex_text(F.col(name)) for name in ("leaf", "subroot", "root", "folded_root")}
    proof = F.sha2(merkle.hex_text(merkle.proof_digests(F.col("path"))), 256)
    return proven.select(
        F.col("id").alias("doc_id"),
        *[column.alias(name) for name, column in digests.items()],
        proof.alias("proof_sha256"),
        "verified",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an example, its digests streamed from frames."""
    return infill.with_digests(infill.examples(table(spark, sf_dir, "documents")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), tokenizer_path()).drop("found")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_packing,
        op3_warc,
        op4_mixing,
        op5_exact_dedup,
        op6_graph_search,
        op7_url_filter,
        op8_quality_classifier,
        op9_line_dedup,
        op10_ngram_join,
        op11_merkle_manifest,
        op12_fill_in_middle,
        op13_secret_scan,
    )
}
