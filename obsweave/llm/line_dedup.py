"""Line dedup that moves hashes and returns keep bitmaps, never text.

Lines become 128-bit hashes of their keys.  These are range-partitioned by hash
and sorted by document, largest first, and position; a stream over each key's
run meets its first occurrence and learns how many documents hold it.  Keys so
common that one would fill a partition (at most ``HEAVY_PARTS`` of them by
construction) are counted by a combining aggregate instead.  What falls comes
back as one compressed bitmap a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import WHITE, kept, lower_ascii, whole_text
from obsweave.operators.ranking import free_name

HEAVY_LINES = 5_000  # a key with more lines than this is heavy
HEAVY_KEYS = 1_000_000  # at most; the bound grows with tables in which there would be more


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Lines long enough to count: ``h1, h2, doc_id, body, pos``; ``body`` tells texts of one id apart."""
    text = whole_text(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("body"),
        F.posexplode(_lines(text)).alias("pos", "line"),
    )
    keyed = lines.select("doc_id", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "body", "pos"
    )


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id, body, pos`` of every line that falls."""
    key = ["h1", "h2"]
    total = lines.count()
    most = max(HEAVY_LINES, total / HEAVY_KEYS)
    heavy = lines.groupBy(*key).count().filter(F.col("count") > most).select(*key)
    heavy = F.broadcast(kept(heavy, "heavy-lines"))  # fewer than HEAVY_KEYS rows of 16 bytes

    largest_first = Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    run = Window.partitionBy(*key)
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last()))
    light = (
        lines.join(heavy, key, "left_anti")
        .repartitionByRange(*key)
        .sortWithinPartitions(*key, F.col("doc_id").desc_nulls_last(), "pos")
        .withColumns({"rank": rank, "keep_id": F.first("doc_id").over(largest_first)})
        .withColumn("holders", F.max(F.when(F.col("doc_id").isNotNull(), F.col("rank"))).over(run))
    )
    common = lines.join(heavy, key)
    counted = F.broadcast(
        common.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count_distinct("doc_id").alias("holders"))
    )
    falls = (F.col("holders") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "body", "pos"]
    return light.filter(falls).select(*columns).union(common.join(counted, key).filter(falls).select(*columns))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """``doc_id, body, keep``: which lines of a document stay.

    ``keep`` maps a word number to 64 bits, bit ``i`` of word ``w`` standing for
    line ``64 w + i``; words that keep all their lines are left out, and so are
    documents that do.  Keys of at least ``min_chars`` code points that at least
    ``min_docs`` ids hold stay in the largest id only, there in all their lines.
    A null text is one empty line; rows of one id count as one document; a null
    id is no holder and keeps no repeated line.
    """
    lines = kept(occurrences(docs, id_col, text_col, min_chars), "lines")
    return (
        repeated_lines(lines, min_docs)
        .groupBy("doc_id", "body", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("fallen"))
        .groupBy("doc_id", "body")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("fallen")))).alias("keep"))
    )


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with ``kept_text, n_lines, n_dropped`` added; null text reads as empty.

    Columns of these three names that the documents have already are replaced;
    all others stay, whatever they are called.
    """
    mark, text = free_name(docs, "_mark"), free_name(docs, "_text")
    key = F.struct(F.col("doc_id").alias("id"), "body", "keep")
    marks = bitmaps.select(key.alias(mark))
    stays = F.expr(
        f"filter(split({text}, '\\n', -1), (line, i) -> "
        f"(shiftright(coalesce(try_element_at({mark}.keep, i div 64), -1L), i % 64) & 1) = 1)"
    )
    fallen = F.expr(f"aggregate(map_values({mark}.keep), 0L, (n, w) -> n + bit_count(~w))")
    joined = docs.withColumn(text, whole_text(text_col)).join(
        marks,
        F.col(id_col).eqNullSafe(F.col(f"{mark}.id")) & (F.xxhash64(text) == F.col(f"{mark}.body")),
        "left",
    )
    breaks = F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    return joined.withColumns(
        {
            "n_lines": (breaks + 1).cast("bigint"),
            "n_dropped": F.coalesce(fallen, F.lit(0).cast("bigint")),
            "kept_text": F.when(F.col(mark).isNull(), F.col(text)).otherwise(F.array_join(stays, "\n")),
        }
    ).drop(mark, text)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``apply_bitmaps`` of ``keep_bitmaps``: one row per document, in no order, all its columns kept."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **limits), id_col, text_col)
