"""WARC archives of captures, and their index by external merging.

Records are put together by column expressions and written by Spark's text
writer, whose line separator is the end of a WARC record, so archives land
(gzipped) on any file system Spark can write, through its commit protocol.
Reading an archive back gives a run of captures sorted by URL key and time.  The
runs are stored; merge tasks take one key range each and merge what every run
has in it with a loser tree, so the captures come out in global order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsweave.llm.common import kept
from obsweave.session import scratch_path

RECORD_END = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
FILE_RECORDS = 20_000  # records of one archive at most
ARCHIVE_BYTES = 1 << 28  # payload bytes of one archive at most, but for a single record
MERGE_ROWS = 100_000  # captures that one merge task takes
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RUN = (
    "url_key string, captured string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, run string, record_at bigint"
)


def _header_safe(column: Column) -> Column:
    """A value that stays on its header line; ``%`` escapes as in a URL."""
    for char, escape in (("\r", "%0D"), ("\n", "%0A")):
        column = F.replace(column, F.lit(char), F.lit(escape))
    return column


def captures(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", time_col=None) -> DataFrame:
    """``page_id, url, captured, payload, payload_bytes, payload_digest``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    when = F.date_format(time_col, "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None)
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(_header_safe(F.col(url_col).cast("string")), F.lit("")).alias("url"),
        F.coalesce(when, F.lit(CAPTURED)).alias("captured"),
        payload.alias("payload"),
    ).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("bigint"),
            "payload_digest": F.sha2("payload", 256),
        }
    )


def records(found: DataFrame) -> DataFrame:
    """One WARC record a capture, without the record end, in column ``value``; beside it ``payload_bytes``."""
    equal = (
        found.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("captures"))
        .filter("captures > 1")
        .select(F.col("payload_digest").alias("_digest"), "first_id")
    )
    # Stored, so that the join below has an exchange on both sides and AQE may
    # split a payload that a third of the captures share.
    joined = found.join(kept(equal, "equal-payloads"), F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def uri(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes"),
        F.lit(RECORD_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        uri("page_id"),
        F.lit("\r\nWARC-Date: "),
        F.col("captured"),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), uri("first_id")),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block"),
        F.lit(RECORD_END),
    )
    return joined.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"), "payload_bytes")


def write_archives(pages: DataFrame, folder: str, **columns) -> None:
    """Write every row of ``pages`` as a record of gzipped archives below ``folder``.

    An archive is one gzip member, read as one value, so its bytes are bounded:
    payloads of which ``FILE_RECORDS`` stay below ``ARCHIVE_BYTES`` share archives
    by number, and larger ones as few at a time as the largest asks for.
    """
    found = captures(pages, **columns)
    largest = pages.select(F.max(F.octet_length(F.col(columns.get("html_col", "html")).cast("string")))).first()[0] or 0
    ordinary = ARCHIVE_BYTES // FILE_RECORDS
    written = records(found)
    parts = [(F.col("payload_bytes") <= ordinary, FILE_RECORDS)]
    if largest > ordinary:
        parts.append((F.col("payload_bytes") > ordinary, max(1, ARCHIVE_BYTES // largest)))
    for part, most in parts:
        rows = written if largest <= ordinary else written.filter(part)
        (
            rows.select("value")
            .write.mode("append")
            .option("lineSep", RECORD_END)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", most)
            .text(folder)
        )


def url_key(url: str) -> str:
    """Host with its labels turned round, then the rest: neighbours of a site sort together."""
    found = re.match(r"[^:/?#]*://([^/?#]*)(.*)", url, re.S)
    if not found:
        return url
    return ",".join(reversed(found[1].lower().split("."))) + ")" + found[2]


def parse_archive(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place (in the unzipped stream, so no offset to seek to in the file), headers and block of each record."""
    inflate = zlib.decompressobj(wbits=31)
    buffer, at, fed = bytearray(), 0, 0

    def more() -> bool:
        nonlocal fed, inflate
        if inflate.eof:  # the next gzip member
            fed -= len(inflate.unused_data)
            inflate = zlib.decompressobj(wbits=31)
        if fed >= len(content) and not inflate.unconsumed_tail:
            return False
        take = inflate.unconsumed_tail or content[fed : fed + (1 << 16)]
        if not inflate.unconsumed_tail:
            fed += len(take)
        buffer.extend(inflate.decompress(take, 1 << 20))
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError(f"broken record at {at}")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError(f"record cut short at {at}")
        if buffer[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"wrong length at {at}")
        yield at, headers, bytes(buffer[end + 4 : stop])
        del buffer[: stop + 4]
        at += stop + 4


def _page(uri: str | None) -> int | None:
    digits = (uri or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _capture(at: int, headers: dict[str, str], block: bytes, run: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload differs from its digest at {at} of {run}")
    page, url = _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI", "")
    return url_key(url), headers["WARC-Date"], page, url, length, digest, kind, _page(headers.get("WARC-Refers-To")), run, at


def _order(row: tuple) -> tuple:
    """Key, time, id (null last)."""
    return row[0], row[1], row[2] is None, row[2] or 0


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in _RUN.split(", ")]
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes", "record_at")})


def _read_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            run = path.rpartition("/")[2]
            yield _frame(sorted((_capture(*r, run) for r in parse_archive(content)), key=_order))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives below ``folder``, each archive a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInPandas(_read_runs, _RUN)


def loser_tree(runs: Sequence[Sequence[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, one path is replayed a row."""
    k = len(runs)
    heads = [0] * k

    def beats(i: int, j: int) -> bool:
        if i < 0 or heads[i] >= len(runs[i]):
            return False
        if j < 0 or heads[j] >= len(runs[j]):
            return True
        return (_order(runs[i][heads[i]]), i) < (_order(runs[j][heads[j]]), j)

    # Leaves k .. 2k-1 are the runs; play all matches once from below.
    winners, losers = [-1] * k + list(range(k)), [-1] * k
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0 if k else -1
    while champion >= 0 and heads[champion] < len(runs[champion]):
        yield runs[champion][heads[champion]]
        heads[champion] += 1
        node = (champion + k) // 2
        while node:
            if beats(losers[node], champion):
                champion, losers[node] = losers[node], champion
            node //= 2


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            runs.setdefault(row[8], []).append(row)
    merged = []
    for row in loser_tree(list(runs.values())):
        merged.append(row)
        if len(merged) == 10_000:
            yield _frame(merged)
            merged = []
    if merged:
        yield _frame(merged)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Stored runs in one global order of URL key, time and page.

    A task takes a range of the whole key, ids included, so a URL captured very
    often is spread over tasks; it holds about ``MERGE_ROWS`` captures.
    """
    tasks = -(-max(runs.count(), 1) // MERGE_ROWS)
    key = ["url_key", "captured", F.col("page_id").asc_nulls_last()]
    return runs.repartitionByRange(tasks, *key).sortWithinPartitions("run", *key).mapInPandas(_merge, _RUN)


def capture_history(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` to archives, read them back, return the merged index.

    One row a page, in order of URL key, time and page: key, time, id, url,
    payload size and SHA-256 of the whole payload, ``response`` or ``revisit``,
    the id of the response a revisit refers to, archive and place.  Null html is
    an empty payload, a null url an empty one.  Of equal payloads of at least
    ``MIN_REVISIT_BYTES`` the smallest id is the response; rows that repeat that
    id too are responses as well, and so are all where every id is null, while a
    null id beside others is a revisit.  An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(pages, folder, **columns)
    return merge_runs(kept(read_runs(spark, folder), "capture-runs"))
