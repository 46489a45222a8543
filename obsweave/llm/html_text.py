"""Main text of pages by their markup and a suffix array over each host.

Pages become blocks with zones.  The token streams of a host's pages are
concatenated and their suffixes ordered; what neighbours in that order share
over ``LONG`` tokens or more, on distinct pages, is repeated.  Repeats decide
what markup leaves open.  Without an article, blocks go if all of them is
repeated, else lose long repeated runs and keep their unique ones; a page that
has no unique run of ``LONG`` tokens is a near copy of others, and repeats say
nothing about it.  Inside an article, a block that is only named like
boilerplate goes if all of it is repeated.  Blocks that markup marks are dropped.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import xor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm import wordhash
from obsweave.llm.common import kept, lower_ascii
from obsweave.llm.page_blocks import DROP, MAIN, NAMED, OPEN, blocks

LONG = 8  # tokens of a repeated substring at least; a power of two
CHUNK_PAGES = 1_000  # rows of a host that one task takes together

_BLOCKS = "page_id string, url string, host string, same bigint, open boolean, blocks binary"
_TEXTS = "page_id string, url string, text string, n_chars bigint"


def repeated(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which tokens lie in a substring of at least ``LONG`` tokens that distinct pages share.

    The suffix order is made by doubling: ranks of suffixes by their first
    ``2 ** i`` tokens give those by twice as many.  Suffixes of equal rank in
    the end have a common prefix of ``LONG`` tokens.  ``tokens`` of different
    pages are kept apart by a token of their own after each page.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < LONG:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < LONG:
        later = np.zeros(n, np.int64)
        later[: n - depth] = rank[depth:] + 1
        rank = np.unique(rank * np.int64(n + 2) + later, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    order = np.argsort(rank, kind="stable")  # the suffix array, to this depth
    by_rank, by_page = rank[order], page[order]
    starts = np.flatnonzero(np.r_[True, by_rank[1:] != by_rank[:-1]])
    low, high = np.minimum.reduceat(by_page, starts), np.maximum.reduceat(by_page, starts)
    shared = np.repeat(low != high, np.diff(np.r_[starts, n]))
    begin = np.zeros(n + 1, np.int64)
    at = order[shared]
    np.add.at(begin, at, 1)
    np.add.at(begin, np.minimum(at + LONG, n), -1)
    return np.cumsum(begin[:n]) > 0


def _long_runs(marks: np.ndarray) -> np.ndarray:
    """Marks in runs of at least ``LONG``: a run of the block before may reach a few words in."""
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False]))
    out = np.zeros(len(marks), bool)
    for start, stop in zip(edges[0::2], edges[1::2]):
        out[start:stop] = stop - start >= LONG
    return out


def _block_hash(text: str) -> int:
    """Of the words as they are compared: A-Z in lower case."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass").lower(), digest_size=8).digest(), "little", signed=True)


def said(page: list[tuple[int, str]]) -> int:
    """What a page says: pages with equal blocks outside boilerplate are copies, and no evidence against each other."""
    return reduce(xor, {_block_hash(text) for zone, text in page if zone != DROP}, 0)


def _decided(zone: int) -> bool:
    """Whether markup alone decides on blocks of a zone."""
    return zone in (DROP, MAIN)


def _unpacked(packed: bytes) -> list[tuple[int, str]]:
    return [tuple(b) for b in json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))]


def _streams(words: list[list[list[str]]]) -> list[np.ndarray]:
    """The word hashes of each page, block after block."""
    streams = [np.array(h) for h in wordhash.words([" ".join(" ".join(w) for w in page) for page in words])]
    # Words of the hash end at ASCII white space, those of split() at any; where
    # a page has other white space its words are hashed one by one.
    for i, page in enumerate(words):
        n = sum(map(len, page))
        if len(streams[i]) != n:
            streams[i] = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for p in page for w in p), np.uint64, n)
    return streams


def _windows(tokens: np.ndarray) -> np.ndarray:
    """The hash of each ``LONG`` tokens of a page that follow one another."""
    hashes = np.zeros(max(0, len(tokens) - LONG + 1), np.uint64)
    for i in range(LONG if len(hashes) else 0):
        hashes += tokens[i : i + len(hashes)] * wordhash._COEFFICIENTS[i]
    return wordhash.scramble(hashes).view(np.int64)


def _inside(tokens: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which tokens of a page lie in one of the windows, given in order."""
    own = _windows(tokens)
    hit = np.zeros(len(own), bool)
    if len(windows):
        hit = windows[np.minimum(np.searchsorted(windows, own), len(windows) - 1)] == own
    edges = np.zeros(len(tokens) + LONG, np.int64)
    edges[: len(own)] += hit
    edges[LONG : LONG + len(own)] -= hit
    return np.cumsum(edges)[: len(tokens)] > 0


def _named(page: list[tuple[int, str]]) -> list[int]:
    """The hashes of the blocks that are only named like boilerplate, short ones being no runs."""
    return [_block_hash(text) for zone, text in page if zone == NAMED]


def unique_runs(pages: list[list[tuple[int, str]]], elsewhere: np.ndarray | None = None) -> Iterator[str]:
    """The text of each page of a host, or of one chunk of it.

    Copies count as one page.  ``elsewhere`` holds the hashes, in order, of the
    windows and named blocks of a chunk that other chunks of the host repeat.
    """
    if all(_decided(zone) for page in pages for zone, _ in page):
        yield from (" ".join(text for zone, text in page if zone == MAIN) for page in pages)
        return
    elsewhere = np.zeros(0, np.int64) if elsewhere is None else elsewhere
    words = [[text.split() for _, text in page] for page in pages]
    streams = _streams(words)
    copies = np.unique(np.array([said(page) for page in pages], np.int64), return_inverse=True)[1]
    ends = [np.array([i], np.uint64) for i in range(len(pages))]
    tokens = np.concatenate([part for pair in zip(streams, ends) for part in pair])
    covered = repeated(tokens, np.repeat(copies, [len(s) + 1 for s in streams]))
    holders = defaultdict(set)
    for copy, page in zip(copies, pages):
        for block in _named(page):
            holders[block].add(copy)
    known = {block for block, found in holders.items() if len(found) > 1} | (set(holders) & set(elsewhere.tolist()))
    at = 0
    for page, page_words, stream in zip(pages, words, streams):
        marks = covered[at : at + len(stream)] | _inside(stream, elsewhere)
        at += len(stream) + 1
        yield " ".join(_kept(page, page_words, marks, known))


def _kept(page: list[tuple[int, str]], words: list[list[str]], marks: np.ndarray, known: set[int]) -> Iterator[str]:
    """What stays of a page, given which of its tokens are repeated."""
    bounds = np.cumsum([0, *map(len, words)])
    of_block = [marks[a:b] for a, b in zip(bounds, bounds[1:])]
    open_marks = [m for (zone, _), m in zip(page, of_block) if zone == OPEN]
    own = ~np.concatenate(open_marks) if open_marks else np.zeros(0, bool)
    near_copy = not _long_runs(own).any()
    for (zone, text), own_words, repeats in zip(page, words, of_block):
        if zone == MAIN or (zone == OPEN and near_copy):
            yield text
        elif zone == NAMED:
            if not repeats.all() and _block_hash(text) not in known:
                yield text
        elif zone == OPEN and not repeats.all():
            yield from (w for w, gone in zip(own_words, _long_runs(repeats)) if not gone)


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages as compressed blocks: half of what their text would take in a shuffle."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)
    source = pages.select(
        F.col(id_col).cast("string").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        lower_ascii(rest).alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(h) for h in batch["html"]]
            packed = [zlib.compress(json.dumps(b, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6) for b in found]
            yield batch[["page_id", "url", "host"]].assign(
                same=[said(b) for b in found], open=[not all(_decided(z) for z, _ in b) for b in found], blocks=packed
            )

    return source.mapInPandas(parse, _BLOCKS)


def _host_windows(dealt: DataFrame) -> DataFrame:
    """``host, chunk, window`` of every window, or named block, of a chunk that different pages of its host share."""

    def seen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("blocks")
        pages = [_unpacked(p) for p in rows["blocks"]]
        streams = _streams([[text.split() for _, text in page] for page in pages])
        found = [np.r_[_windows(s), np.array(_named(page), np.int64)] for s, page in zip(streams, pages)]
        windows = np.concatenate(found)
        same = np.repeat(rows["same"].to_numpy(np.int64), [len(w) for w in found])
        order = np.argsort(windows, kind="stable")
        windows, same = windows[order], same[order]
        starts = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]][: len(windows)])
        low, high = (f.reduceat(same, starts) if len(starts) else same for f in (np.minimum, np.maximum))
        key = rows[["host", "chunk"]].iloc[[0] * len(starts)].reset_index(drop=True)
        return key.assign(window=windows[starts], low=low, high=high)

    schema = "host string, chunk bigint, window bigint, low bigint, high bigint"
    rows = dealt.select("host", "chunk", "same", "blocks").groupBy("host", "chunk").applyInPandas(seen, schema)
    rows = kept(rows, "windows")
    shared = rows.groupBy("host", "window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = kept(shared.filter("low < high").select("host", "window"), "shared-windows")
    return rows.select("host", "chunk", "window").join(shared, ["host", "window"], "left_semi")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Blocks in page order are joined by one blank, white space inside them is one
    blank, character references are decoded.  Null html or nothing but
    boilerplate gives an empty text; a null url belongs to the host without a
    name; repeated rows have a text each, and copies are no evidence against each
    other; other columns are not read; an empty table gives no rows.  Repeats are
    sought in whole hosts.  One of more than ``CHUNK_PAGES`` rows is dealt into
    chunks of about that many, each with a suffix array of its own; what pages of
    different chunks share is found by aggregates over all of them first, so the
    chunks do not show in the result.
    """
    rows = parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id())
    rows = kept(rows, "parsed")
    sizes = rows.groupBy("host").agg(F.count("*").alias("rows"), F.max("open").alias("any_open"))
    # Stored, so that AQE can split the host of a third of the pages.
    sizes = kept(sizes.withColumn("chunks", F.ceil(F.col("rows") / CHUNK_PAGES)).drop("rows"), "hosts")
    dealt = rows.join(sizes, "host").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks"))
    # Where markup decides on every block, repeats are not sought.
    windows = _host_windows(dealt.filter("chunks > 1 and any_open"))

    def extract(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        once = rows.drop_duplicates("blocks")
        unpacked = [_unpacked(p) for p in once["blocks"]]
        texts = dict(zip(once["blocks"], unique_runs(unpacked, np.sort(found["window"].to_numpy(np.int64)))))
        text = [texts[p] for p in rows["blocks"]]
        return rows[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    own = dealt.select("page_id", "url", "host", "chunk", "blocks").groupBy("host", "chunk")
    texts = own.cogroup(windows.groupBy("host", "chunk")).applyInPandas(extract, _TEXTS)
    return texts.withColumn("page_id", F.col("page_id").cast("bigint"))
