"""Packing documents into sequences by large-item matching and best fit.

Pieces differ, for this purpose, in their length only, so the plan is made on
the histogram of lengths: at most one number per length up to the capacity,
however many documents there are.  Lengths above a third of the capacity pair at
most twice a sequence, the largest with the largest that fits; smaller ones,
largest first, go where the gap left is least.  A plan segment says where the
n-th to m-th piece of a length go; pieces find theirs by their rank.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import kept, release_arrow_memory, whole_text
from obsweave.operators.ranking import with_position

END_ID = 1  # follows the ids of every document
MEMO_WORDS = 300_000  # words whose ids a task remembers, and as many older ones

_PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"


# How the tokenizer cuts text into words, in its own configuration,
# and the same for text of the first 256 code points in lower case.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORD = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_SPACES}]+"
)


def _byte_characters() -> dict[int, str]:
    """Byte-level tokenizers show each byte as a character: itself if that prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _settings(part) -> dict:
    """The configuration of one part of a tokenizer, without the vocabulary that the whole has."""
    return json.loads(part.__getstate__()) if part else {}


class Encoder:
    """Token ids as little-endian bytes, remembering what each word became.

    A text is cut into words as the tokenizer cuts it and its model encodes each
    word it has not met yet.  That holds for Latin-1 texts and a tokenizer cutting
    by ``_SPLIT``; any other text, and one with a special token in it, is encoded
    by the tokenizer as a whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = [s.get("pattern", {}).get("Regex") for s in _settings(self.tokenizer.pre_tokenizer).get("pretokenizers", [])]
        kinds = [n["type"] for n in _settings(self.tokenizer.normalizer).get("normalizers", [])]
        self.by_word = steps == [_SPLIT, None] and kinds == ["NFC", "Replace", "Lowercase"]
        self.characters = _byte_characters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[str]) -> None:
        """Make ``memo`` hold all of ``words``; what it held long ago and not since is forgotten."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        for word in words.difference(self.memo):
            self.memo[word] = self.older.get(word) or self._word(word)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            words = [_WORD.findall(t.lower()) if self._plain(t) else None for t in part]
            self._learn(set().union(*filter(None, words)))
            known = self.memo.__getitem__
            for text, own in zip(part, words):
                yield self._whole(text) if own is None else b"".join(map(known, own))

    def _plain(self, text: str) -> bool:
        if not self.by_word or any(s in text for s in self.special):
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False


_ENCODERS: dict[str, Encoder] = {}


def _cutter(tokenizer_path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.ids(batch["text"].tolist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.memo, encoder.older = {}, {}  # the worker goes on to other work
        release_arrow_memory()

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents cut at the capacity."""
    # Ids travel as strings: pandas would make them doubles where one is null.
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), whole_text(text_col).alias("text"))
    cut = texts.mapInPandas(_cutter(tokenizer_path, capacity), _PIECES)
    return cut.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Segments ``length, first rank, pieces a sequence, first sequence, offset``, sorted.

    ``counts`` maps lengths to numbers of pieces.  The size of the plan follows
    from the capacity, not from the counts.
    """
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    order: list[int] = []  # the gaps there are, ascending
    segments, opened = [], 0

    def put(length: int, number: int, each: int, first: int, offset: int) -> None:
        segments.append((length, ranks[length], each, first, offset))
        ranks[length] += number
        left[length] -= number

    def free(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a and left[a] < 2 else 1):
                at -= 1
            if at < 0:
                number, first = left[a], opened
                put(a, number, 1, first, 0)
                free(capacity - a, first, number)
            elif (b := large[at]) == a:
                number, first = left[a] // 2, opened
                put(a, 2 * number, 2, first, 0)
                free(capacity - 2 * a, first, number)
            else:
                number, first = min(left[a], left[b]), opened
                put(a, number, 1, first, 0)
                put(b, number, 1, first, a)
                free(capacity - a - b, first, number)
            opened += number
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                number = -(-left[s] // each)
                free(capacity, opened, number)
                opened += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each, offset = gap // s, capacity - gap
            full = min(number, left[s] // each)
            if full:
                put(s, full * each, each, first, offset)
                free(gap - each * s, first, full)
            if full < number:
                rest = left[s]  # fewer than fill one more sequence
                if rest:
                    put(s, rest, rest, first + full, offset)
                    free(gap - rest * s, first + full, 1)
                    full += 1
                free(gap, first + full, number - full)
    return np.array(sorted(segments), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece with its place: the columns of ``pieces``, ``sequence_id, offset``.

    Sequences are gapless from 0 and hold at most ``capacity`` tokens.  A null
    or empty text is the end id alone; null and repeated ids are packed like any
    other row; an empty table gives no rows; other columns are not read.
    """
    rows = kept(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # <= capacity rows
    segments = plan(counts, capacity)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = np.int64(1) << 44
        starts = segments[:, 0] * wide + segments[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            own = segments[np.searchsorted(starts, length * wide + rank, "right") - 1]
            nth = rank - own[:, 1]
            yield batch.drop(columns="rank").assign(
                sequence_id=own[:, 3] + nth // own[:, 2],
                offset=own[:, 4] + nth % own[:, 2] * length,
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Pieces of one length are interchangeable; their ranks come from ranges.
    ranked = with_position(rows, columns, within=["length"], name="rank").select(*columns, "rank")
    placed = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        place, _PIECES + ", sequence_id bigint, offset bigint"
    )
    return placed.withColumn("doc_id", F.col("doc_id").cast("bigint"))
