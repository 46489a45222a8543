"""64-bit hashes of the words and shingles of many texts at once.

Words are what stands between ASCII white space (or other bytes named as
separators), A-Z lower-cased.  A word's hash
is a polynomial of its bytes taken from one running sum over a slice of text, so
the work per byte is a few array operations and nothing is done per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 18  # bytes hashed at once
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_COEFFICIENTS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# For words without the marks around them: every ASCII byte but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_POWERS: dict[int, np.ndarray] = {}


def _powers(root: int, n: int) -> np.ndarray:
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), root, np.uint64)
        have[0] = 1
        _POWERS[root] = have = np.multiply.accumulate(have)
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_words(raw: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    buffer = np.frombuffer(raw, np.uint8)
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * _powers(_ROOT, n), out=sums[1:])
    white = np.ones(n + 2, bool)
    white[1:-1] = separators[buffer]
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return starts, scramble((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts])


def _long_words(raw: bytes, separators: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slice by slice."""
    parts, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE)
        while stop < len(raw) and not separators[raw[stop]]:
            stop += 1
        parts.append(_slice_words(raw[at:stop], separators)[1])
        at = stop
    return np.concatenate(parts)


def _joined_words(raws: list[bytes], separators: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each of several texts that fit one slice together."""
    starts, hashes = _slice_words(b"\n".join(raws), separators)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    return np.split(hashes, np.searchsorted(starts, offsets[1:-1]))


def words(texts: list[str], separators: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order of the text."""
    pending, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower is ASCII only
        if pending and size + len(raw) > SLICE:
            yield from _joined_words(pending, separators)
            pending, size = [], 0
        if len(raw) > SLICE:
            yield _long_words(raw, separators)
        else:
            pending.append(raw)
            size += len(raw) + 1
    if pending:
        yield from _joined_words(pending, separators)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, ascending; a shorter text is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    own = min(width, len(hashes))
    joined = np.zeros(len(hashes) - own + 1, np.uint64)
    for i in range(own):
        joined += hashes[i : i + len(joined)] * _COEFFICIENTS[i]
    joined += np.uint64(own)
    return np.unique(scramble(joined))
