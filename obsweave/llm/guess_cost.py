"""How many bits a guesser needs for a value: minimum-cost segmentation.

A value is cut into words, dates, repeats, keyboard walks, runs of neighbouring
code points and brute-force spans; the cost of a segmentation is the sum of its
segments' bits, ``SEGMENT_BITS`` for the choice of each kind included, and
dynamic programming finds the least.  Time and memory are linear in the length.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from math import log2

# What replaces which letter, and the rows of a keyboard.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

# Values that guessers try first, beside the words of a vocabulary.
COMMON = (
    "123456", "password", "12345678", "qwerty", "admin", "letmein", "welcome", "monkey", "dragon", "master",
    "login", "abc123", "iloveyou", "changeme", "secret", "example", "test", "guest", "default", "passw0rd",
)

SEGMENT_BITS = log2(6)
WALK_START, WALK_STEP = log2(47), log2(5)
RUN_START, RUN_STEP = log2(96), log2(2)
MAX_UNIT = 8  # characters of a repeated unit
DATE_BITS, YEAR_BITS = log2(366 * 150), log2(150)
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
_DATES = [
    (re.compile(f"(?=({pattern}))", re.ASCII), bits)
    for pattern, bits in (
        (rf"{_YEAR}([-/._]?){_MONTH}\2{_DAY}", DATE_BITS),
        (rf"{_DAY}([-/._]?){_MONTH}\2{_YEAR}", DATE_BITS),
        (rf"{_DAY}([-/._]?){_MONTH}\2\d\d", DATE_BITS),
        (_YEAR, YEAR_BITS),
    )
]
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_PLAIN = str.maketrans(LEET)


def character_bits(c: str) -> float:
    """What brute force pays for a character: the size of the class it is from."""
    if "0" <= c <= "9":
        return log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log2(26)
    return log2(33) if c < "\x7f" else log2(100)


@cache
def _neighbours() -> frozenset[tuple[str, str]]:
    """Pairs of keys that touch: in one row, or in the next and at most one place over."""
    at = {key: (row, col) for row, keys in enumerate(KEY_ROWS) for col, key in enumerate(keys)}
    return frozenset(
        (a, b)
        for a, (row, col) in at.items()
        for b, (other, place) in at.items()
        if (row == other and abs(col - place) == 1) or (other == row + 1 and 0 <= col - place <= 1) or (row == other + 1 and 0 <= place - col <= 1)
    )


def walks(a: str, b: str) -> bool:
    return (a.translate(_LOWER), b.translate(_LOWER)) in _neighbours()


def follows(a: str, b: str) -> bool:
    """Neighbouring letters or digits, up or down, as in ``abc`` and ``321``."""
    return a.isalnum() and b.isalnum() and a < "\x7f" and b < "\x7f" and abs(ord(a) - ord(b)) == 1


@dataclass(frozen=True)
class Words:
    """Words a guesser knows, the likeliest first."""

    ranked: tuple[str, ...]

    @cached_property
    def rank(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for word in self.ranked:
            found.setdefault(word, len(found) + 1)
        return found

    @cached_property
    def beginnings(self) -> frozenset[str]:
        return frozenset(word[:i] for word in self.ranked for i in range(1, len(word) + 1))

    def found(self, value: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and bits of every word in a value.

        A word costs its rank, its capitals, and its letters written as digits or
        signs.
        """
        low = value.translate(_LOWER)
        plain = low.translate(_PLAIN)
        for start in range(len(value)):
            for end in range(start + 1, len(value) + 1):
                if plain[start:end] not in self.beginnings and low[start:end] not in self.beginnings:
                    break
                if end - start < 3:
                    continue
                bits = [
                    log2(self.rank[word]) + sum(a != b for a, b in zip(word, low[start:end]))
                    for word in {low[start:end], plain[start:end]}
                    if word in self.rank
                ]
                if bits:
                    yield start, end, min(bits) + _case_bits(value[start:end])


def _case_bits(word: str) -> float:
    """One capital at the start, or capitals throughout, are tried first."""
    capitals = [i for i, c in enumerate(word) if "A" <= c <= "Z"]
    if not capitals:
        return 0.0
    return 1.0 if capitals == [0] or len(capitals) == len(word) else float(len(word))


@cache
def vocabulary(path: str, least: int = 3) -> Words:
    """The whole words of a tokenizer's vocabulary, which lists the commoner first."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    whole = [w.removesuffix("</w>") for w, _ in sorted(ids.items(), key=lambda item: item[1]) if w.endswith("</w>")]
    return Words(COMMON + tuple(w for w in whole if len(w) >= least and w.isascii() and w.isalpha()))


def pieces(value: str, words: Words) -> list[list[tuple[int, float]]]:
    """For each start the ends and bits of words, dates and repeats, these as far as they go.

    Walks, runs and brute force grow by the character instead.
    """
    found: list[list[tuple[int, float]]] = [[] for _ in value]
    for start, end, bits in words.found(value):
        found[start].append((end, bits))
    for pattern, bits in _DATES:
        for match in pattern.finditer(value):
            found[match.start()].append((match.end(1), bits))
    for unit in range(1, MAX_UNIT + 1):
        same = 0  # characters from here on that equal the one a unit later
        for start in range(len(value) - unit - 1, -1, -1):
            same = same + 1 if value[start] == value[start + unit] else 0
            times = same // unit + 1
            if times >= 2 and times * unit >= 3:
                once = sum(map(character_bits, value[start : start + unit]))
                found[start].append((start + times * unit, once + log2(times)))
    return found


def guess_bits(value: str, words: Words) -> float:
    """The bits of the cheapest segmentation; 0 for an empty value."""
    unreached = float("inf")
    best = [0.0] + [unreached] * len(value)
    segments = pieces(value, words)
    brute = walk = run = unreached
    for i, c in enumerate(value):
        fresh = best[i] + SEGMENT_BITS
        for end, bits in segments[i]:
            best[end] = min(best[end], fresh + bits)
        stepped = i > 0
        brute = min(fresh, brute) + character_bits(c)
        walk = min(fresh + WALK_START, walk + WALK_STEP if stepped and walks(value[i - 1], c) else unreached)
        run = min(fresh + RUN_START, run + RUN_STEP if stepped and follows(value[i - 1], c) else unreached)
        best[i + 1] = min(best[i + 1], brute, walk, run)
    return best[-1]
