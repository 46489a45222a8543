"""Spans of secrets: fixed shapes, and what stands in a credential's place and is hard to guess."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import release_arrow_memory, whole_text
from obsweave.llm.guess_cost import Words, guess_bits, vocabulary

# Kind, pattern, the group whose length counts, its least length.
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.ASCII | re.IGNORECASE,
        ),
        2,
        8,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.ASCII), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}", re.ASCII), 0, 32),
)
KINDS = tuple(kind for kind, *_ in BASE) + ("guess",)

# Where a credential's value stands: after its name and a sign, after a scheme's
# name, or as the password of an address.
CONTEXTS = (
    re.compile(
        r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|account)[_-]?key|credentials?|auth(?:orization)?)"""
        r"""[a-z0-9_-]{0,32}["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'`<>,;(){}\[\]]{6,})""",
        re.ASCII | re.IGNORECASE,
    ),
    re.compile(r"\b(?:bearer|basic)\x20+([A-Za-z0-9._~+/=-]{8,})", re.ASCII | re.IGNORECASE),
    re.compile(r"://[^\s/:@]{1,64}:([^\s/@]{6,256})@", re.ASCII),
)
CLASSES = tuple(re.compile(p, re.ASCII) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))

# From here on a value counts as a secret: 10^10 guesses, where public password
# meters give their highest score.
MIN_BITS = 33.2

Span = tuple[int, int, str, float | None]


def base_spans(text: str, words: Words | None = None) -> Iterator[Span]:
    """Spans of the fixed shapes; with ``words`` the values of assignments get their bits."""
    for kind, pattern, group, least in BASE:
        for match in pattern.finditer(text):
            value = match[group]
            if len(value) >= least:
                bits = guess_bits(value, words) if kind == "assign" and words else None
                yield match.start(), match.end(), kind, bits


class _Covered:
    """What spans cover, as disjoint stretches in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, *_ in sorted(spans, key=lambda s: s[:2]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def costly_spans(text: str, words: Words, taken: list[Span], min_bits: float = MIN_BITS) -> Iterator[Span]:
    """Values in a credential's place that cost ``min_bits`` to guess and meet no span of ``taken``.

    A value of one class of characters is a word of the text, or a number, and no
    secret unless a fixed shape says so.
    """
    covered = _Covered(taken)
    for pattern in CONTEXTS:
        added: list[Span] = []
        for match in pattern.finditer(text):
            start, value = match.start(1), match[1].rstrip(".!?:")
            end = start + len(value)
            if sum(bool(c.search(value)) for c in CLASSES) > 1 and not covered.meets(start, end):
                bits = guess_bits(value, words)
                if bits >= min_bits:
                    added.append((start, end, "guess", bits))
        yield from added
        covered = _Covered([*taken, *added]) if added else covered
        taken = [*taken, *added]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in ordered(spans))


SCANNED = (
    "n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int,bits:double>>"
)


def scan(
    docs: DataFrame, words_path: str, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts, digests and ``found``, the spans with their bits.

    Spans count code points, the end exclusive, and are ordered by start, then
    kind.  ``guess`` spans are values in a credential's place that the fixed shapes
    miss and that cost ``min_bits`` to guess with the words of ``words_path``.  A
    null text counts as empty and has no spans.  Rows stand alone, so null and
    repeated ids and repeated rows change nothing; only the id and the text are
    read, whatever other columns are called; no rows give no rows.  The costs of a
    value grow with its length only, so very long ones are segmented whole.
    """

    def look(batches):
        import pyarrow as pa

        words = vocabulary(words_path)
        for batch in batches:
            rows = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found")}
            for text in batch["text"]:
                text = text.as_py()
                base = list(base_spans(text, words))
                every = base + list(costly_spans(text, words, base, min_bits))
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(s[2] == kind for s in every))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(every))
                rows["found"].append([{"kind": k, "start": a, "end": b, "bits": bits} for a, b, k, bits in ordered(every)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])))
            columns = [pa.array(values, kind) for values, kind in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *rows])
            release_arrow_memory()

    named = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return named.mapInArrow(look, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, {SCANNED}")
