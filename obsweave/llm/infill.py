"""Fill-in-middle examples cut from a store of seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` code points, with
the number of code points before each frame.  To cut a text, the frames that hold
the cuts are found by these counts and only they are decompressed; all others
move to their place in the example as they are.  Digests stream the frames in
order, one decompressed at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsweave.llm.common import kept, release_arrow_memory, whole_text

FRAME = 8192  # code points
LEVEL = 1

# The marks of an example.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

FRAMES = "array<struct<start:bigint,units:int,data:binary>>"


@cache
def _codec():
    """One compressor and decompressor a worker; frames are independent of one another."""
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _packed(text: str) -> dict:
    return {"units": len(text), "data": _codec()[0].compress(text.encode("utf-8"))}


def _text(frame: dict) -> str:
    return _codec()[1].decompress(frame["data"]).decode("utf-8")


def _frames(text: str) -> list[dict]:
    return _in_line(_packed(text[at : at + FRAME]) for at in range(0, len(text), FRAME))


def _in_line(frames: Iterable[dict]) -> list[dict]:
    """Frames with the number of code points before each."""
    line, start = [], 0
    for frame in frames:
        line.append({"start": start, "units": frame["units"], "data": frame["data"]})
        start += frame["units"]
    return line


def cut(frames: list[dict], start: int, end: int) -> Iterator[dict]:
    """The frames of ``start`` to ``end``; only those that hold a cut are unpacked."""
    for frame in frames:
        low, high = max(start, frame["start"]), min(end, frame["start"] + frame["units"])
        if low >= high:
            continue
        if high - low == frame["units"]:
            yield frame
        else:
            yield _packed(_text(frame)[low - frame["start"] : high - frame["start"]])


def arranged(frames: list[dict], form: str, first: int, second: int, total: int) -> list[dict]:
    """The frames of an example; ``plain`` ones are those of the text."""
    if form == "plain":
        return frames
    prefix, middle, suffix = cut(frames, 0, first), cut(frames, first, second), cut(frames, second, total)
    before, after = ((PREFIX, prefix), (SUFFIX, suffix)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix))
    parts = (before, after, (MIDDLE, middle))
    return _in_line(frame for mark, part in parts for frame in (_packed(mark), *part))


def texts(frames: Iterable[dict]) -> Iterator[str]:
    for frame in frames:
        yield _text(frame)


def streamed_digest(pieces: Iterable[str]) -> str:
    found = hashlib.sha256()
    for piece in pieces:
        found.update(piece.encode("utf-8"))
    return found.hexdigest()


def mark_places(frames: list[dict]) -> dict[str, int]:
    """Where each mark first stands, found in one pass over the text of the frames."""
    places, tail, done = {}, "", 0
    for piece in texts(frames):
        seen = tail + piece
        for mark in MARKS:
            at = -1 if mark in places else seen.find(mark)
            if at >= 0:
                places[mark] = done - len(tail) + at
        done += len(piece)
        tail = seen[-(len(MIDDLE) - 1) :]
    return places


def restored(frames: list[dict], form: str) -> Iterator[dict]:
    """The frames of the text an example was made from, told by its marks and form alone."""
    if form == "plain":
        yield from frames
        return
    total = sum(frame["units"] for frame in frames)
    at = mark_places(frames)
    order = sorted(MARKS, key=at.__getitem__)
    ends = {mark: at[later] for mark, later in zip(order, order[1:])} | {order[-1]: total}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from cut(frames, at[mark] + len(mark), ends[mark])


def draws(id_col: str, seed: str) -> list[Column]:
    """Four numbers below 2^32 that hang on the id alone."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", plain: int = 10, spm: int = 20) -> DataFrame:
    """The frame store of ``docs``: ``doc_id, n, form, first, second, frames``, written to the shared folder.

    The prefix ends at ``first``, the middle at ``second``, both drawn from the
    id.  ``plain`` of 100 texts stay as they are, and all that are empty or hold a
    mark; of the others ``spm`` of 100 have the suffix before the prefix.
    """
    text = whole_text(text_col)
    n = F.char_length(text).cast("bigint")
    h1, h2, h3, h4 = draws(id_col, seed)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    is_plain = (n == 0) | marked | (h3 % 100 >= 100 - plain)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        n.alias("n"),
        F.when(is_plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias("form"),
        F.least(h1 % (n + 1), h2 % (n + 1)).alias("first"),
        F.greatest(h1 % (n + 1), h2 % (n + 1)).alias("second"),
        text.alias("text"),
    )

    def write(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("units", pa.int32()), ("data", pa.binary())]))
        for batch in batches:
            for part in _slices(batch):
                framed = pa.array([_frames(text.as_py()) for text in part["text"]], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], framed], [*part.schema.names[:-1], "frames"])
            release_arrow_memory()

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n bigint, form string, first bigint, second bigint, frames {FRAMES}"
    return kept(rows.mapInArrow(write, schema), "infill-frames")


SLICE = 64  # rows whose texts a worker holds unpacked at once


def _slices(batch):
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def fill_in_middle(frames: DataFrame) -> DataFrame:
    """The examples of a frame store: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``output`` holds the frames of the example.  Where the form is plain both
    counts are null and the output is the text.
    """

    def arrange(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                rows = part.to_pylist()
                output = [arranged(r["frames"], r["form"], r["first"], r["second"], r["n"]) for r in rows]
                plain = [r["form"] == "plain" for r in rows]
                prefix = [None if p else r["first"] for p, r in zip(plain, rows)]
                middle = [None if p else r["second"] - r["first"] for p, r in zip(plain, rows)]
                columns = [*part.columns[:3], pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
                names = [*part.schema.names[:3], "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(output, part.column(5).type)], names)
            release_arrow_memory()

    kind = frames.schema["doc_id"].dataType.simpleString()
    return frames.mapInArrow(
        arrange, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output {FRAMES}"
    )


def with_digests(examples: DataFrame) -> DataFrame:
    """Examples with ``output_sha256`` and, of the text rebuilt from output and form, ``restored_sha256``."""

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                of_output, of_text = [], []
                for form, output in zip(part["form"].to_pylist(), part["output"].to_pylist()):
                    of_output.append(streamed_digest(texts(output)))
                    of_text.append(streamed_digest(texts(restored(output, form))))
                columns = [*part.columns[:-1], pa.array(of_output, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "output_sha256", "restored_sha256"])
            release_arrow_memory()

    kept_columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in examples.schema if f.name != "output")
    return examples.mapInArrow(digest, f"{kept_columns}, output_sha256 string, restored_sha256 string")


def output_text(examples: DataFrame) -> DataFrame:
    """Examples with their whole text as ``output``, for writers that want strings."""

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                whole = ["".join(texts(output)) for output in part["output"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(whole, pa.string())], part.schema.names)
            release_arrow_memory()

    kept_columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in examples.schema if f.name != "output")
    return examples.mapInArrow(unpack, f"{kept_columns}, output string")


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **choice) -> DataFrame:
    """Every row of ``docs`` as an example of ``fill_in_middle``.

    Null texts count as empty and stay plain, like every empty text.  A null id
    draws like an empty one; rows of one id draw alike, each for its own text.
    Very long texts cost the memory of the row itself and one frame unpacked.
    Only the id and the text are read, so names of other columns do not matter;
    without rows there is no result.
    """
    return fill_in_middle(store(docs, id_col, text_col, **choice))
