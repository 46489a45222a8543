"""Rolling statistics of sorted rows on arrays, in time linear in the rows (but for a logarithm).

Time is cut into blocks as long as the frame, so a frame is always the tail of one
block plus the head of the next.  Running statistics of heads and tails are merged
per row.  What comes out depends on the rows of the two blocks alone and not on
what else lies in the arrays, to the last digit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

Stats = Mapping[str, Sequence[str]]


LONG = 128  # rows of a block that is taken by itself


def running(op, values, place):
    """``op`` over the rows of a block up to each row; ``place`` counts the rows before it in its block."""
    import numpy as np

    out, step = values.copy(), 1
    begins = np.flatnonzero(place == 0)
    ends = np.r_[begins[1:], len(place)]
    long = ends - begins >= LONG
    for begin, end in zip(begins[long], ends[long]):
        op.accumulate(values[begin:end], axis=0, out=out[begin:end])
    rows = np.flatnonzero(np.repeat(~long, ends - begins) & (place > 0))
    while len(rows):
        out[rows] = op(out[rows], out[rows - step])
        step *= 2
        rows = rows[place[rows] >= step]
    return out


def _half(values, known, place):
    """Count, sum, squares about the mean, least and greatest value of the rows from each block's first."""
    import numpy as np

    blocks = np.flatnonzero(place == 0)
    held = np.where(known, np.arange(len(values))[:, None], len(values) - 1)
    # Squares are taken about a value that every set with any value holds.
    earliest = np.minimum.reduceat(held, blocks, axis=0)
    centre = np.take_along_axis(values, earliest, axis=0)[np.cumsum(place == 0) - 1]
    gaps = np.where(known, values - centre, 0.0)
    count = running(np.add, known.astype(float), place)
    drift = running(np.add, gaps, place)
    squares = running(np.add, gaps * gaps, place) - drift * drift / np.maximum(count, 1)
    return {
        "count": count,
        "sum": running(np.add, np.where(known, values, 0.0), place),
        "squares": np.maximum(squares, 0.0),
        "min": running(np.fmin, np.where(known, values, np.nan), place),
        "max": running(np.maximum, np.where(known, values, -np.inf), place),
    }


def frame_statistics(line, block, width: int, values, known) -> dict:
    """For each row mean, std, min, max and sum of the rows at most ``width`` before it, and their count.

    ``line`` is ascending time, ``block`` numbers the stretches of ``width`` in it;
    ``values`` and ``known`` have a column per measure.  Rows at one time are in one
    another's frames.  A statistic holds only where the count gives it one.
    """
    import numpy as np

    if not len(line):
        return {stat: values.copy() for stat in ("count", "mean", "std", "min", "max", "sum")}
    rows = np.arange(len(line))
    begins = np.r_[True, block[1:] != block[:-1]]
    first = np.maximum.accumulate(np.where(begins, rows, 0))
    ends = np.r_[begins[1:], True]
    last = np.minimum.accumulate(np.where(ends, rows, len(rows))[::-1])[::-1]
    with np.errstate(all="ignore"):
        head = _half(values, known, rows - first)
        back = _half(values[::-1], known[::-1], (last - rows)[::-1])
        here = np.searchsorted(line, line, side="right") - 1
        reach = np.searchsorted(line, line - width, side="left")
        behind = (reach < first)[:, None]
        head = {stat: found[here] for stat, found in head.items()}
        tail = {stat: found[::-1][reach] for stat, found in back.items()}
        n, m = head["count"], np.where(behind, tail["count"], 0.0)
        total = head["sum"] + np.where(behind, tail["sum"], 0.0)
        gap = head["sum"] / n - tail["sum"] / m
        between = np.where((n > 0) & (m > 0), gap * gap * n * m / (n + m), 0.0)
        squares = head["squares"] + np.where(behind, tail["squares"], 0.0) + between
        return {
            "count": n + m,
            "mean": total / (n + m),
            "std": np.sqrt(squares / (n + m - 1)),
            "min": np.fmin(head["min"], np.where(behind, tail["min"], np.nan)),
            "max": np.maximum(head["max"], np.where(behind, tail["max"], -np.inf)),
            "sum": total,
        }


def least_count(stat: str) -> int:
    """The known values that a statistic needs."""
    return 2 if stat == "std" else 1
