"""Window operators over long series that never put a whole series in one task.

A series (one ``key``) is cut into time buckets.  Every bucket gets the rows
its frames reach into from its neighbours as *context*, the windows run per
(key, bucket), and the context rows are dropped again.  Results equal plain
windows over the whole series, but a key that holds most of the table is
spread over as many tasks as it has buckets.

Rows are unique on (key, second) by the table contract, so a bucket of H hours
holds at most 3600 * H own rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from obsweave.operators.rolling import Stats, frame_statistics, least_count

BUCKET, OWN, MICROS = "_bucket", "_own", "_micros"
HOUR_MICROS = 3_600_000_000


def micros(time: str | Column) -> Column:
    return F.unix_micros(F.col(time) if isinstance(time, str) else time)


def floor_div(value: Column, width: int) -> Column:
    """Whole multiples of ``width`` in ``value``, rounding down for negatives too."""
    wide = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, wide), wide)


def bucket_of(time: str | Column, hours: int) -> Column:
    return floor_div(micros(time), hours * HOUR_MICROS)


def series_window(key: str = "city", *dealt: str) -> Window:
    """The window spec all frames over ``with_context`` output share (one sort).

    ``dealt`` names columns that follow from the key, by which rows lie in their tasks.
    """
    return Window.partitionBy(key, BUCKET, *dealt).orderBy(MICROS)


def hours_frame(window, hours: int):
    """Closed frame from ``hours`` before the row up to the row."""
    return window.rangeBetween(-hours * HOUR_MICROS, 0)


def with_context(
    df: DataFrame,
    *,
    bucket_hours: int,
    lookback_hours: int = 0,
    lag_rows: int = 0,
    lag_columns: Sequence[str] = (),
    lead_rows: int = 0,
    lead_columns: Sequence[str] = (),
    narrow: Sequence[str] | None = None,
    key: str = "city",
    time: str = "timestamp",
) -> DataFrame:
    """Rows tagged with ``_bucket``, ``_own`` and ``_micros``, context included.

    Context of a bucket: every row in the ``lookback_hours`` before it, the
    ``lag_rows`` rows before it however old, and the ``lead_rows`` rows after
    it however late.  ``_own`` is false for the first kind and null for the others.
    With ``narrow`` the first kind keeps those columns alone, and rows without a
    time are own rows of a bucket without a number.
    """
    if lookback_hours > bucket_hours:
        raise ValueError("a bucket must be at least as long as the lookback")
    width, reach = bucket_hours * HOUR_MICROS, lookback_hours * HOUR_MICROS
    keyed = df.withColumn(MICROS, micros(time)).withColumn(BUCKET, floor_div(F.col(MICROS), width))

    if reach:
        near_end = F.pmod(F.col(MICROS), F.lit(width).cast("bigint")) >= width - reach
        homes = F.when(near_end, F.array(F.col(BUCKET), F.col(BUCKET) + 1)).otherwise(
            F.array(BUCKET)
        )
        home = F.col("_home")
        rows = (
            keyed.withColumn("_home", F.explode(homes))
            .withColumn(OWN, home == F.col(BUCKET) if narrow is None else home.eqNullSafe(F.col(BUCKET)))
            .withColumn(BUCKET, home)
            .drop("_home")
        )
        if narrow is not None:
            whole = {key, BUCKET, OWN, MICROS, *narrow}
            rows = rows.select(*[F.col(c) if c in whole else F.when(F.col(OWN), F.col(c)).alias(c) for c in rows.columns])
    else:
        rows = keyed.withColumn(OWN, F.lit(True))

    context = []
    if lag_rows:
        before = _edge_rows(keyed, key, lag_columns, lag_rows, last=True)
        context.append(before.where(F.col(MICROS) < F.col(BUCKET) * width - reach))
    if lead_rows:
        context.append(_edge_rows(keyed, key, lead_columns, lead_rows, last=False))
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [c.withColumn(OWN, F.lit(None).cast("boolean")) for c in context],
        rows,
    )


def _edge_rows(
    keyed: DataFrame, key: str, columns: Iterable[str], count: int, *, last: bool
) -> DataFrame:
    """For each non-empty bucket, the nearest ``count`` rows outside it.

    ``last`` picks the rows before the bucket, otherwise those after it.  Each
    bucket first keeps only its ``count`` edge rows (pruned before the
    shuffle); what is then ordered per key is one short array per bucket, so
    its size depends on the length of the calendar and not on the row count.
    """
    columns = list(dict.fromkeys(columns))
    order = F.col(MICROS).desc() if last else F.col(MICROS).asc()
    edge = (
        keyed.select(key, BUCKET, MICROS, *columns)
        .withColumn("_n", F.row_number().over(Window.partitionBy(key, BUCKET).orderBy(order)))
        .where(F.col("_n") <= count)
        .groupBy(key, BUCKET)
        .agg(F.sort_array(F.collect_list(F.struct(MICROS, *columns)), asc=True).alias("_edge"))
    )
    along = Window.partitionBy(key).orderBy(BUCKET)
    reach = along.rowsBetween(-count, -1) if last else along.rowsBetween(1, count)
    near = F.flatten(F.collect_list("_edge").over(reach))
    if last:
        start = F.greatest(F.size("_near") - count + 1, F.lit(1))
        nearest = F.slice("_near", start, F.lit(count))
    else:
        nearest = F.slice("_near", 1, count)
    return (
        edge.select(key, BUCKET, near.alias("_near"))
        .select(key, BUCKET, F.explode(nearest).alias("_row"))
        .select(key, BUCKET, "_row.*")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(BUCKET, OWN, MICROS)


def split_frames(
    tagged: DataFrame,
    frames: Mapping[int, Stats],
    *,
    name,
    key: str = "city",
    dealt: Sequence[str] = (),
) -> DataFrame:
    """Rolling statistics over the last hours, ``frames`` by their length, in time linear in the rows.

    ``tagged`` comes from ``with_context``, whole buckets in a task, with the longest
    frame as lookback and buckets that are a multiple of it; only own rows come out.
    Where windows were taken over them, their order serves here too: one exchange and
    one sort for all.  Tasks cut buckets into blocks as long as the longest frame and take
    each with the one before as arrays, in which a frame is the tail of one stretch
    plus the head of the next.  ``name(column, stat, hours)`` names the outputs; stats are
    mean, std, min, max and sum.  Rows without a time are in one another's frames alone.
    """
    span = max(frames) * HOUR_MICROS
    measures = list(dict.fromkeys(c for stats in frames.values() for c in stats))
    outputs = [
        (name(c, stat, hours), c, stat, hours) for hours, stats in frames.items() for c, wanted in stats.items() for stat in wanted
    ]
    kept = tagged.drop(BUCKET, OWN, MICROS)
    schema = StructType([*kept.schema.fields, *[StructField(out, DoubleType()) for out, *_ in outputs]])
    columns = kept.columns

    def derive(batches):
        for rows in _whole_blocks(batches, key, span):
            yield from _with_frames(rows, columns, measures, outputs, key, span).to_batches(max_chunksize=10_000)

    ordered = tagged.where(F.col(OWN).isNotNull()).sortWithinPartitions(key, BUCKET, *dealt, MICROS)
    return ordered.mapInArrow(derive, schema)


def _places(rows, key: str, span: int):
    """Of a sorted Arrow table: which key and bucket each row is of, counted up, and which block of ``span``."""
    import numpy as np

    begins = np.ones(rows.num_rows, bool)
    codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    bucket = rows.column(BUCKET)
    known, bucket = bucket.is_valid().to_numpy(), bucket.fill_null(0).to_numpy()
    begins[1:] = (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1]) | (known[1:] != known[:-1])
    return np.cumsum(begins), rows.column(MICROS).fill_null(0).to_numpy() // span


def _block_starts(group, home):
    import numpy as np

    return np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (home[1:] != home[:-1])])


def _whole_blocks(batches, key: str, span: int):
    """Arrow tables that end where a block ends, of batches that may end within one.

    One that begins within a bucket has the block before as context.
    """
    import pyarrow as pa

    def place(rows, n):
        at = rows.column(MICROS)[n].as_py()
        return rows.column(key)[n].as_py(), rows.column(BUCKET)[n].as_py(), at is not None and at // span

    held, where = [], None  # the rows of a block that may go on, and which it is
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        begins, ends = place(rows, 0), place(rows, -1)
        held.append(rows)
        if begins == ends == where:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        group, home = _places(rows, key, span)
        starts = _block_starts(group, home)
        last = int(starts[-1])
        held, where = [rows.slice(last)], ends
        if last:
            yield rows.slice(0, last)
            before = int(starts[-2])
            if group[before] == group[last]:
                held.insert(0, _as_context(rows.slice(before, last - before)))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _as_context(rows):
    import pyarrow as pa

    n = rows.schema.get_field_index(OWN)
    return rows.set_column(n, rows.schema.field(n), pa.array([False] * rows.num_rows, pa.bool_()))


def _with_frames(rows, columns, measures, outputs, key: str, span: int):
    """The own rows of whole blocks with their rolling statistics."""
    import numpy as np
    import pyarrow as pa

    rows = rows.combine_chunks()
    group, home = _places(rows, key, span)
    own = rows.column(OWN).to_numpy()
    first = _block_starts(group, home)
    end = np.r_[first[1:], rows.num_rows]
    # A block is taken with the one before it, if that has rows.
    follows = np.r_[False, (group[first[1:]] == group[first[:-1]]) & (home[first[1:]] == home[first[:-1]] + 1)]
    begin = np.where(follows, np.r_[0, first[:-1]], first)
    begin, first, end = begin[own[first]], first[own[first]], end[own[first]]
    size = end - begin
    number = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
    shown = at >= first[number]
    # Time since the start of the block; its context lies before.
    since = rows.column(MICROS).fill_null(0).to_numpy()[at] - home[first][number] * span
    line = number * (2 * span) + span + since
    doubles = [rows.column(c).cast(pa.float64()) for c in measures]
    known = np.column_stack([c.is_valid().to_numpy() for c in doubles])[at]
    values = np.column_stack([c.fill_null(0.0).to_numpy() for c in doubles])[at]
    found = {}
    for hours in dict.fromkeys(h for *_, h in outputs):
        width = hours * HOUR_MICROS
        block = number * (2 * (span // width + 2)) + since // width
        wanted = [measures.index(c) for c in dict.fromkeys(c for _, c, _, h in outputs if h == hours)]
        derived = frame_statistics(line, block, width, values[:, wanted], known[:, wanted])
        place = {measures[i]: n for n, i in enumerate(wanted)}
        for out, column, stat, h in outputs:
            if h == hours:
                absent = derived["count"][shown, place[column]] < least_count(stat)
                found[out] = pa.array(derived[stat][shown, place[column]], mask=absent)
    result = rows.select(columns).filter(pa.array(own))
    for out, *_ in outputs:
        result = result.append_column(out, found[out])
    return result
