"""Keyed writes on parquet tables laid out by day and key part: replace, and insert if absent.

One writer per table.  A key lies in one day and, by the hash of its station, in
one part of it; how many parts a day has is a setting of the table.  A write reads only the days and parts its rows fall in
and rewrites only those that hold a key already, so its cost follows the change;
Spark swaps rewritten partitions in when the job commits, so a failed job leaves
them as they were.  A null is a value of a key like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsweave.operators.latest import newest_row
from obsweave.session import cached, passing_shuffles, swap_in

DAY, PART, SLOT = "day", "part", "_slot"
NOTES = "_notes"  # a folder of a table that its readers pass over
PARTS = 1  # of a day, where a table is made without a number of its own
LISTED_DAYS = 1000  # beyond, a filter takes the span from the first to the last day
TASK_ROWS = 500_000  # of one day and part that one task writes


def with_day(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumn(DAY, F.to_date(time))


def part_of(key: str | Column, parts: int) -> Column:
    """The part of a key; of a literal, one that Spark folds and prunes partitions by."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def with_part(df: DataFrame, key: str = "city", parts: int = PARTS) -> DataFrame:
    return df.withColumn(PART, part_of(key, parts))


def table_parts(spark: SparkSession, path: str, parts: int | None = None) -> int:
    """The number of parts of the table at ``path``, fixed by its first write and, unless 1, kept beside it.

    A table of another number than the ``parts`` asked for is refused.
    """
    layout = path.rstrip("/") + "_layout"
    try:
        stored = int(spark.read.text(layout).first()["value"])
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = PARTS
        if (parts or PARTS) != PARTS and read_days(spark, path) is None:
            stored = parts
            spark.range(1).select(F.lit(str(stored)).alias("value")).coalesce(1).write.mode("overwrite").text(layout)
    if parts is not None and parts != stored:
        raise ValueError(f"the table at {path} has {stored} parts")
    return stored


def keep_newest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write per key wins, ``order`` giving the sequence of writes."""
    return newest_row(df, keys, order)


def keep_first(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """First write per key wins; without an order, one that depends on the rows alone."""
    order = F.col(order) if order else F.xxhash64(F.to_json(F.struct(*df.columns)))
    return newest_row(df.withColumn("_order", order), keys, ascending="_order").drop("_order")


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which a null key equals a null key."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(other, reduce(Column.__and__, same), how)


def replace_rows(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with every row whose key occurs in ``batch`` replaced by it."""
    kept = _match(existing, batch, keys, "left_anti").select(*batch.columns)
    return kept.unionByName(batch)


def absent_rows(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key ``existing`` does not hold."""
    return _match(batch, existing, keys, "left_anti")


def present_rows(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key ``existing`` holds."""
    return _match(batch, existing, keys, "left_semi")


def dealt(rows: DataFrame, keys: Sequence[str], heaviest: int) -> DataFrame:
    """Rows with a ``_slot``, a place's rows in one task, or in several where the ``heaviest`` place has many."""
    slots = -(-heaviest // TASK_ROWS) or 1
    return rows.withColumn(SLOT, F.pmod(F.xxhash64(*keys), F.lit(slots))).repartition(DAY, PART, SLOT)


def write_days(
    rows: DataFrame,
    path: str,
    mode: str,
    *,
    sort: Sequence[str | Column] = ("city", "timestamp"),
    whole: bool = False,
    notes: Mapping[str, str] | None = None,
) -> None:
    """Write rows under their ``day`` (and ``part``), files sorted so their min/max prune reads.

    ``whole`` makes an overwrite replace the table, not only the days written: the
    new table is written beside the old one and takes its place when it is done,
    with ``notes`` (name to text) kept in it.  The rebalance hint lets AQE give a heavy day several files and put light
    days together in one task.  Rows with a ``_slot`` have been placed, as by ``dealt``, and
    stay in their tasks.  What the write shuffled is deleted with it.
    """
    layout = [c for c in (DAY, PART) if c in rows.columns]
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}" if whole else path
    # Parts are a table's own way to keep what one task writes small, so small days
    # of theirs are written side by side.
    if SLOT not in rows.columns:
        rows = rows.repartition(*layout) if PART in layout else rows.hint("rebalance", F.col(DAY))
    with passing_shuffles(rows.sparkSession):
        (
            rows.drop(SLOT)
            .sortWithinPartitions(*layout, *sort)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy(*layout)
            .parquet(target)
        )
    for name, text in (notes or {}).items():
        note = rows.sparkSession.range(1).select(F.lit(text).alias("value"))
        note.coalesce(1).write.mode("overwrite").text(f"{target}/{NOTES}/{name}")
    if whole:
        swap_in(rows.sparkSession, target, path)


def read_note(spark: SparkSession, path: str, name: str) -> str:
    """A text that was stored with the whole table at ``path``."""
    return spark.read.text(f"{path.rstrip('/')}/{NOTES}/{name}").first()["value"]


def write_counted(
    rows: DataFrame, path: str, *, usable: Column, whole: bool = True, notes: Mapping[str, str] | None = None
) -> dict[str, int]:
    """Write a table; its ``rows`` and ``usable`` ones, in one pass over the stored columns needed.

    Not by ``Observation``: in Spark 4.1 a session that has used one can no
    longer run forest classifiers, whose summaries drag it into their tasks.
    """
    write_days(rows, path, "overwrite", whole=whole, notes=notes)
    rows.sparkSession.catalog.refreshByPath(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(usable).alias("usable")).first().asDict()


def read_days(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def touched(batch: DataFrame, *columns: str) -> list:
    """The distinct days (and parts) of a batch: as many as its span of days has."""
    return [tuple(row) for row in batch.select(*(columns or (DAY,))).distinct().collect()]


def on_listed_days(days: Sequence) -> Column:
    """A partition filter for some days; a long list becomes its span."""
    known = sorted({d for d in days if d is not None})
    found = F.lit(False)
    if len(known) > LISTED_DAYS:
        found = F.col(DAY).between(known[0], known[-1])
    elif known:
        found = F.col(DAY).isin(known)
    return found | F.col(DAY).isNull() if None in days else found


def written_places(batch: DataFrame, near: DataFrame | None, keys: Sequence[str]) -> list:
    """Each (day, part) of a batch, whether ``near`` holds one of its keys there, and the rows it will have."""
    names = list(dict.fromkeys((DAY, PART, *keys)))
    seen = batch.select(*names, F.lit(True).alias("_fresh"))
    if near is None:
        met = seen.withColumn("_hit", F.lit(False))
    else:
        both = seen.unionByName(near.select(*names, F.lit(False).alias("_fresh")))
        hit = F.bool_or("_fresh") & ~F.bool_and("_fresh")
        met = both.groupBy(*names).agg(F.bool_or("_fresh").alias("_fresh"), hit.alias("_hit"))
    places = met.groupBy(DAY, PART).agg(F.bool_or("_fresh").alias("fresh"), F.bool_or("_hit").alias("hit"), F.count(F.lit(1)).alias("rows"))
    return [(day, part, hit, rows) for day, part, fresh, hit, rows in places.collect() if fresh]


def in_places(places: Sequence) -> Column:
    place = F.concat_ws("/", F.col(DAY).cast("string"), PART)
    return place.isin([f"{d}/{p}" if d is not None else str(p) for d, p in places])


def upsert(
    batch: DataFrame,
    path: str,
    *,
    keys: Sequence[str] = ("city", "timestamp"),
    order: str | None = None,
    time: str = "timestamp",
    drop: Sequence[str] = (),
    part_by: str | None = None,
    parts: int | None = None,
    newest: Sequence[NewestTable] = (),
) -> None:
    """Write ``batch``, replacing the rows of ``path`` with the same keys.

    Days and parts in which no key occurs again are appended to after reading
    their key columns alone; only the others are rewritten, and all in one write
    where most of them are.  Running a write again after a failure gives
    the same rows.

    The day is part of the identity of a row: ``time`` must be one of the keys;
    ``part_by`` is another (the first, if not given).  ``order`` names the column
    whose greatest value wins: within the batch, and against the stored row as
    well where the table keeps that column.  ``drop`` names columns not stored,
    ``parts`` the number of parts of a new table's days, and ``newest`` the
    tables of newest rows that follow this one.
    """
    if time not in keys:
        raise ValueError("the time column must be part of the key")
    spark = batch.sparkSession
    existing, parts = read_days(spark, path), table_parts(spark, path, parts)
    batch = with_part(with_day(batch, time), part_by or keys[0], parts)
    rows = keep_newest(batch, keys, order) if order else batch.dropDuplicates(list(keys))
    # Used by the list of places, the writes and the tables of newest rows.
    rows = written = cached(rows.drop(*drop))
    try:
        near = None
        if existing is not None:
            held = touched(rows, DAY, PART)
            near = existing.where(on_listed_days([d for d, _ in held]) & F.col(PART).isin(sorted({p for _, p in held})))
        places = written_places(rows, near, keys)
        heaviest = max((n for *_, n in places), default=0)
        again = [(d, p) for d, p, hit, _ in places if hit]
        if again:
            if 2 * len(again) > len(places):
                again = [(d, p) for d, p, *_ in places]
            old, new = near.where(in_places(again)), rows.where(in_places(again))
            if order and order in rows.columns:
                both = old.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
                # Of equal orders the row written later stays.  One exchange and one sort serve this and the write.
                version = list(dict.fromkeys((DAY, PART, *keys, SLOT)))
                merged = newest_row(dealt(both, keys, heaviest), version, order, [F.col("_new").desc()]).drop("_new")
            else:
                merged = dealt(replace_rows(old, new, [DAY, PART, *keys]), keys, heaviest)
            write_days(merged, path, "overwrite", sort=keys)
            rows = rows.where(~in_places(again)) if len(again) < len(places) else None
        if rows is not None:
            write_days(dealt(rows, keys, heaviest), path, "append", sort=keys)
        spark.catalog.refreshByPath(path)
        for table in newest:
            table.merge(written)
    finally:
        written.unpersist()


def compact(spark: SparkSession, path: str, days: Sequence, sort=("city", "timestamp")) -> None:
    """Write the files of some days again as few; appends leave one per batch, day and part."""
    existing = read_days(spark, path)
    if existing is not None:
        write_days(existing.where(on_listed_days(days)), path, "overwrite", sort=sort)
        spark.catalog.refreshByPath(path)


def insert_if_absent(
    batch: DataFrame,
    path: str,
    *,
    keys: Sequence[str] = ("city", "timestamp"),
    order: str | None = None,
    time: str = "timestamp",
    part_by: str | None = None,
    parts: int | None = None,
    newest: Sequence[NewestTable] = (),
    unique: bool = False,
) -> tuple[int, int]:
    """Append the rows whose key is new; returns (inserted, skipped).

    Of several rows of one key the first by ``order`` is inserted; a batch that
    holds each key once by the way it was made may say so by ``unique``.  ``parts``
    and ``newest`` are those of ``upsert``.
    """
    if time not in keys:
        raise ValueError("the time column must be part of the key")
    spark = batch.sparkSession
    existing = read_days(spark, path)
    batch = with_part(with_day(batch, time), part_by or keys[0], table_parts(spark, path, parts))
    # Evaluated once, for the counts, the list of days and the write.
    held = [cached(batch)]
    try:
        offered = {(d, p): n for d, p, n in batch.groupBy(DAY, PART).count().collect()}
        if not offered:
            return 0, 0
        fresh = batch if unique else keep_first(batch, keys, order)
        if existing is not None:
            fresh = absent_rows(existing.where(on_listed_days([d for d, _ in offered])), fresh, [DAY, PART, *keys])
        total = inserted = sum(offered.values())
        if existing is not None or not unique:
            held.append(cached(fresh))
            inserted = fresh.count()
        if inserted:
            write_days(dealt(fresh, keys, max(offered.values())), path, "append", sort=keys)
            spark.catalog.refreshByPath(path)
            for table in newest:
                table.merge(keep_first(batch, keys, order), replace=False)
        return inserted, total - inserted
    finally:
        for rows in held:
            rows.unpersist()


@dataclass(frozen=True)
class NewestTable:
    """The newest rows of every station, kept beside a history by its keyed writes.

    The table holds the ``keep`` rows of each ``key`` that come first by ``time``
    descending, then by ``ties`` descending, in hashed parts; what a write brings
    is merged into the parts of its stations only.  ``identity`` names the keys of
    the history: of two versions of a row the one that ``order`` puts later stays,
    of equal ones that merged later.  Merging a batch again changes nothing, late
    and corrected rows find their place, and a history never loses rows, so no
    station's newest row can become older.  Readers touch this table only.
    """

    path: str
    key: str = "city"
    time: str = "timestamp"
    identity: tuple[str, ...] = ("city", "timestamp")
    order: str | None = None
    ties: tuple[str, ...] = ()
    keep: int = 1
    parts: int = PARTS

    def first_rows(self, rows: DataFrame) -> DataFrame:
        """The rows that belong into the table, of rows with one version of each identity."""
        ranked = [F.col(c).desc_nulls_last() for c in (self.time, *self.ties)]
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(*ranked))
        return rows.withColumn("_place", place).where(F.col("_place") <= self.keep).drop("_place")

    def merge(self, batch: DataFrame, replace: bool = True) -> None:
        """Bring the table up to date with the written rows ``batch``, unique by identity.

        Without ``replace`` a row whose identity the history had before changes
        nothing: here the stored version stays, and where this table holds none,
        it holds newer rows of the station only.
        """
        spark = batch.sparkSession
        stored = read_days(spark, self.path)
        parts = table_parts(spark, self.path, self.parts)
        fresh = with_part(self.first_rows(batch.drop(DAY, PART)), self.key, parts)
        if stored is None:
            self._write(fresh)
            return
        fresh = cached(fresh)
        try:
            old = stored.where(F.col(PART).isin([p for (p,) in touched(fresh, PART)]))
            both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            if self.key in self.identity:
                both = both.repartition(self.key)  # a station has few rows here: one exchange serves both windows
            later = [F.col(self.order).desc_nulls_last()] if self.order else []
            ranked = [*later, F.col("_new").desc()] if replace else [F.col("_new").asc()]
            version = Window.partitionBy(*self.identity).orderBy(*ranked)
            single = both.withColumn("_version", F.row_number().over(version)).where("_version = 1")
            self._write(self.first_rows(single.drop("_new", "_version")))
        finally:
            fresh.unpersist()

    def rebuild(self, history: DataFrame) -> None:
        """Derive the table from a history with one version of each row."""
        parts = table_parts(history.sparkSession, self.path, self.parts)
        rows = with_part(self.first_rows(history.drop(DAY, PART)), self.key, parts)
        self._write(rows, whole=True)

    def _write(self, rows: DataFrame, whole: bool = False) -> None:
        write_days(rows, self.path, "overwrite", sort=(self.key, self.time), whole=whole)
        rows.sparkSession.catalog.refreshByPath(self.path)

    def read(self, spark: SparkSession, schema=None) -> DataFrame:
        """All rows; none before the first write where a ``schema`` is given."""
        found = read_days(spark, self.path)
        if found is None:
            if schema is None:
                raise ValueError(f"nothing was written to {self.path} yet")
            return spark.createDataFrame([], schema)
        return found.drop(PART)

    def of(self, spark: SparkSession, key, schema=None) -> DataFrame:
        """The rows of one station, from its part alone."""
        found = read_days(spark, self.path)
        if found is None:
            return self.read(spark, schema)
        same = F.col(self.key).eqNullSafe(F.lit(key).cast(found.schema[self.key].dataType))
        part = part_of(F.lit(key).cast(found.schema[self.key].dataType), self.parts)
        return found.where((F.col(PART) == part) & same).drop(PART)
