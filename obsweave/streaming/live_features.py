"""Lags, rolling statistics and differences on a stream, by keyed state and timers.

A station's state is the rows that still wait and a bounded ring of those before
them: as many as the longest lag counts, and those of the longest frame.  Rows
wait until the watermark passed the end of their span, so late and shuffled ones
find their place; then a timer derives the rows of all spans that the watermark has
passed, in order of time.  A station has one timer at a time, for its earliest span
that waits.  The columns equal those of the batch derivation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from obsweave.config import FeatureConfig
from obsweave.operators.rolling import frame_statistics, least_count
from obsweave.operators.series import HOUR_MICROS
from obsweave.plans.features import DELTAS, LAGGED, ROLLED, rolling_name, rolling_stats

GROUPS = ("lag", "rolling", "delta")
MEASURES = tuple(dict.fromkeys((*LAGGED, *ROLLED, *DELTAS)))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Derivation:
    """What is derived for the rows of one station, in order of time."""

    config: FeatureConfig

    @property
    def names(self) -> list[str]:
        lags = [f"{c}_lag_{k}h" for c in LAGGED for k in self.config.lag_rows]
        frames = [rolling_name(c, s, h) for h, stats in rolling_stats(MEASURES, self.config).items() for c, wanted in stats.items() for s in wanted]
        return [*lags, *frames, *DELTAS.values()]

    @property
    def ring_rows(self) -> int:
        return max((1, *self.config.lag_rows))

    @property
    def ring_micros(self) -> int:
        return self.config.longest_frame * HOUR_MICROS

    def columns(self, at, values, first: int) -> dict:
        """The derived columns of rows ``first`` and later; ``at`` ascends, ``values`` maps measures to arrays, NaN for null."""
        import numpy as np

        rows = np.arange(first, len(at))
        found = {}

        def lagged(column, k):
            out = np.full(len(rows), np.nan)
            have = rows >= k
            out[have] = values[column][rows[have] - k]
            return out

        for column in LAGGED:
            for k in self.config.lag_rows:
                found[f"{column}_lag_{k}h"] = lagged(column, k)
        table = np.column_stack([values[c] for c in MEASURES])
        known = ~np.isnan(table)
        table = np.where(known, table, 0.0)
        for hours, stats in rolling_stats(MEASURES, self.config).items():
            width, wanted = hours * HOUR_MICROS, [MEASURES.index(c) for c in stats]
            derived = frame_statistics(at, at // width, width, table[:, wanted], known[:, wanted])
            for place, (column, names) in enumerate(stats.items()):
                for stat in names:
                    enough = derived["count"][rows, place] >= least_count(stat)
                    found[rolling_name(column, stat, hours)] = np.where(enough, derived[stat][rows, place], np.nan)
        for column, name in DELTAS.items():
            found[name] = values[column][rows] - lagged(column, 1)
        return found


class LiveFeatures(StatefulProcessor):
    """State of one station: its waiting rows and its ring, and the time up to which rows were derived."""

    def __init__(self, derivation: Derivation, every_hours: int):
        self.derivation, self.every = derivation, every_hours * HOUR_MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = StructType([StructField("at", LongType()), *[StructField(c, DoubleType()) for c in MEASURES]])
        self.handle = handle
        self.rows = handle.getListState("rows", row)
        self.done = handle.getValueState("done", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        """Take the rows in; of rows at one time the last stays.  Nothing is derived yet."""
        waiting = {row[0]: row for row in self.rows.get()} if self.rows.exists() else {}
        done = self.done.get()[0] if self.done.exists() else None
        for batch in rows:
            for row in batch[["at", *MEASURES]].itertuples(index=False, name=None):
                at = int(row[0])
                if done is None or at >= done:
                    waiting[at] = (at, *[None if v != v else float(v) for v in row[1:]])
        if waiting:
            self.rows.put([waiting[at] for at in sorted(waiting)])
            self._wake([at for at in waiting if done is None or at >= done])
        return iter(())

    def _wake(self, times) -> None:
        """A timer at the end of the earliest span among the times of waiting rows."""
        if times:
            self.handle.registerTimer((min(times) // self.every + 1) * self.every // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """Derive the rows of the passed spans, and keep of them what later rows look back on."""
        import numpy as np
        import pandas as pd

        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        end = passed // self.every * self.every
        rows = list(self.rows.get()) if self.rows.exists() else []
        done = self.done.get()[0] if self.done.exists() else None
        at = np.array([row[0] for row in rows], np.int64)
        first = 0 if done is None else int(np.searchsorted(at, done, side="left"))
        last = int(np.searchsorted(at, end, side="left"))
        if first >= last:
            return
        values = {c: np.array([row[i] for row in rows[:last]], float) for i, c in enumerate(MEASURES, 1)}
        derived = self.derivation.columns(at[:last], values, first)
        keep = min(last - self.derivation.ring_rows, int(np.searchsorted(at, end - self.derivation.ring_micros, side="left")))
        self.rows.put(rows[max(keep, 0) :])
        self.done.update((end,))
        self._wake([row[0] for row in rows[last:]])
        own = {"city": [key[0]] * (last - first), "at": at[first:last], **{c: v[first:] for c, v in values.items()}}
        yield pd.DataFrame(own | derived)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs; a setting of new queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def live_features(rows: DataFrame, delay: str = "2 hours", every_hours: int = 1, config: FeatureConfig | None = None) -> DataFrame:
    """``city, timestamp``, the measures looked back on, and their lag, rolling and difference columns.

    ``rows`` is a stream of observations with physics.  Rows of a station that fall
    into one span of ``every_hours`` come out together, once the watermark, the
    greatest time seen less ``delay``, has passed its end; rows older than the
    watermark are too late and dropped.  Rows without a station or time are left
    out.  The query needs ``use_state_store`` and output mode append.
    """
    derivation = Derivation(config or FeatureConfig())
    rows = rows.where("city is not null and timestamp is not null")
    measures = [(F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in MEASURES]
    timed = rows.select("city", "timestamp", F.unix_micros("timestamp").alias("at"), *measures).withWatermark("timestamp", delay)
    doubles = [StructField(c, DoubleType()) for c in (*MEASURES, *derivation.names)]
    schema = StructType([StructField("city", rows.schema["city"].dataType), StructField("at", LongType()), *doubles])
    derived = timed.groupBy("city").transformWithStateInPandas(
        LiveFeatures(derivation, every_hours), schema, outputMode="append", timeMode="EventTime"
    )
    # What pandas calls NaN is null here.
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*MEASURES, *derivation.names)]
    return derived.select("city", F.timestamp_micros("at").alias("timestamp"), *known)
