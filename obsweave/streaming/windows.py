"""Event-time windows over a stream of observations: tumbling, sliding and session.

A window's row is final: it is written once, when the watermark (the greatest
time seen, less the delay) has passed the window's end.  Rows older than the
watermark are too late; they change nothing and are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsweave.operators.keyed import insert_if_absent

STATS = {"avg": F.avg, "min": F.min, "max": F.max}


def _windowed(rows: DataFrame, window: Column, value: str, delay: str) -> DataFrame:
    timed = rows.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    return (
        timed.groupBy("city", window.alias("window"))
        .agg(F.count(F.lit(1)).alias("rows"), *[f(value).alias(f"{name}_{value}") for name, f in STATS.items()])
        .select("city", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", *[f"{n}_{value}" for n in STATS])
    )


def tumbling(rows: DataFrame, width: str = "1 hour", delay: str = "2 hours", value: str = "temperature") -> DataFrame:
    """``city, start, end, rows`` and statistics of each ``width``; batches of all rows give the same."""
    return _windowed(rows, F.window("timestamp", width), value, delay)


def sliding(rows: DataFrame, width: str = "6 hours", step: str = "1 hour", delay: str = "2 hours", value: str = "temperature") -> DataFrame:
    """As ``tumbling``, for a window of ``width`` that begins at every ``step``."""
    return _windowed(rows, F.window("timestamp", width, step), value, delay)


def sessions(rows: DataFrame, gap: str = "3 hours", delay: str = "2 hours", value: str = "temperature") -> DataFrame:
    """As ``tumbling``, for runs of rows of a station with less than ``gap`` between; ``end`` is ``gap`` after the last."""
    return _windowed(rows, F.session_window("timestamp", gap), value, delay)


def start_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write final windows to the table at ``path``, by day of their start.

    A batch that is written again after a failure adds nothing, as windows are
    keyed by station and start.  ``late_rows`` of the query tells what came late.
    """

    def store(batch: DataFrame, number: int) -> None:
        # A station's window comes out of its group once.
        insert_if_absent(batch, path, keys=("city", "start"), time="start", unique=True)

    return (
        windows.writeStream.foreachBatch(store)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 minutes"}))
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their watermark, over the progress that the query still holds.

    Of windows a row counts once a window it would have entered, of rows that are
    combined before they meet the state once a combined row.
    """
    return sum(state.get("numRowsDroppedByWatermark", 0) for step in query.recentProgress for state in step["stateOperators"])
