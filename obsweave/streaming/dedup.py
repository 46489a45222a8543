"""First-wins dedup of a stream: of messages that come again, the first is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from obsweave.operators.keyed import insert_if_absent


def first_wins(rows: DataFrame, keys: Sequence[str], time: str = "received_at", within: str = "1 day") -> DataFrame:
    """Rows whose ``keys`` did not come in the ``within`` before them.

    State holds a key until the watermark is ``within`` past its row and is then
    given up, so memory follows the traffic of that span.
    """
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def start_first_wins(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    time: str = "received_at",
    within: str = "1 day",
    **trigger,
) -> StreamingQuery:
    """Keep the first row of each key in the table at ``path``, by day of ``time``.

    The state drops what comes again soon; the insert drops what a failed batch
    had written before, and a key that comes again on its day after the state
    forgot it.
    """
    names = list(dict.fromkeys([*keys, time]))

    def store(batch: DataFrame, number: int) -> None:
        insert_if_absent(batch, path, keys=names, time=time, part_by=keys[0])

    return (
        first_wins(rows, keys, time, within)
        .writeStream.foreachBatch(store)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 minutes"}))
        .start()
    )
