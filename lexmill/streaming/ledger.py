"""The ledger analytics as Structured Streaming: windowed counts with late data, and streaks as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped, so state stays bounded."""
    at = F.col("ts").cast("timestamp")
    e = events.withColumn("ts", at).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def error_streaks(events: DataFrame) -> DataFrame:
    """(user_id, longest_error_streak) after each batch; rows of a user are taken in order of time within a batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, best = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            run = run + 1 if kind == "error" else 0
            best = max(best, run)
        state.update((run, best))
        yield pd.DataFrame({"user_id": [key[0]], "longest_error_streak": [best]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(fold, "user_id long, longest_error_streak long", "run long, best long", "update", GroupStateTimeout.NoTimeout)
