"""Counts over a stream of events, and the round loop's reduction kept up to date as rows arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.iterate import fold_by


def window_counts(events: DataFrame, time: str, width: str, keys: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """(window_start, keys, n) of fixed windows; with `late`, rows that much behind the newest are left out and old windows are forgotten."""
    events = events.withWatermark(time, late) if late else events
    return events.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def running_folds(rows: DataFrame, keys: Sequence[str], folds: Mapping[str, str]) -> DataFrame:
    """The folds of iterate.py over all rows so far, of a stream or a table."""
    return fold_by(rows, keys, dict(folds))


def drained(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """A stream's result over what is there now, as a table in memory: for tests and small results."""
    query: StreamingQuery = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
