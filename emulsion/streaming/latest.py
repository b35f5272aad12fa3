"""Structured Streaming forms of the request operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(events: DataFrame, key: str, ts: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """The newest event of each key so far; state is one row for each key."""
    return events.withWatermark(ts, late).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts)).alias("latest"))


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of a key: a session ends after the quiet time."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet)).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))


def counter_totals(events: DataFrame, ts: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    return events.where("kind = 'counter'").withWatermark(ts, late).groupBy(F.window(ts, window), "name").agg(F.sum("value").alias("total"))
