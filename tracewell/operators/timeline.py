"""Counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.operators.queries import filter_entries

BUCKET_MINUTES = 5
RANGES_HOURS = (1, 6, 24, 72)
PIVOT_LEVELS = ("error", "warn", "info")


def timeline_levels(entries: DataFrame, from_time=None, to_time=None, bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Entries per epoch-aligned bucket and level; the bounds are inclusive."""
    chosen = filter_entries(entries, from_time=from_time, to_time=to_time)
    bucket = F.window("timestamp", f"{bucket_minutes} minutes")
    return (
        chosen.groupBy(bucket, "level").agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("bucket"), "level", "count")
    )


def timeline(entries: DataFrame, from_time=None, to_time=None, bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """One row per bucket with the total and a map of counts per level."""
    cells = timeline_levels(entries, from_time, to_time, bucket_minutes)
    return cells.groupBy("bucket").agg(
        F.sum("count").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "count")))).alias("by_level"),
    ).orderBy("bucket")


def timeline_pivot(entries: DataFrame, from_time=None, to_time=None, bucket_minutes: int = BUCKET_MINUTES,
                   levels=PIVOT_LEVELS) -> DataFrame:
    """One row per bucket with one column per level (0 where missing) and the total."""
    chosen = filter_entries(entries, from_time=from_time, to_time=to_time)
    bucket = F.window("timestamp", f"{bucket_minutes} minutes")
    counts = [F.count(F.when(F.col("level") == name, 1)).alias(name) for name in levels]
    return (
        chosen.groupBy(bucket).agg(*counts, F.count("*").alias("total"))
        .select(F.col("window.start").alias("bucket"), *levels, "total")
        .orderBy("bucket")
    )


def last_hours(hours: int, end) -> tuple:
    """Bounds of one of the preset ranges, counted back from ``end``."""
    from datetime import datetime, timedelta

    end = datetime.fromisoformat(end) if isinstance(end, str) else end
    return end - timedelta(hours=hours), end
