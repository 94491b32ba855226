"""Streaming counterparts of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.levels import at_least
from tracewell.functions.times import from_micros, micros
from tracewell.operators.spikes import ALPHA, FACTOR, NEVER, SECOND, WINDOW_SECS
from tracewell.session import configure
from tracewell.streaming.assemble import assemble_stream

# Lines of a chunk of a stream: a task holds one chunk at a time, and each costs a call of Python.
STREAM_CHUNK = 1 << 17


def timeline_stream(entries: DataFrame, bucket_minutes: int = 5, watermark: str = "10 minutes") -> DataFrame:
    """Counts per bucket and level. In append mode a bucket comes out once the watermark passed it."""
    configure(entries.sparkSession)
    # Watermarks need an instant; under the UTC setting the cast keeps the value.
    timed = entries.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    counted = timed.groupBy(F.window("timestamp", f"{bucket_minutes} minutes"), "level").agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "level", "count")


def merge_stacktraces_stream(lines: DataFrame, flush_after_ms: int | None = 10_000, whole_files: bool = False) -> DataFrame:
    """Head lines with their traces from a stream of ``source_id, file, line_no, value``.

    A head line is held until the next head of its file arrives, or until nothing
    arrived for ``flush_after_ms``. None never flushes, which an ``availableNow``
    trigger needs in order to end. ``whole_files`` says that no file goes on in a later
    micro-batch, so the last entry of a file comes with its lines. Lines are dealt by chunks of a
    file, as :func:`tracewell.streaming.assemble.assemble_stream` does, so no task holds all lines of a file.
    """
    return assemble_stream(lines, flush_after_ms, whole_files, STREAM_CHUNK)


def detect_spikes_stream(entries: DataFrame, key: str | None = None, window_secs: int = WINDOW_SECS, alpha: float = ALPHA,
                         factor: float = FACTOR, unknown_is_error: bool = True) -> DataFrame:
    """Error spikes of a stream, one detector per key.

    The state per key is the error counts of the last window by instant, the
    running average and the last sampled time. Late entries count on arrival.
    """
    configure(entries.sparkSession)
    errors = entries.where(at_least(F.col("level"), "error", unknown_is_error)).select(
        (F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key"),
        micros(F.col("timestamp")).alias("us"), "seq", "service",
    )
    schema = "key string, us long, rate double, baseline double, factor double, service string"
    state_schema = "times array<long>, counts array<long>, average double, last long"
    length = window_secs * SECOND

    def detect(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, counts, average, last = state.get if state.exists else ([], [], 0.0, NEVER)
        # Batches number their rows from 0 each; a row is looked up by its number below.
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "seq"])
        points = rows.groupby("us", sort=True, as_index=False).agg(n=("seq", "size"), at=("seq", "idxmin"))
        known = len(times)
        all_times = np.append(np.asarray(times, dtype=np.int64), points["us"].to_numpy())
        all_counts = np.append(np.asarray(counts, dtype=np.int64), points["n"].to_numpy())
        total = np.append(0, np.cumsum(all_counts))
        services, out = rows["service"].to_dict(), []
        for i, at in enumerate(points["at"].to_numpy(), start=known):
            now = int(all_times[i])
            if now - last < SECOND:
                continue
            begin = int(np.searchsorted(all_times[: i + 1], now - length))
            rate = float(total[i] - total[begin] + 1)
            average = rate if average == 0.0 else alpha * rate + (1.0 - alpha) * average
            last = now
            if average > 1.0 and rate >= factor * average:
                out.append((group[0], now, rate, average, rate / average, services[at]))
        begin = int(np.searchsorted(all_times, all_times[-1] - length))
        state.update((all_times[begin:].tolist(), all_counts[begin:].tolist(), float(average), int(last)))
        yield pd.DataFrame(out, columns=["key", "us", "rate", "baseline", "factor", "service"])

    found = errors.groupBy("key").applyInPandasWithState(detect, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
    return found.select("key", from_micros(F.col("us")).alias("detected_at"), "rate", "baseline", "factor", "service")
