"""Error rates and error spikes.

The detector is a sequential rule: the rate is the number of errors of the last
60 seconds, it is sampled at most once per second, a running average follows the
samples, and a sample far above the average is a spike. Here it runs in parallel:

1. Errors are reduced to one row per key and distinct time. That bounds every
   later unit of work by the clock's resolution, whatever the number of rows.
2. ``steps``: which error is sampled next depends only on the last sampled time.
   For each minute, the last sample of the minute is a step function of the last
   sample before it; each minute computes its own, independently.
3. ``entry``: the step functions are applied in order, one small row set per key.
4. ``ticks``: with its entry state known, each minute lists its samples.
5. The average is linear in its start value, so days are folded independently,
   chained over the days, and replayed with the right start value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.functions.levels import at_least
from tracewell.functions.times import from_micros, micros
from tracewell.session import configure

WINDOW_SECS = 60
ALPHA = 0.3
FACTOR = 3.0
SECOND = 1_000_000
DAY = 86_400 * SECOND
NEVER = -(2**62)
SEQ_RUN = 65_536


def _errors(entries: DataFrame, key: str | None, unknown_is_error: bool) -> DataFrame:
    configure(entries.sparkSession)
    return entries.where(at_least(F.col("level"), "error", unknown_is_error)).select(
        (F.lit("") if key is None else F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key"),
        micros(F.col("timestamp")).alias("us"), "seq", "service", "id",
    )


def _block(us: Column, window_secs: int) -> Column:
    return F.floor(us / F.lit(window_secs * SECOND)).cast("long")  # exact: doubles hold microseconds beyond the year 2200


def _with_earlier(points: DataFrame, window_secs: int) -> DataFrame:
    """Add ``earlier``: errors of the window before each distinct time.

    Blocks are as long as the window, so a block needs itself and the one before:
    every error of the previous block is counted in at the start and out again
    when it leaves the window.
    """
    length = window_secs * SECOND
    points = points.withColumn("block", _block(F.col("us"), window_secs))
    nothing = F.lit(None).cast("string")
    steps = F.array(
        F.struct(F.col("block").alias("block"), F.col("us").alias("us"), F.col("n").alias("delta"),
                 F.col("n").alias("n"), F.col("first_service").alias("first_service")),
        F.struct((F.col("block") + 1).alias("block"), F.lit(NEVER).alias("us"), F.col("n").alias("delta"),
                 F.lit(0).cast("long").alias("n"), nothing.alias("first_service")),
        F.struct((F.col("block") + 1).alias("block"), (F.col("us") + length + 1).alias("us"),
                 (-F.col("n")).alias("delta"), F.lit(0).cast("long").alias("n"), nothing.alias("first_service")),
    )
    moves = points.select("key", F.inline(steps))
    so_far = W.partitionBy("key", "block").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    return (
        moves.withColumn("earlier", F.sum("delta").over(so_far) - F.col("n"))
        .where(F.col("n") > 0)
        .select("key", "block", "us", "n", "first_service", "earlier")
    )


def _points(errors: DataFrame) -> DataFrame:
    return errors.groupBy("key", "us").agg(
        F.count("*").alias("n"), F.min_by("service", F.struct("seq", "id")).alias("first_service")
    )


def error_rate(entries: DataFrame, key: str | None = None, window_secs: int = WINDOW_SECS,
               unknown_is_error: bool = True) -> DataFrame:
    """Per error entry, the number of errors of its key in the last 60 seconds.

    The entry itself counts; entries of the same instant that arrived later do not.
    """
    errors = _errors(entries, key, unknown_is_error)
    earlier = _with_earlier(_points(errors), window_secs).select("key", "us", "earlier")
    # Rank among entries of one instant: counts of earlier runs of arrival numbers
    # plus the rank within the run, so that no window grows with a crowded instant.
    run = F.expr(f"seq div {SEQ_RUN}").alias("run")
    ranked = errors.withColumn("run", run)
    runs = ranked.groupBy("key", "us", "run").agg(F.count("*").alias("n"))
    before = W.partitionBy("key", "us").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("key", "us", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_run = W.partitionBy("key", "us", "run").orderBy("seq", "id")
    ranked = ranked.withColumn("rank", F.row_number().over(in_run)).join(runs, ["key", "us", "run"])
    return ranked.join(earlier, ["key", "us"]).select(
        "id", "seq", "key", from_micros(F.col("us")).alias("timestamp"), "service",
        (F.col("earlier") + F.col("before") + F.col("rank")).alias("rate"),
    )


def _by_block(df: DataFrame, block: str, function, schema: str) -> DataFrame:
    """Apply ``function`` to runs of whole ``(key, block)`` groups, sorted by ``us``.

    Many small groups are handed over together, a large one is collected from its
    batches; no more than one large group is held at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = (batch["key"] == batch["key"].iloc[-1]) & (batch[block] == batch[block].iloc[-1])
            if held and last.all() and (held[-1]["key"].iloc[-1], held[-1][block].iloc[-1]) == (
                batch["key"].iloc[-1], batch[block].iloc[-1]
            ):
                held.append(batch)
                continue
            complete = pd.concat([*held, batch[~last]])
            if len(complete):
                yield function(complete)
            held = [batch[last]]
        if held:
            yield function(pd.concat(held))

    placed = df.repartition("key", block).sortWithinPartitions("key", block, "us")
    return placed.mapInPandas(run, schema)


def _groups(pdf: pd.DataFrame, block: str) -> Iterator[tuple[int, int]]:
    """Bounds of the ``(key, block)`` groups of sorted rows."""
    keys, blocks = pdf["key"].to_numpy(), pdf[block].to_numpy()
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])))
    return zip(starts, np.append(starts[1:], len(pdf)))


def _steps(window_us: int):
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        """Last sample of each block as a step function of the first sampled time in it."""
        keys, blocks, all_times = pdf["key"].to_numpy(), pdf["block"].to_numpy(), pdf["us"].to_numpy()
        out = []
        for a, b in _groups(pdf, "block"):
            times, size = all_times[a:b], b - a
            follow = np.searchsorted(times, times + SECOND)
            last = np.where(follow < size, follow, np.arange(size))
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            first_second = np.searchsorted(times, blocks[a] * window_us + SECOND)
            reachable = min(int(first_second), size - 1) + 1
            leaves = times[last[:reachable]]
            ends = np.append(np.flatnonzero(leaves[1:] != leaves[:-1]), reachable - 1)
            out.extend((keys[a], blocks[a], times[e], leaves[e]) for e in ends)
        return pd.DataFrame(out, columns=["key", "block", "up_to", "leaves"])
    return steps


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Apply the step functions of one key in time order."""
    pdf = pdf.sort_values(["block", "up_to"])
    blocks, up_to, leaves = (pdf[c].to_numpy() for c in ("block", "up_to", "leaves"))
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    stops = np.append(starts[1:], len(blocks))
    states, state = np.empty(len(starts), dtype=np.int64), NEVER
    for i, (a, b) in enumerate(zip(starts, stops)):
        states[i] = state
        at = a + int(np.searchsorted(up_to[a:b], state + SECOND))
        if at < b:
            state = leaves[at]
    return pd.DataFrame({"key": pdf["key"].iloc[0], "block": blocks[starts], "state": states})


def _ticks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Samples of each block; its first row carries the last sample before it."""
    states, all_times = pdf["state"].to_numpy(), pdf["us"].to_numpy()
    chosen = []
    for a, b in _groups(pdf, "block"):
        times = all_times[a + 1 : b]
        at = int(np.searchsorted(times, int(states[a]) + SECOND))
        while at < len(times):
            chosen.append(a + 1 + at)
            at = int(np.searchsorted(times, times[at] + SECOND))
    picked = pdf.iloc[chosen]
    return pd.DataFrame({
        "key": picked["key"], "us": picked["us"], "rate": picked["earlier"].astype("float64") + 1.0,
        "service": picked["first_service"],
    })


def _carry(alpha: float):
    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """Average at the start of each day of one key."""
        pdf = pdf.sort_values("day")
        average, out = float(pdf["first_rate"].iloc[0]), []
        for n, tail in zip(pdf["n"], pdf["tail"]):
            out.append(average)
            average = tail + (1.0 - alpha) ** n * average
        return pd.DataFrame({"key": pdf["key"], "day": pdf["day"], "average": out})
    return carry


def _replay(alpha: float, factor: float):
    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        """Spikes of each day; its first row carries the average at its start."""
        keys, times, rates = pdf["key"].to_numpy(), pdf["us"].to_numpy(), pdf["rate"].to_numpy()
        services, averages = pdf["service"].to_numpy(), pdf["average"].to_numpy()
        spikes = []
        for a, b in _groups(pdf, "day"):
            average = averages[a]
            for i in range(a + 1, b):
                average = alpha * rates[i] + (1.0 - alpha) * average
                if average > 1.0 and rates[i] >= factor * average:
                    spikes.append((keys[i], times[i], rates[i], average, rates[i] / average, services[i]))
        return pd.DataFrame(spikes, columns=["key", "us", "rate", "baseline", "factor", "service"])
    return replay


def sample_ticks(entries: DataFrame, key: str | None = None, window_secs: int = WINDOW_SECS,
                 unknown_is_error: bool = True) -> DataFrame:
    """Sampled error rates: at most one per second and key, the first error included."""
    points = _with_earlier(_points(_errors(entries, key, unknown_is_error)), window_secs)
    steps = _by_block(points.select("key", "block", "us"), "block", _steps(window_secs * SECOND),
                      "key string, block long, up_to long, leaves long")
    states = steps.groupBy("key").applyInPandas(_entries, "key string, block long, state long")
    both = points.select("key", "block", "us", "earlier", "first_service").unionByName(
        states.withColumn("us", F.lit(NEVER)), allowMissingColumns=True
    )
    return _by_block(both, "block", _ticks, "key string, us long, rate double, service string")


def detect_spikes(entries: DataFrame, key: str | None = None, window_secs: int = WINDOW_SECS, alpha: float = ALPHA,
                  factor: float = FACTOR, unknown_is_error: bool = True) -> DataFrame:
    """Error spikes, one detector per ``key`` (one for everything by default)."""
    ticks = sample_ticks(entries, key, window_secs, unknown_is_error)
    ticks = ticks.withColumn("day", F.floor(F.col("us") / F.lit(DAY)).cast("long"))
    in_order = F.array_sort(F.collect_list(F.struct("us", "rate")))
    days = ticks.groupBy("key", "day").agg(in_order.alias("ticks")).select(
        "key", "day", F.size("ticks").alias("n"), F.col("ticks")[0]["rate"].alias("first_rate"),
        F.aggregate("ticks", F.lit(0.0), lambda a, t: F.lit(alpha) * t["rate"] + F.lit(1.0 - alpha) * a).alias("tail"),
    )
    starts = days.groupBy("key").applyInPandas(_carry(alpha), "key string, day long, average double")
    both = ticks.unionByName(starts.withColumn("us", F.lit(NEVER)), allowMissingColumns=True)
    spikes = _by_block(both, "day", _replay(alpha, factor),
                       "key string, us long, rate double, baseline double, factor double, service string")
    return spikes.select("key", from_micros(F.col("us")).alias("detected_at"), "rate", "baseline", "factor", "service")
