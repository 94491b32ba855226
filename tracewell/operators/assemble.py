"""Joining stack-trace lines to the entry they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.functions.formats import is_continuation

CHUNK_LINES = 16_384
CHUNKS_PER_SPAN = 65_536


def _run_targets(lines: DataFrame, keys: list[str], order: str, is_head: Column, chunk: Column) -> DataFrame:
    """Per chunk, the head line that continuation lines at its start belong to.

    That is the last head of any earlier chunk of the file, or the first head of
    the file for lines above it. Two levels keep every window small: chunks
    within a span of 65,536 chunks, then the spans of a file.
    """
    heads = F.when(is_head, F.col(order))
    summary = lines.groupBy(*keys, chunk.alias("_chunk")).agg(F.max(heads).alias("_last"), F.min(heads).alias("_first"))
    summary = summary.withColumn("_span", F.expr(f"_chunk div {CHUNKS_PER_SPAN}"))

    def last_before(by: list[str], position: str) -> Column:
        return F.max("_last").over(W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, -1))

    spans = summary.groupBy(*keys, "_span").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    spans = spans.select(
        *keys, "_span", last_before(keys, "_span").alias("_from_span"),
        F.min("_first").over(W.partitionBy(*keys)).alias("_from_file"),
    )
    summary = summary.withColumn("_from_chunk", last_before([*keys, "_span"], "_chunk")).join(
        spans, [*keys, "_span"], "left"
    )
    return summary.select(*keys, "_chunk", F.coalesce("_from_chunk", "_from_span", "_from_file").alias("_target"))


def merge_stacktraces(
    lines: DataFrame,
    keys: list[str] | None = None,
    order: str = "line_no",
    value: str = "value",
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """One row per head line, with its continuation lines as ``stacktrace``.

    ``lines`` is ordered by ``order`` (a non-negative line number) within
    ``keys``. Other columns are taken from the head line; ``stacktrace`` is null
    where there is none. Files without any head line give nothing.

    A file may hold any share of all lines, so the unit of work is a chunk of line
    numbers: the lines are shuffled once, by chunk, and traces are collected
    there. Only the first and last heads of a chunk and the run of continuation
    lines at its start, three rows per chunk, are shuffled again to be stitched.
    """
    keys = keys or ["source_id", "file"]
    others = [c for c in lines.columns if c not in (*keys, order, value)]
    chunk = F.expr(f"`{order}` div {chunk_lines}")
    targets = _run_targets(lines, keys, order, ~is_continuation(F.col(value)), chunk)

    marked = lines.withColumn("_head", ~is_continuation(F.col(value))).withColumn("_chunk", chunk)
    marked = marked.join(targets, [*keys, "_chunk"])
    in_chunk = W.partitionBy(*keys, "_chunk")
    own_head = F.when(F.col("_head"), F.col(order))
    marked = marked.withColumn(
        "_own", F.max(own_head).over(in_chunk.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    )
    # Still partitioned by chunk, so this adds no shuffle.
    grouped = marked.groupBy(*keys, "_chunk", "_own").agg(
        F.first("_target").alias("_target"),
        F.first(F.when(F.col("_head"), F.struct(value, *others)), ignorenulls=True).alias("_at"),
        F.collect_list(F.when(~F.col("_head"), F.struct(order, value))).alias("_trace"),
    )
    grouped = grouped.withColumn("_owner", F.coalesce("_own", "_target")).withColumn(
        "_stitch",
        F.col("_own").isNull()
        | (F.col("_own") == F.max("_own").over(in_chunk))
        | (F.col("_own") == F.min("_own").over(in_chunk)),
    )
    columns = [*keys, "_owner", "_at", "_trace"]
    within = grouped.where(~F.col("_stitch")).select(*columns)
    across = (
        grouped.where(F.col("_stitch") & F.col("_owner").isNotNull())
        .groupBy(*keys, "_owner")
        .agg(F.first("_at", ignorenulls=True).alias("_at"), F.flatten(F.collect_list("_trace")).alias("_trace"))
    )
    merged = within.unionByName(across.select(*columns))
    trace = F.transform(F.array_sort("_trace"), lambda x: x[value])
    return merged.select(
        *keys, F.col("_owner").alias(order), F.col("_at")[value].alias(value),
        *[F.col("_at")[c].alias(c) for c in others],
        F.when(F.size("_trace") > 0, trace).alias("stacktrace"),
    )
