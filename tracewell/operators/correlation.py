"""Services whose entries occur close together in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions.levels import ERROR_RANK, level_rank
from tracewell.functions.times import seconds

MIN_SCORE = 0.3


def service_correlation(entries: DataFrame, window_secs: int, errors_only: bool = False,
                        min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs of services with their co-occurrence score.

    The score is the number of entries of ``service_a`` that have an entry of
    ``service_b`` within ``window_secs`` whole seconds, divided by the smaller
    number of entries; it can exceed 1. Pairs above ``min_score`` are kept.

    No pair of entries is ever formed. Entries are reduced to counts per service
    and second, and the seconds near any entry of a service are described by one
    row per service and time cell of the window's width: inside an occupied cell
    every second is near, next to it a leading or trailing part of the cell is.
    The join therefore handles at most one row per service and cell on one side.
    """
    chosen = entries.where(F.col("service").isNotNull())
    if errors_only:
        chosen = chosen.where(level_rank(F.col("level")) >= ERROR_RANK)
    width = max(window_secs, 1)
    per_second = (
        chosen.groupBy("service", seconds(F.col("timestamp")).alias("sec")).agg(F.count("*").alias("n"))
        .withColumn("cell", F.expr(f"cast(floor(sec / {width}) as bigint)"))
    )
    per_cell = per_second.groupBy("service", "cell").agg(
        F.sum("n").alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last")
    )
    totals = per_cell.groupBy("service").agg(F.sum("n").alias("total"))

    reach = F.array(
        F.struct(F.col("cell").alias("cell"), F.lit(1).alias("full"), F.lit(None).cast("long").alias("until"),
                 F.lit(None).cast("long").alias("since")),
        F.struct((F.col("cell") + 1).alias("cell"), F.lit(0).alias("full"),
                 (F.col("last") + window_secs).alias("until"), F.lit(None).cast("long").alias("since")),
        F.struct((F.col("cell") - 1).alias("cell"), F.lit(0).alias("full"), F.lit(None).cast("long").alias("until"),
                 (F.col("first") - window_secs).alias("since")),
    )
    near = (
        per_cell.select(F.col("service").alias("service_b"), F.inline(reach))
        .groupBy("service_b", "cell")
        .agg(F.max("full").alias("full"), F.max("until").alias("until"), F.min("since").alias("since"))
    )
    ordered = F.col("service_a") < F.col("service_b")
    inside = (
        per_cell.select(F.col("service").alias("service_a"), "cell", "n")
        .join(near.where("full = 1"), "cell").where(ordered)
        .select("service_a", "service_b", "n")
    )
    beside = (
        per_second.select(F.col("service").alias("service_a"), "cell", "sec", "n")
        .join(near.where("full = 0"), "cell")
        .where(ordered & (F.coalesce(F.col("sec") <= F.col("until"), F.lit(False))
                          | F.coalesce(F.col("sec") >= F.col("since"), F.lit(False))))
        .select("service_a", "service_b", "n")
    )
    together = inside.unionByName(beside).groupBy("service_a", "service_b").agg(F.sum("n").alias("co_occurring"))
    size_of = lambda name: totals.select(F.col("service").alias(f"service_{name}"), F.col("total").alias(f"total_{name}"))
    score = F.col("co_occurring") / F.least("total_a", "total_b")
    return (
        together.join(size_of("a"), "service_a").join(size_of("b"), "service_b")
        .where(score > min_score)
        .select(
            "service_a", "service_b", score.cast("float").alias("correlation_score"),
            F.concat(F.lit("Errors of "), F.col("service_a"), F.lit(" and "), F.col("service_b"),
                     F.lit(f" lie {window_secs} seconds or less apart")).alias("description"),
        )
        .orderBy(F.col("correlation_score").desc(), "service_a", "service_b")
    )
