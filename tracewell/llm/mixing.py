"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.llm.texts import WORDS, count_matches, packed
from tracewell.session import cut_lineage, drop_stage

LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS


def document_hash(doc_id: Column, size: Column) -> Column:
    """48 bits that follow from id and size alone, so reruns and other engines agree."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` of every source.

    Weights go to sources in code point order (null last), repeating. Targets are the
    shares of ``share`` times all sizes; a target above ``most`` times its source's size
    stops there and the excess goes to the others by weight. The stopped sources are
    those with the smallest size for their weight, so their number follows from one
    ordered pass over the sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("w", weight).withColumn("room", F.col("source_size") * F.lit(float(most)))
    # Water level: sources in order of room / weight; each is full if the level passes it.
    fill = W.orderBy((F.col("room") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    above = fill.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("room").over(above), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(above), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("room"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("w"), F.col("level")))).over(whole)["level"]
    return levels.withColumn("final", final).select(
        "source", "source_size",
        F.when(F.col("full") | F.col("final").isNull(), F.col("room")).otherwise(F.col("final") * F.col("w")).alias("target"),
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, budget_no, threshold``: documents with a smaller hash meet the budget best.

    ``sizes`` has ``source, hash, size``, ``budgets`` has ``source, budget_no, budget``
    with budgets of at most the source's size. The bucket in which a budget ends is found
    in a histogram of the first hash bits; only its documents are refined by the next
    bits, until the bucket holds one hash. That last one is in if this comes nearer to the
    budget. A larger budget has a larger threshold, so smaller mixes are part of larger ones.
    """
    state = budgets.withColumns({"prefix": F.lit(None).cast("long"), "taken": F.lit(0).cast("long")})
    made = []
    for level in range(LEVELS):
        if level == 0:
            rows = sizes
        else:
            edge = state.select("source", "prefix").distinct()
            up = F.shiftright(F.col("s.hash"), HASH_BITS - LEVEL_BITS * level)
            rows = sizes.alias("s").join(
                edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (up == F.col("e.prefix"))
            ).select("s.source", "s.hash", "s.size", "e.prefix")
        # Budgets may end in different buckets of a source, so sums start anew in each.
        sums = rows.groupBy(
            "source", *(["prefix"] if level else []),
            F.shiftright(F.col("hash"), HASH_BITS - LEVEL_BITS * (level + 1)).alias("bucket"),
        ).agg(F.sum("size").alias("size"))
        keys = ["source", "prefix"] if level else ["source"]
        before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
        same = F.col("b.source").eqNullSafe(F.col("h.source"))
        if level:
            same = same & (F.col("b.prefix") == F.col("h.prefix"))
        left = F.col("b.budget") - F.col("b.taken")
        inside = (F.col("h.before") <= left) & (F.col("h.before") + F.col("h.size") > left)
        found = state.alias("b").join(sums.alias("h"), same & inside, "left").select(
            "b.source", "b.budget_no", "b.budget", F.col("h.bucket").alias("prefix"),
            (F.col("b.taken") + F.coalesce(F.col("h.before"), F.lit(0).cast("long"))).alias("taken"),
            F.col("h.size").alias("inside"),
        )
        state = cut_lineage(found)
        made.append(state)
    nearer = F.col("taken") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("taken")
    # No bucket passes the budget: everything is in.
    result = cut_lineage(state.select(
        "source", "budget_no",
        F.when(F.col("prefix").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix") + nearer.cast("long"))
        .cast("long").alias("threshold"),
    ))
    drop_stage(*made)
    return result


def mix_plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: ``_source, source_size, target, _rounds, _threshold``."""
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("rounds", rounds).select(
        "source", "rounds", F.lit(0).alias("budget_no"), (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget")
    )
    ends = thresholds(sizes, budgets.select("source", "budget_no", "budget"))
    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    return cut_lineage(
        targets.alias("t").join(budgets.alias("b"), same("t", "b")).join(ends.alias("e"), same("t", "e")).select(
            F.col("t.source").alias("_source"), "t.source_size", "t.target", F.col("b.rounds").alias("_rounds"),
            F.col("e.threshold").alias("_threshold"))
    )


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``source, _hash, _size``.

    A document is taken as often as whole rounds of its source fit the target, and once
    more if its hash lies below the threshold of the rest.
    """
    extra = (F.col("_hash") < F.col("_threshold")).cast("long")
    copies = F.when(F.col("_size") > 0, F.col("_rounds") + extra).otherwise(F.lit(0)).cast("long")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies).drop(
        "_source", "_rounds", "_threshold")


def _measured(docs: DataFrame, *names: str) -> DataFrame:
    rows = docs.select(*names, count_matches(F.col("text"), WORDS).alias("_size"))
    return rows.withColumn("_hash", document_hash(F.col("doc_id"), F.col("_size")))


def _sizes(measured: DataFrame) -> DataFrame:
    return measured.select("source", F.col("_hash").alias("hash"), F.col("_size").alias("size"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs``.

    A null text has size 0 and a text without words is never taken; a null source is a
    source of its own, weighted last. Rows with the same id and size share a hash and
    are taken alike. An empty table gives no rows. Columns other than ``doc_id, text,
    source`` are not read.
    """
    rows = cut_lineage(_measured(docs, "doc_id", "source"))
    return with_copies(rows, mix_plan(_sizes(rows), weights, share, most)).drop("_hash").withColumnRenamed("_size", "size")


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as :func:`mix_sources` takes it.

    Rows without words go, as they add nothing to a source; repeated rows are taken alike. Columns may have any
    names, texts any length; an empty table stays empty.
    """
    sizes = cut_lineage(_sizes(_measured(docs, "doc_id", "source")))
    rows = packed(docs).select(
        "_row", F.col("_row.source").alias("source"), F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    taken = with_copies(_measured(rows, "_row", "doc_id", "source"), mix_plan(sizes, weights, share, most))
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").withColumn("_copy", again).select("_row.*")
