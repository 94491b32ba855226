"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.session import cut_lineage, drop_stage


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge; a component is named by its smallest node.

    ``edges`` has two columns of longs ``a, b``, in any direction and with repeats. Each
    round replaces edges by edges to the smallest neighbour, first for larger and then
    for smaller neighbours (Kiveris et al.: "Connected Components in MapReduce and
    Beyond", SoCC 2014), so a node of any degree is handled by partial minima and a
    join, never by one group. No edges give no rows.
    """
    last = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(last)
    while mark[0]:
        both = last.unionByName(last.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours of a node are tied to its smallest neighbour.
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rest = small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        found = cut_lineage(rest)
        drop_stage(last)
        last, before = found, mark
        mark = _mark(last)
        if mark == before:
            break
    roots = last.select(F.col("b").alias("node")).distinct().join(last.select(F.col("a").alias("node")), "node", "left_anti")
    return last.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
