"""Clusters of entries with the same, or nearly the same, message template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.functions.fingerprint import fingerprint_of_template, template
from tracewell.functions.levels import ERROR_RANK, level_label, level_of_rank, level_rank
from tracewell.functions.times import from_micros, micros
from tracewell.schema import CLUSTERS
from tracewell.session import configure

SAMPLES = 5
DEFAULT_LIST = 50
TOP_ERRORS = 10


def with_fingerprint(entries: DataFrame, message: str = "message") -> DataFrame:
    """Add ``template`` and ``fingerprint`` of the message."""
    return entries.withColumn("template", template(F.col(message))).withColumn(
        "fingerprint", fingerprint_of_template(F.col("template"))
    )


def cluster_exact(entries: DataFrame) -> DataFrame:
    """Entries with ``cluster_id`` set to their own fingerprint."""
    have = entries if "fingerprint" in entries.columns else with_fingerprint(entries)
    return have.withColumn("cluster_id", F.col("fingerprint"))


def first_per_cluster(entries: DataFrame, k: int, order, key: str = "cluster_id") -> DataFrame:
    """First ``k`` rows of each group; Spark cuts groups to ``k`` before the shuffle."""
    ranked = entries.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k)


def _last_arrival(seq: Column, timestamp: Column) -> Column:
    """Arrival number and time as one number, so that its maximum is the last arrival.

    A fixed-width number keeps the aggregation below hash based; a struct would
    make Spark sort all entries first.
    """
    scale = F.lit(10**18).cast("decimal(19,0)")
    return seq.cast("decimal(20,0)") * scale + (micros(timestamp) + F.lit(10**17)).cast("decimal(20,0)")


def _time_of_arrival(packed: Column) -> Column:
    return from_micros((packed % F.lit(10**18).cast("decimal(19,0)")).cast("long") - F.lit(10**17))


def cluster_summary(entries: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per ``cluster_id`` with counts, times, sources, services and samples.

    "First" and "last" mean arrival order (``seq``). Entries are first reduced to
    one row per cluster, source and service on the map side, so a cluster holding
    most entries costs no more to shuffle than a small one.
    """
    configure(entries.sparkSession)
    rank = F.col("level_rank") if "level_rank" in entries.columns else level_rank(F.col("level"))
    # The template depends on the cluster alone; as a key it needs no buffer.
    parts = entries.groupBy("cluster_id", "template", "source_id", "service").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.min("seq").alias("first"),
        F.max(_last_arrival(F.col("seq"), F.col("timestamp"))).alias("last"), F.max(rank).alias("level_rank"),
    )
    by_arrival = lambda column: F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("first", column))))
    names = lambda pairs, column: F.array_distinct(F.transform(pairs, lambda p: p[column]))
    grouped = parts.groupBy("cluster_id").agg(
        F.sum("n").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last").alias("last"),
        F.max("level_rank").alias("level_rank"), F.min_by("template", "first").alias("template"),
        by_arrival("source_id").alias("_sources"), by_arrival("service").alias("_services"),
    )
    picked = (
        first_per_cluster(entries.select("cluster_id", "seq", "id"), samples, ["seq", "id"])
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda s: s["id"]).alias("sample_ids"))
    )
    return (
        grouped.join(picked, "cluster_id")
        .select(
            "cluster_id", F.col("cluster_id").alias("fingerprint"), "template",
            level_of_rank(F.col("level_rank")).alias("level"), "level_rank", "count", "first_seen",
            _time_of_arrival(F.col("last")).alias("last_seen"), names("_sources", "source_id").alias("source_ids"),
            "sample_ids", names("_services", "service").alias("services"),
            F.lit(None).cast("string").alias("ai_summary"),
        )
        .select(*CLUSTERS.names)
    )


def list_clusters(clusters: DataFrame, limit: int = DEFAULT_LIST) -> DataFrame:
    """Largest clusters first."""
    return clusters.orderBy(F.col("count").desc(), "cluster_id").limit(limit)


def find_cluster(clusters: DataFrame, id_or_prefix: str) -> DataFrame:
    """The cluster with this id, else the largest whose id starts with it."""
    wanted = F.lit(id_or_prefix)
    return (
        clusters.where(F.startswith("cluster_id", wanted))
        .orderBy(F.col("count").desc(), "cluster_id")
        .limit(1)
    )


def clusters_view(clusters: DataFrame, limit: int = 20, template_shown: int = 60, services_shown: int = 3) -> DataFrame:
    """Console view: count, label, first seen, start of the template, first services."""
    top = list_clusters(clusters, limit)
    return top.select(
        "cluster_id", "count", level_label(F.col("level")).alias("level"),
        F.date_format("first_seen", "MM-dd HH:mm:ss").alias("first_seen"),
        F.substring("template", 1, template_shown).alias("template"), F.slice("services", 1, services_shown).alias("services"),
    )


def top_errors(clusters: DataFrame, n: int = TOP_ERRORS) -> DataFrame:
    """Largest clusters at error or above (``unknown`` counts as above)."""
    return list_clusters(clusters.where(F.col("level_rank") >= ERROR_RANK), n)


def cluster_stats(clusters: DataFrame, n: int = TOP_ERRORS) -> DataFrame:
    """One row: number of clusters and entries, entries per level, largest error clusters."""
    levels = clusters.groupBy("level").agg(F.count("*").alias("clusters"), F.sum("count").alias("entries"))
    totals = levels.agg(
        F.coalesce(F.sum("clusters"), F.lit(0)).alias("total_clusters"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "entries")))).alias("by_level"),
    )
    top = top_errors(clusters, n).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "cluster_id"))),
            lambda c: c["cluster_id"],
        ).alias("top_errors")
    )
    # Both sides are single aggregate rows.
    return totals.withColumn("_one", F.lit(1)).join(top.withColumn("_one", F.lit(1)), "_one").drop("_one")


def cluster_samples(entries: DataFrame, clusters: DataFrame | None = None, k: int = SAMPLES) -> DataFrame:
    """Up to ``k`` newest entries per cluster, optionally only for the given clusters."""
    if clusters is not None:
        entries = entries.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return first_per_cluster(entries, k, [F.col("timestamp").desc(), "id"]).withColumnRenamed("_rank", "rank")
