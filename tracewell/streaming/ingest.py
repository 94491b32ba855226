"""Continuous ingestion: assemble, normalise, cluster and store each micro-batch.

Everything a batch needs from earlier batches is kept in small versioned tables,
one version per batch, so that a repeated batch gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.formats import is_continuation
from tracewell.functions.levels import level_of_rank
from tracewell.operators.assemble import merge_stacktraces
from tracewell.operators.clusters import SAMPLES, cluster_summary, top_errors, with_fingerprint
from tracewell.operators.fuzzy import BEFORE_ALL, cluster_templates, distinct_templates
from tracewell.operators.normalize import normalize_lines
from tracewell.operators.search_index import add_to_index
from tracewell.schema import CLUSTERS, LINES
from tracewell.session import cut_lineage
from tracewell.sinks.tables import append_entries, new_entries, read_snapshot, read_table, snapshot_version, write_once, write_snapshot


def combine_clusters(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Stored clusters with the summary of further entries added to them."""
    if stored is None:
        return batch
    both = stored.alias("s").join(batch.alias("b"), "cluster_id", "full_outer")
    s, b = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"b.{c}"))
    none = F.array().cast("array<string>")
    lists = lambda c: F.array_distinct(F.concat(F.coalesce(s(c), none), F.coalesce(b(c), none)))
    rank = F.greatest(s("level_rank"), b("level_rank"))
    return both.select(
        "cluster_id", F.coalesce(s("fingerprint"), b("fingerprint")).alias("fingerprint"),
        F.coalesce(s("template"), b("template")).alias("template"), level_of_rank(rank).alias("level"),
        rank.alias("level_rank"),
        (F.coalesce(s("count"), F.lit(0)) + F.coalesce(b("count"), F.lit(0))).alias("count"),
        F.least(s("first_seen"), b("first_seen")).alias("first_seen"),
        F.coalesce(b("last_seen"), s("last_seen")).alias("last_seen"), lists("source_ids").alias("source_ids"),
        F.slice(lists("sample_ids"), 1, SAMPLES).alias("sample_ids"), lists("services").alias("services"),
        F.coalesce(b("ai_summary"), s("ai_summary")).alias("ai_summary"),
    ).select(*CLUSTERS.names)


def assemble_batch(lines: DataFrame, pending: DataFrame | None, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Complete entries of a batch, and the lines of the entry still open in each file.

    ``pending`` are the open lines of the batch before. The open entry of a file is
    its last head line and everything after it; with ``whole_files`` nothing stays open.
    """
    lines = lines.select(*LINES.names)
    if pending is not None:
        lines = lines.unionByName(pending)
    lines = cut_lineage(lines)
    merged = merge_stacktraces(lines)
    if whole_files:
        return merged, lines.limit(0)
    # One row a file, written so that its size is known: joined by file, all lines of a file would meet in one task.
    numbers = lines.where(~is_continuation(F.col("value"))).groupBy("source_id", "file")
    heads = cut_lineage(numbers.agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_last")))
    complete = merged.join(heads, ["source_id", "file"]).where(F.col("line_no") < F.col("_last")).drop("_first", "_last")
    # A file keeps all its lines while it has no complete entry.
    left = lines.join(heads, ["source_id", "file"], "left")
    still_open = left.where(
        F.col("_last").isNull() | (F.col("_first") == F.col("_last")) | (F.col("line_no") >= F.col("_last"))
    ).select(*LINES.names)
    return complete, still_open


def store_batch(batch: DataFrame, batch_id: int, store: str, feed: bool = False, index_columns: tuple[str, ...] = ()) -> DataFrame:
    """Add new entries to ``store/entries`` and their summary to ``store/clusters``; the new entries.

    Clusters are written first and only once per batch: a repeated batch finds its
    version in place, and entries already stored are skipped. With ``feed`` the new entries are also a
    folder of ``store/feed``, with ``index_columns`` their words one of ``store/index``: both
    are written once for each batch, before its entries are stored, so a repeated batch neither loses nor doubles any.
    """
    spark = batch.sparkSession
    path, version = f"{store}/clusters", batch_id + 1
    entries = cut_lineage(new_entries(batch, read_table(spark, f"{store}/entries")))
    if snapshot_version(spark, path) < version:
        write_snapshot(combine_clusters(read_snapshot(spark, path), cluster_summary(entries)), path, version)
    if feed:
        write_once(entries, f"{store}/feed/batch={batch_id}")
        entries = spark.read.schema(entries.schema).parquet(f"{store}/feed/batch={batch_id}")
    if index_columns:
        add_to_index(entries, f"{store}/index", batch_id, index_columns)
    append_entries(entries, f"{store}/entries")
    return entries


def read_feed(spark: SparkSession, store: str, after: int | None = None) -> DataFrame:
    """The live feed: the entries of each batch with its number, optionally of the batches after one."""
    found = spark.read.parquet(f"{store}/feed")
    return found if after is None else found.where(F.col("batch") > after)


def stream_feed(spark: SparkSession, store: str) -> DataFrame:
    """The live feed as a stream, each entry once."""
    schema = spark.read.parquet(f"{store}/feed").schema
    return spark.readStream.schema(schema).parquet(f"{store}/feed")


def _enriched(complete: DataFrame, batch_id: int, store: str, sources, templates, fuzzy: bool, options: dict) -> DataFrame:
    # Few bytes are much work for the parsers, so the lines are dealt by number.
    dealt = complete.repartition(int(complete.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = normalize_lines(dealt, sources, templates, **options)
    return _with_kept_clusters(entries, batch_id, store) if fuzzy else entries


def _with_kept_clusters(entries: DataFrame, batch_id: int, store: str) -> DataFrame:
    """Fuzzy clusters in which a fingerprint keeps the cluster that it first got.

    ``store/members`` has a version for each batch with ``fingerprint, template, cluster_id,
    leader_template, leader_order`` of all fingerprints so far. Only unknown ones are
    compared, with the leaders; of equally similar leaders that of the oldest batch wins.
    """
    spark, path, version = entries.sparkSession, f"{store}/members", batch_id + 1
    entries = cut_lineage(entries if "fingerprint" in entries.columns else with_fingerprint(entries))
    if snapshot_version(spark, path) < version:
        known = read_snapshot(spark, path, batch_id)
        new, leaders = distinct_templates(entries), None
        if known is not None:
            new = new.join(known.select("fingerprint"), "fingerprint", "left_anti")
            leaders = known.where("fingerprint = cluster_id").select("fingerprint", "template", F.col("leader_order").alias("seq"))
        found = cluster_templates(new, leaders).drop("score").withColumn("leader_order", F.lit(BEFORE_ALL + batch_id))
        if known is not None:
            found = known.unionByName(found.join(known.select("fingerprint"), "fingerprint", "left_anti"))
        write_snapshot(found, path, version)
    members = read_snapshot(spark, path, version).select("fingerprint", "cluster_id", F.col("leader_template").alias("template"))
    return entries.drop("cluster_id", "template").join(members, "fingerprint")


def close_pending(spark: SparkSession, store: str, sources: DataFrame | None = None, templates=(), fuzzy: bool = False,
                  feed: bool = False, index_columns: tuple[str, ...] = (), **options) -> None:
    """Store the entries that are still open, after a stream has stopped for good.

    It counts as one more batch and leaves nothing open, so calling it again does nothing. A stream
    that goes on from its checkpoint must not be closed.
    """
    version = snapshot_version(spark, f"{store}/pending")
    pending = read_snapshot(spark, f"{store}/pending")
    if pending is None or pending.isEmpty():
        return
    complete = merge_stacktraces(cut_lineage(pending))
    store_batch(_enriched(complete, version, store, sources, templates, fuzzy, options), version, store, feed, index_columns)
    write_snapshot(pending.limit(0), f"{store}/pending", version + 1)


def ingest(
    lines: DataFrame, store: str, checkpoint: str, sources: DataFrame | None = None, templates=(), fuzzy: bool = False,
    whole_files: bool = False, on_batch: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None,
    feed: bool = False, on_entries: Callable[[DataFrame, int], None] | None = None, index_columns: tuple[str, ...] = (), **options,
) -> StreamingQuery:
    """Start a query that turns a stream of lines into stored entries and clusters.

    ``whole_files`` says that no file goes on in a later batch, as with rolled files, so its
    last entry is stored with its batch; otherwise it waits for the next head line of the
    file, or for :func:`close_pending` when the stream has stopped for good.
    ``fuzzy`` lets new templates join the most similar existing cluster.
    ``on_batch(top, batch_id)`` receives the five largest error clusters after each
    batch, ``on_entries(entries, batch_id)`` its new entries, newest first. With ``feed`` these are also kept by batch
    (:func:`read_feed`, :func:`stream_feed`); ``index_columns`` are those whose words are added to the full-text index
    of the store. ``trigger`` are arguments of ``DataStreamWriter.trigger``.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pending = read_snapshot(spark, f"{store}/pending", batch_id)
        complete, still_open = assemble_batch(batch, pending, whole_files)
        write_snapshot(still_open, f"{store}/pending", batch_id + 1)
        entries = store_batch(_enriched(complete, batch_id, store, sources, templates, fuzzy, options), batch_id, store, feed or on_entries is not None, index_columns)
        if on_entries is not None:
            on_entries(entries.orderBy(F.col("timestamp").desc(), "id"), batch_id)
        if on_batch is not None:
            on_batch(top_errors(read_snapshot(spark, f"{store}/clusters"), 5), batch_id)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "10 seconds"})
    ).start()

