"""Stored tables: entries partitioned by date, and small tables kept as snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

# What an existing cluster takes over from a new summary; the rest is kept.
CLUSTER_UPDATES = ("count", "last_seen", "source_ids", "sample_ids", "services", "ai_summary")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None if nothing is stored there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def is_complete(spark: SparkSession, path: str) -> bool:
    """Has a write to this folder ended?"""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_once(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a folder unless that has been done; what a broken attempt left is replaced."""
    if not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def new_entries(entries: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Entries whose id is not stored yet, each id once. Only the id column of the store is read."""
    fresh = entries.dropDuplicates(["id"])
    return fresh if stored is None else fresh.join(stored.select("id"), "id", "left_anti")


def append_entries(entries: DataFrame, path: str) -> None:
    """Append the entries whose id is not stored yet, partitioned by date.

    Repeating an append changes nothing. Rows are spread by date and a piece of
    the id, so that a busy day is written by many tasks; within a file they are
    sorted for the usual filters.
    """
    spark = entries.sparkSession
    fresh = new_entries(entries, read_table(spark, path)).withColumn("date", F.to_date("timestamp"))
    spread = fresh.repartition("date", F.substring("id", 1, 1))
    spread.sortWithinPartitions("date", "source_id", "timestamp").write.mode("append").partitionBy("date").parquet(path)


def count_entries(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"))


def split_by_age(entries: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Entries to keep (at or after the cutoff) and entries to remove."""
    old = F.col("timestamp") < F.lit(cutoff).cast("timestamp_ntz")
    return entries.where(~old), entries.where(old)


def purge_before(spark: SparkSession, path: str, cutoff) -> int:
    """Delete stored entries before the cutoff and return how many.

    Whole dates are dropped as folders; only the date of the cutoff is rewritten.
    """
    stored = read_table(spark, path)
    if stored is None:
        return 0
    # The date of the cutoff prunes the folders that are read.
    until = F.to_date(F.lit(cutoff).cast("timestamp_ntz"))
    _, removed = split_by_age(stored.where(F.col("date") <= until), cutoff)
    per_date = removed.groupBy("date").count().collect()  # one row per date
    if not per_date:
        return 0
    cutoff_date = spark.range(1).select(F.lit(cutoff).cast("timestamp_ntz").cast("date")).first()[0]
    boundary = stored.where(F.col("date") == F.lit(cutoff_date))
    kept, _ = split_by_age(boundary, cutoff)
    rewrite = any(r["date"] == cutoff_date for r in per_date) and not kept.isEmpty()
    if rewrite:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    jvm = spark.sparkContext._jvm
    for row in per_date:
        if row["date"] < cutoff_date or (row["date"] == cutoff_date and not rewrite):
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/date={row['date'].isoformat()}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["count"] for r in per_date)


def merge_rows(stored: DataFrame | None, new: DataFrame, key: str, updates: tuple[str, ...] | None = None) -> DataFrame:
    """Stored rows with the new ones merged in by ``key``.

    ``updates`` names the columns an existing row takes from the new one; None
    replaces the whole row.
    """
    if stored is None:
        return new
    columns = new.columns
    updates = tuple(c for c in columns if c != key) if updates is None else updates

    def merged(column: str) -> Column:
        if column == key:
            return F.coalesce(F.col(f"s.{key}"), F.col(f"n.{key}"))
        first, second = ("n", "s") if column in updates else ("s", "n")
        present = F.col(f"{first}.{key}").isNotNull()
        return F.when(present, F.col(f"{first}.{column}")).otherwise(F.col(f"{second}.{column}"))

    both = stored.alias("s").join(new.alias("n"), F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*[merged(c).alias(c) for c in columns])


def merge_clusters(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Insert clusters, or on the same fingerprint take over counts, samples and last seen."""
    return merge_rows(stored, new, "fingerprint", CLUSTER_UPDATES)


def merge_explanations(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Insert explanations, or replace those with the same id."""
    return merge_rows(stored, new.dropDuplicates(["id"]), "id")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(m.group(1)) for m in (re.fullmatch(r"v(\d{10})", n) for n in names) if m]
    done = lambda v: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v:010d}/_SUCCESS"))
    return sorted(v for v in found if done(v))


def snapshot_version(spark: SparkSession, path: str) -> int:
    """Number of the latest complete version, 0 if there is none."""
    versions = _versions(spark, path)
    return versions[-1] if versions else 0


def read_snapshot(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame | None:
    """Latest complete version of a snapshot table, optionally none after ``up_to``."""
    versions = [v for v in _versions(spark, path) if up_to is None or v <= up_to]
    return spark.read.parquet(f"{path}/v{versions[-1]:010d}") if versions else None


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> None:
    """Write the next version. Readers of the previous version are not disturbed."""
    following = version or snapshot_version(df.sparkSession, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{following:010d}")


def upsert_clusters(clusters: DataFrame, path: str) -> None:
    write_snapshot(merge_clusters(read_snapshot(clusters.sparkSession, path), clusters), path)


def store_explanations(explanations: DataFrame, path: str) -> None:
    write_snapshot(merge_explanations(read_snapshot(explanations.sparkSession, path), explanations), path)
