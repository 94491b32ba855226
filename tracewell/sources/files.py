"""Log files, container log files and exported system journals as raw lines.

All readers give ``source_id, source_label, file, line_no, value, ingested_at``.
``line_no`` counts the lines of a file from 0 and does not depend on how Spark
splits the file, so identities derived from it are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracewell.functions.text import is_blank
from tracewell.session import configure

TAIL_LINES = 50
BROADCAST_SPLITS = 500_000
BLANK_POLICIES = ("empty", "blank", "trim_end")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def accept_lines(lines: DataFrame, blank_policy: str = "empty") -> DataFrame:
    """Leave out lines without content.

    ``"empty"`` drops empty lines (files), ``"blank"`` also lines of white space
    (journals), ``"trim_end"`` first strips the end of every line (containers).
    """
    if blank_policy == "trim_end":
        lines = lines.withColumn("value", F.regexp_replace("value", r"(?U)\s+$", ""))
    elif blank_policy == "blank":
        return lines.where(~is_blank(F.col("value")))
    elif blank_policy != "empty":
        raise ValueError(f"blank_policy must be one of {BLANK_POLICIES}")
    return lines.where(F.col("value") != "")


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Add ``line_no``: lines of earlier splits of the file plus the position in the split.

    Rows of one split have consecutive ids, so two counts per split are enough.
    The count pass reads the files once more. There is one row per split; up to
    ``BROADCAST_SPLITS`` of them (some 60 TB in splits of 128 MB) are broadcast, so
    that lines are neither sorted nor shuffled. Beyond that Spark joins by shuffle.
    """
    placed = raw.withColumn("_row", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "_start").agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # A scan partition is cut from one file or packs several whole ones.
    most = raw.rdd.getNumPartitions() + len(raw.inputFiles())
    splits = F.broadcast(splits) if most <= BROADCAST_SPLITS else splits
    return placed.join(splits, ["file", "_start"]).withColumn("line_no", F.col("_row") + F.col("_shift"))


def read_log_files(
    spark: SparkSession,
    paths: str | list[str],
    source_id: str | None = None,
    label: str | None = None,
    blank_policy: str = "empty",
    ingested_at=None,
    pattern: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Lines of the given files. The label defaults to the file name."""
    configure(spark)
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("_changed"),
    )
    lines = numbered_lines(raw).withColumn("value", F.regexp_replace("value", r"\r+$", ""))
    arrived = F.col("_changed") if ingested_at is None else F.lit(ingested_at).cast("timestamp_ntz")
    lines = lines.select(
        (F.col("file") if source_id is None else F.lit(source_id)).alias("source_id"),
        (file_name(F.col("file")) if label is None else F.lit(label)).alias("source_label"),
        "file", "line_no", "value", arrived.alias("ingested_at"),
    )
    return accept_lines(lines, blank_policy)


def read_log_dir(spark: SparkSession, path: str, source_id: str, label: str, pattern: str = "*.log", **options) -> DataFrame:
    """Lines of every matching file below a folder; each file is a source of its own."""
    lines = read_log_files(spark, path, source_id, label, pattern=pattern, recursive=True, **options)
    return lines.withColumn("source_id", F.concat(F.lit(source_id + "/"), F.col("file"))).withColumn(
        "source_label", F.concat(F.lit(label + " ("), file_name(F.col("file")), F.lit(")"))
    )


def tail_lines(lines: DataFrame, n: int = TAIL_LINES, order: str = "line_no") -> DataFrame:
    """The last ``n`` lines of each source; cut to size before the shuffle."""
    newest = W.partitionBy("source_id").orderBy(F.col(order).desc())
    return lines.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def read_container_logs(spark: SparkSession, path: str, container_id: str, name: str | None = None,
                        tail: int | None = None, **options) -> DataFrame:
    """Log files of one container; ``tail`` keeps its last lines only."""
    lines = read_log_files(spark, path, container_id, name or container_id[:12], blank_policy="trim_end", **options)
    return lines if tail is None else tail_lines(lines, tail)


def read_container_service(spark: SparkSession, containers: DataFrame, service_name: str, source_id: str,
                           label: str, **options) -> DataFrame:
    """All containers of one service as one source.

    ``containers`` is configuration with ``service_name, path``; the paths of the
    service are read in one scan.
    """
    paths = [r["path"] for r in containers.where(F.col("service_name") == service_name).select("path").distinct().collect()]
    if not paths:
        raise ValueError(f"no container of service {service_name!r}")
    return read_log_files(spark, paths, source_id, label, blank_policy="trim_end", **options)


def read_system_export(spark: SparkSession, path: str, source_id: str, label: str, **options) -> DataFrame:
    """Exported system journal, one JSON record per line."""
    return read_log_files(spark, path, source_id, label, blank_policy="blank", **options)


def load_sources(sources: DataFrame) -> DataFrame:
    """The enabled sources."""
    return sources.where(F.col("enabled"))


def read_sources(spark: SparkSession, sources: DataFrame, containers: DataFrame | None = None, **options) -> DataFrame:
    """Lines of all enabled file, folder, container and journal sources.

    The source table is configuration and is read on the driver; every source
    becomes a scan and the scans are united.
    """
    scans = []
    for s in load_sources(sources).select("source_id", "label", "kind").collect():
        kind = s["kind"]
        if kind["type"] == "file":
            scans.append(read_log_files(spark, kind["path"], s["source_id"], s["label"], **options))
        elif kind["type"] == "directory":
            scans.append(read_log_dir(spark, kind["path"], s["source_id"], s["label"], kind["pattern"] or "*.log", **options))
        elif kind["type"] == "docker_container":
            scans.append(read_container_logs(spark, kind["path"], s["source_id"], s["label"], **options))
        elif kind["type"] == "docker_service":
            scans.append(read_container_service(spark, containers, kind["name"], s["source_id"], s["label"], **options))
        elif kind["type"] in ("system_macos", "journald", "windows_event_log"):
            scans.append(read_system_export(spark, kind["path"], s["source_id"], s["label"], **options))
        else:
            raise ValueError(f"source kind {kind['type']!r} cannot be read as files")
    if not scans:
        raise ValueError("no enabled source")
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out
