"""Streams of raw lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.session import configure
from tracewell.sources.files import accept_lines, file_name
from tracewell.streaming.tail import BLOCK, open_file_system

RANGE_BYTES = 128 << 20
TO_THE_END = 1 << 62
# Read as a whole and unpacked on the way; Arrow knows them by their names.
PACKED = (".gz", ".bz2", ".zst")
# Packed in a way that only Hadoop unpacks.
UNKNOWN = (".deflate", ".snappy", ".lz4")
LISTED = "path string, modificationTime timestamp, length long, content binary"
LINES = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("value", pa.binary()), ("ingested_at", pa.timestamp("us"))])
LINE_TYPES = "file string, line_no long, value binary, ingested_at timestamp_ntz"


def read_lines(file, low: int, high: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first line and texts of the lines that start in ``low`` to ``high``, block by block.

    Line ends before ``low`` are counted. A text behind the last line end is a line.
    """
    number, position, last = 0, 0, b"\n"
    while position < low:
        block = file.read(min(BLOCK, low - position))
        if not block:
            return
        number, position, last = number + block.count(b"\n"), position + len(block), block[-1:]
    # The line that is open at the start of the range belongs to the range before.
    opened, start, parts = last != b"\n", low, []
    while start < high:
        block = file.read(BLOCK)
        end = block.rfind(b"\n")
        if block and end < 0:
            parts.append(b"" if opened else block)
            start += len(block) if opened else 0
            continue
        data = b"".join([*parts, block[:max(end, 0)]])
        parts = [block[end + 1:]]
        reached = start + len(data) + 1
        cut = data.find(b"\n", max(0, high - start - 1)) if reached > high else -1
        data = data[:cut] if cut >= 0 else data
        if opened:
            opened, number = False, number + 1
            data = data.partition(b"\n")[2] if b"\n" in data else None
        if data is not None:
            lines = data.split(b"\n")
            yield number, lines
            number += len(lines)
        if not block or cut >= 0:
            return
        start = reached


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = open_file_system(row["file"])
            packed = row["file"].endswith(PACKED)
            with system.open_input_stream(path, compression="detect" if packed else None) as file:
                for number, lines in read_lines(file, row["low"], row["high"]):
                    columns = [pa.repeat(pa.scalar(row["file"]), len(lines)), pa.array(range(number, number + len(lines)), pa.int64()),
                               pa.array(lines, pa.binary()), pa.repeat(pa.scalar(row["ingested_at"], pa.timestamp("us")), len(lines))]
                    yield pa.RecordBatch.from_arrays(columns, schema=LINES)


def _listed(spark: SparkSession, reader, path: str) -> DataFrame:
    """Lines of all files, read as byte ranges by many tasks. Only the names and sizes of files come from Spark's reader."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    whole = F.lit(False)
    for ending in PACKED:
        whole = whole | file.endswith(ending)
    low = F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))))
    ranges = reader.format("binaryFile").schema(LISTED).load(path).select(
        file.alias("file"), size.alias("size"), whole.alias("whole"), F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ingested_at"), low.alias("low"))
    last = F.col("whole") | (F.col("low") + RANGE_BYTES >= F.col("size"))
    ranges = ranges.select("file", "low", F.when(last, F.lit(TO_THE_END)).otherwise(F.col("low") + RANGE_BYTES).alias("high"), "ingested_at")
    return ranges.repartition(tasks).mapInArrow(_read, LINE_TYPES).withColumn("value", F.col("value").cast("string"))


def _whole_texts(reader, path: str) -> DataFrame:
    """Lines of all files, each read as one text by Spark's reader."""
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ingested_at"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "value"),
    )


def _known(path: str, pattern: str) -> bool:
    """Can Arrow reach the files of a folder and read them in ranges?"""
    try:
        open_file_system(path)
    except (ImportError, NotImplementedError, OSError, pa.ArrowException):
        return False
    return not pattern.endswith(UNKNOWN)


def stream_log_files(spark: SparkSession, path: str, source_id: str | None = None, label: str | None = None,
                     pattern: str = "*.log", blank_policy: str = "empty", max_files: int | None = None) -> DataFrame:
    """Lines of every file that appears below a folder, new files included.

    Spark treats files as immutable, so this follows rolled files. A file is read in ranges of ``RANGE_BYTES``, whose
    task counts the lines before them, and held in memory by blocks. On file systems that only Spark reaches a file is
    read as one text; roll files well below 2 GB there.
    """
    configure(spark)
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = _listed(spark, reader, path) if _known(path, pattern) else _whole_texts(reader, path)
    lines = files.select(
        (F.col("file") if source_id is None else F.lit(source_id)).alias("source_id"),
        (file_name(F.col("file")) if label is None else F.lit(label)).alias("source_label"),
        "file", F.col("line_no").cast("long").alias("line_no"),
        F.regexp_replace("value", r"\r+$", "").alias("value"), "ingested_at",
    )
    return accept_lines(lines, blank_policy)
