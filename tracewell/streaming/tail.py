"""Following log files while they grow, as a streaming data source.

The offset of a stream is a byte position for each followed file, always behind a line
end, so a half-written line waits for its rest. A micro-batch is the bytes between two
offsets, cut into ranges that are read by separate tasks; a line belongs to the range in
which it starts. Repeating a batch reads the same bytes. Files are reached through
Arrow's file systems, so a path may be local, ``hdfs://`` or ``s3://``.

A file is known by its path and a checksum of its first line: a file that was replaced
under the same name starts again from its beginning, as a file of its own.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracewell.session import configure
from tracewell.sources.files import accept_lines, file_name

FORMAT = "tracewell_tail"
SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
HEAD_BYTES = 256
STARTS = ("beginning", "end")
SCHEMA = "path string, head string, position long, value string"


def open_file_system(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    """Lines of ``path`` that start in ``low`` to ``high``; ``begin`` is where the batch's first line starts."""

    def __init__(self, path: str, head: str, begin: int, low: int, high: int):
        self.path, self.head, self.begin, self.low, self.high = path, head, begin, low, high


def _last_line_end(file, size: int) -> int:
    """Position behind the last line end before ``size``, 0 if there is none; blocks are read from the end."""
    high = size
    while high > 0:
        low = max(0, high - BLOCK)
        file.seek(low)
        found = file.read(high - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        high = low
    return 0


def read_range(file, part: Range) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and texts of the lines of a range, block by block. Bytes that are no UTF-8 are replaced."""
    position = part.low
    if part.low > part.begin:
        # The line that is open at the start of the range belongs to the range before.
        file.seek(part.low - 1)
        position -= 1
        while True:
            block = file.read(BLOCK)
            found = block.find(b"\n")
            if found >= 0 or not block:
                position += found + 1
                break
            position += len(block)
    file.seek(position)
    parts: list[bytes] = []
    while position < part.high:
        block = file.read(BLOCK)
        if not block:
            return
        last = block.rfind(b"\n")
        if last < 0:
            parts.append(block)
            continue
        data = b"".join([*parts, block[:last + 1]])
        parts = [block[last + 1:]]
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        starts = position + np.r_[0, ends[:-1] + 1]
        count = int(np.searchsorted(starts, part.high))
        yield starts[:count], data[:int(ends[count - 1])].decode("utf-8", "replace").split("\n")
        position += len(data)


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*.log")
        self.start = options.get("start", "beginning")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        if self.start not in STARTS:
            raise ValueError(f"start must be one of {STARTS}")
        # What was found at the last look, so that files without change are not opened again.
        self.seen: dict[str, tuple[int, object, dict]] = {}

    def _files(self) -> dict[str, dict]:
        """Position and first-line checksum of every matching file that has a complete line."""
        from pyarrow import fs

        system, root = open_file_system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            found = [i for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)]
        seen = {}
        for item in found:
            known = self.seen.get(item.path)
            if known is None or known[:2] != (item.size, item.mtime_ns):
                with system.open_input_file(item.path) as file:
                    at = _last_line_end(file, item.size)
                    file.seek(0)
                    head = zlib.crc32(file.read(HEAD_BYTES).split(b"\n", 1)[0])
                known = (item.size, item.mtime_ns, {"at": at, "head": f"{head:08x}"})
            seen[item.path] = known
        self.seen = seen
        return {path: place for path, (_, _, place) in sorted(seen.items()) if place["at"]}

    def initialOffset(self) -> dict:
        return {"files": self._files() if self.start == "end" else {}}

    def latestOffset(self) -> dict:
        return {"files": self._files()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for path, place in end["files"].items():
            before = start["files"].get(path)
            # A replaced or cut file is read from its start.
            same = before is not None and before["head"] == place["head"] and before["at"] <= place["at"]
            begin = before["at"] if same else 0
            for low in range(begin, place["at"], self.split_bytes):
                ranges.append(Range(path, place["head"], begin, low, min(low + self.split_bytes, place["at"])))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["path", "head", "position", "value"]
        system, _ = open_file_system(self.path)
        with system.open_input_file(partition.path) as file:
            for positions, values in read_range(file, partition):
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n), pa.array([partition.head] * n), pa.array(positions), pa.array(values, pa.string())], names)


class TailSource(DataSource):
    """``path, head, position, value`` of the lines of growing files; see :func:`follow_log_files`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def follow_log_files(spark: SparkSession, path: str, source_id: str | None = None, label: str | None = None, pattern: str = "*.log",
                     start: str = "end", blank_policy: str = "empty", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of a file, or of every matching file below a folder, as they are appended.

    ``start="end"`` skips what the files hold when the stream is first started, as a live tail does;
    files that appear later are read whole. ``line_no`` is the byte position of the line:
    it grows within a file and is the same in every run. ``file`` is the path with the checksum of
    the first line, so a replaced file is a new one. The position of every followed file is
    part of the offset: meant for files that are being written; rolled ones that no longer
    change are read by :func:`tracewell.streaming.sources.stream_log_files`. A file that
    was cut back and has grown beyond its old length with the same first line cannot be told
    from one that only grew.
    """
    configure(spark)
    spark.dataSource.register(TailSource)
    found = (
        spark.readStream.format(FORMAT).option("pattern", pattern).option("start", start)
        .option("splitBytes", split_bytes).load(path)
    )
    lines = found.select(
        (F.col("path") if source_id is None else F.lit(source_id)).alias("source_id"),
        (file_name(F.col("path")) if label is None else F.lit(label)).alias("source_label"),
        F.concat_ws("#", "path", "head").alias("file"), F.col("position").alias("line_no"),
        F.regexp_replace("value", r"\r+$", "").alias("value"), F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"),
    )
    return accept_lines(lines, blank_policy)


def follow_log_dir(spark: SparkSession, path: str, source_id: str, label: str, pattern: str = "*.log", **options) -> DataFrame:
    """As :func:`follow_log_files`, each file being a source of its own."""
    lines = follow_log_files(spark, path, pattern=pattern, **options)
    name = F.regexp_replace("file", "#[0-9a-f]{8}$", "")
    return lines.withColumn("source_id", F.concat(F.lit(source_id + "/"), name)).withColumn(
        "source_label", F.concat(F.lit(label + " ("), file_name(name), F.lit(")")))
