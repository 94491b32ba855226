"""Stateful line assembly by chunks."""

import random
import time

from tracewell.operators.assemble import merge_stacktraces
from tracewell.streaming.assemble import assemble_stream

SCHEMA = "source_id string, file string, line_no long, value string"


def write_steps(spark, folder, lines, cuts):
    """One folder of Parquet files, to be taken one by one in order."""
    import os

    for i, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True)):
        path = f"{folder}/{i}"
        spark.createDataFrame(lines[low:high], SCHEMA).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + 60 * i,) * 2)


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_chunks_and_batches_agree_with_the_batch_operator(spark, tmp_path):
    rng = random.Random(11)
    lines = [("s", "hot.log", i, "\tat x" + str(i) if rng.random() < 0.6 or i < 3 or 60 <= i < 95 else f"head {i}") for i in range(400)]
    lines += [("s", "other.log", i, f"head {i}") for i in range(5)] + [("s", "none.log", i, "\tat y") for i in range(3)]
    folder = str(tmp_path / "in")
    write_steps(spark, folder, lines, [7, 70, 85, 250])
    want = {tuple(r) for r in merge_stacktraces(spark.createDataFrame(lines, SCHEMA)).selectExpr(
        "file", "line_no", "value", "array_join(stacktrace, '|')").collect()}
    last = {f: max(w[1] for w in want if w[0] == f) for f in ("hot.log", "other.log")}
    for name, whole in (("a", False), ("b", False)):
        out = str(tmp_path / name)
        stream = assemble_stream(stream_of(spark, folder), flush_after_ms=None, whole_files=whole, chunk=9 if name == "a" else 1000)
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True)
         .start().awaitTermination())
        got = [tuple(r) for r in spark.read.parquet(out).selectExpr("file", "line_no", "value", "array_join(stacktrace, '|')").collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if w[1] < last[w[0]]}


def test_an_open_entry_is_flushed_by_a_timer(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_steps(spark, folder, [("s", "a.log", 0, "head"), ("s", "a.log", 1, "\tat x")], [])
    query = (assemble_stream(stream_of(spark, folder), flush_after_ms=300).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", out + "-cp").trigger(processingTime="200 milliseconds").start())
    try:
        found, until = [], time.time() + 90
        while not found and time.time() < until:
            time.sleep(1)
            try:
                found = [tuple(r) for r in spark.read.schema("line_no long, value string, stacktrace array<string>").parquet(out).collect()]
            except Exception:  # nothing written yet
                found = []
        assert found == [(0, "head", ["\tat x"])]
    finally:
        query.stop()
