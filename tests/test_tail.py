"""Following growing files."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.sinks.tables import read_table
from tracewell.streaming.ingest import ingest
from tracewell.streaming.tail import Range, TailReader, follow_log_dir, follow_log_files, read_range


def drain(spark, stream, tmp_path, name="a"):
    """What a stream gives beyond its checkpoint, then stop."""
    out = tmp_path / f"{name}-out"
    (stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).select("line_no", "value").collect())


@pytest.mark.parametrize("block", [3, 7, 64])
def test_every_line_is_in_one_range(monkeypatch, block):
    monkeypatch.setattr("tracewell.streaming.tail.BLOCK", block)
    rng = random.Random(block)
    for _ in range(50):
        lines = ["é" * rng.randrange(9) + "x" * rng.randrange(30) for _ in range(rng.randrange(1, 12))]
        data = "".join(line + "\n" for line in lines).encode()
        begin = len(lines[0].encode()) + 1
        found, step = [], rng.randrange(1, 25)
        for low in range(begin, len(data), step):
            for positions, values in read_range(io.BytesIO(data), Range("p", "h", begin, low, min(low + step, len(data)))):
                found += zip(positions.tolist(), values, strict=True)
        assert [v for _, v in found] == lines[1:]
        assert all(data[p:p + len(v.encode())] == v.encode() for p, v in found)


def test_offsets_end_at_line_ends(tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntw")
    (tmp_path / "b.log").write_bytes(b"open")
    (tmp_path / "c.txt").write_bytes(b"no log\n")
    reader = TailReader({"path": str(tmp_path), "start": "end"})
    assert {os.path.basename(p): v["at"] for p, v in reader.initialOffset()["files"].items()} == {"a.log": 4}
    start = reader.latestOffset()
    with open(tmp_path / "a.log", "ab") as file:
        file.write(b"o\nthree\nfo")
    end = reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert (part.begin, part.low, part.high) == (4, 4, 14)
    assert [b.column("value").to_pylist() for b in reader.read(part)] == [["two", "three"]]
    assert reader.partitions(end, end) == []
    assert len(TailReader({"path": str(tmp_path), "splitbytes": "4"}).partitions({"files": {}}, end)) == 4
    with pytest.raises(ValueError):
        TailReader({"path": "x", "start": "middle"})


def test_appended_lines_arrive_once_and_in_order(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "app.log"
    log.write_bytes(b"before\n")
    stream = lambda: follow_log_files(spark, str(folder), "s", "S", split_bytes=16)
    assert drain(spark, stream(), tmp_path) == []
    with open(log, "ab") as file:
        file.write("ERROR é one\r\n\nINFO tw".encode())
    assert drain(spark, stream(), tmp_path) == [(7, "ERROR é one")]
    with open(log, "ab") as file:
        file.write(b"o\n")
    (folder / "new.log").write_bytes(b"whole\nfile\n")
    assert drain(spark, stream(), tmp_path) == [(0, "whole"), (6, "file"), (7, "ERROR é one"), (22, "INFO two")]
    log.write_bytes(b"replaced\n")  # the same name, another file
    assert (0, "replaced") in drain(spark, stream(), tmp_path)
    assert len(drain(spark, stream(), tmp_path)) == 5


def test_ingest_of_a_growing_file(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    steps = [
        "2026-01-01T00:00:00Z ERROR [pay] charge 1 failed\n\tat a.b(C.java:1)\n",
        "\tat late\n2026-01-01T00:00:01Z INFO [web] up\n2026-01-01T00:00:02Z ERR",
        "OR [pay] charge 2 failed\n2026-01-01T00:00:03Z INFO [web] end\n",
    ]
    for step in steps:
        with open(folder / "app.log", "a") as file:
            file.write(step)
        lines = follow_log_dir(spark, str(folder), "s", "S", start="beginning")
        ingest(lines, store, str(tmp_path / "cp"), trigger={"availableNow": True}).awaitTermination()
    got = read_table(spark, f"{store}/entries").orderBy("timestamp").collect()
    assert [(r["raw"][21:], r["stacktrace"]) for r in got] == [
        ("ERROR [pay] charge 1 failed", ["\tat a.b(C.java:1)", "\tat late"]), ("INFO [web] up", None), ("ERROR [pay] charge 2 failed", None)]
    assert got[0]["source_id"] == f"s/{folder}/app.log" and got[0]["source_label"] == "S (app.log)"


def test_many_ranges_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in/big.log", "w") as file:
        file.writelines(f"line {i} {'x' * (i % 50)}\n" for i in range(5000))
    stream = follow_log_files(spark, str(tmp_path / "in"), start="beginning", split_bytes=20_000)
    out = tmp_path / "out"
    (stream.withColumn("task", F.spark_partition_id()).writeStream.format("parquet").option("path", str(out))
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    found = spark.read.parquet(str(out))
    assert found.select("task").distinct().count() > 5
    assert [r.value.split()[1] for r in found.orderBy("line_no").collect()] == [str(i) for i in range(5000)]


def test_log_files_are_written_up_to_a_line_by_batches(spark, tmp_path):
    from tracewell.plans.fixtures import write_logs
    rows = [(s, 10 * i, f"{s} line {i}") for i in range(40) for s in ("a", "b", "c")]
    lines = spark.createDataFrame(rows, "source_id string, line_no long, value string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for until, whole in ((200, 20), (None, 40), (0, 0)):
            write_logs(lines, str(tmp_path / "logs"), until)
            for s in "abc":
                torn = f"{s} line {whole}"[:5] if whole < 40 else ""
                assert (tmp_path / "logs" / f"{s}.log").read_text() == "".join(f"{s} line {i}\n" for i in range(whole)) + torn
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
