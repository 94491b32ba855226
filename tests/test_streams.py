import os

from pyspark.sql import functions as F

from tracewell.operators.assemble import merge_stacktraces
from tracewell.operators.clusters import cluster_summary
from tracewell.operators.normalize import normalize_lines
from tracewell.sinks.tables import read_snapshot, read_table
from tracewell.sources.files import read_log_dir
from tracewell.streaming.ingest import _enriched, assemble_batch, ingest
from tracewell.streaming.operators import detect_spikes_stream, merge_stacktraces_stream
from tracewell.streaming.sources import stream_log_files

PARTS = [
    "\tat orphan\n2026-01-01T00:00:00Z ERROR [pay] charge 1 failed\n\tat a.b(C.java:1)\n",
    "Caused by: disk\n2026-01-01T00:00:01Z ERROR [pay] charge 2 failed\n2026-01-01T00:00:02Z INFO [web] up\n",
    "\tat late\n2026-01-01T00:00:03Z ERROR [pay] charge 3 failed\nlast line\n",
]


def split_stream(spark, tmp_path):
    """One logical file that arrives in three parts, one per micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(PARTS):
        path = folder / f"{i}.log"
        path.write_text(part)
        os.utime(path, (1_700_000_000 + i * 60,) * 2)  # files are taken by age
    stream = stream_log_files(spark, str(folder), "s", "S", max_files=1)
    number = F.regexp_extract("file", r"(\d)\.log", 1).cast("long")
    return stream.withColumn("line_no", number * 100 + F.col("line_no")).withColumn("file", F.lit("app.log"))


def whole(spark, tmp_path):
    lines = read_log_dir(spark, str(tmp_path / "in"), "s", "S")
    number = F.regexp_extract("file", r"(\d)\.log", 1).cast("long")
    return lines.withColumn("line_no", number * 100 + F.col("line_no")).withColumn("file", F.lit("app.log")).withColumn("source_id", F.lit("s"))


def test_ingest_agrees_with_batch(spark, tmp_path):
    tops = []
    store = str(tmp_path / "store")
    query = ingest(split_stream(spark, tmp_path), store, str(tmp_path / "cp"), trigger={"availableNow": True},
                   on_batch=lambda top, batch_id: tops.append([r["count"] for r in top.collect()]))
    query.awaitTermination()
    batch = normalize_lines(merge_stacktraces(whole(spark, tmp_path))).where("message <> 'last line'")
    columns = ["seq", "timestamp", "level", "service", "message", "stacktrace", "fingerprint"]
    key = lambda r: r["seq"]
    got = read_table(spark, f"{store}/entries").select(*columns)
    assert sorted(got.collect(), key=key) == sorted(batch.select(*columns).collect(), key=key)
    assert [r["stacktrace"] for r in sorted(got.collect(), key=key)] == [["\tat orphan", "\tat a.b(C.java:1)", "Caused by: disk"], None, ["\tat late"], None]
    summary = ["cluster_id", "template", "level", "count", "first_seen", "last_seen", "services"]
    assert sorted(map(tuple, read_snapshot(spark, f"{store}/clusters").select(*summary).collect())) == sorted(map(tuple, cluster_summary(batch).select(*summary).collect()))
    assert len(tops) == 3 and tops[-1] == [3]


def test_stateful_merge_agrees_with_batch(spark, tmp_path):
    stream = merge_stacktraces_stream(split_stream(spark, tmp_path), flush_after_ms=None)
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    columns = ["line_no", "value", "stacktrace"]
    expected = merge_stacktraces(whole(spark, tmp_path)).where("value <> 'last line'").select(*columns).collect()
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == sorted(map(tuple, expected))


def test_spike_state_survives_batches(spark, tmp_path, make_entries):
    rows = [(i, i * 30.0, "error", "q", "m") for i in range(20)] + [(100 + i, 601 + i * 0.004, "error", "z", "m") for i in range(400)]
    entries = make_entries(rows)
    folder = str(tmp_path / "in")
    for i, condition in enumerate(["seq < 15", "seq >= 15 and seq < 250", "seq >= 250"]):
        entries.where(condition).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = str(tmp_path / "out")
    detect_spikes_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    from tracewell.operators.spikes import detect_spikes
    strip = lambda df: sorted((r["detected_at"], r["rate"], round(r["baseline"], 6), r["service"]) for r in df.collect())
    assert strip(spark.read.parquet(out)) == strip(detect_spikes(entries)) != []


def test_spike_names_its_service_in_any_arrow_batch(spark, tmp_path, make_entries):
    from tracewell.operators.spikes import detect_spikes

    # Several batches of a group reach the detector together, each with row numbers from 0.
    rows = [(i, i * 30.0, "error", "q", "m") for i in range(20)] + [(100 + i, 601 + i * 0.004, "error", f"z{i}", "m") for i in range(400)]
    entries = make_entries(rows)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    entries.coalesce(1).write.parquet(folder)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        found = detect_spikes_stream(spark.readStream.schema(entries.schema).parquet(folder))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    strip = lambda df: sorted((r["detected_at"], r["rate"], round(r["baseline"], 6), r["service"]) for r in df.collect())
    assert strip(spark.read.parquet(out)) == strip(detect_spikes(entries)) != []


def test_known_fingerprints_keep_their_cluster(spark, make_entries, tmp_path):
    from tracewell.operators.clusters import with_fingerprint
    from tracewell.streaming.ingest import _with_kept_clusters

    # Of 40 letters the member differs from the first leader in six and from the second in four.
    first, member, second = "a" * 30 + "b" * 10, "a" * 30 + "b" * 4 + "c" * 6, "a" * 26 + "d" * 4 + "b" * 4 + "c" * 6
    batches = [[first, member], [second], [member]]
    found = []
    for i, messages in enumerate(batches):
        rows = make_entries([(10 * i + j, float(i), "error", "s", m) for j, m in enumerate(messages)])
        got = _with_kept_clusters(with_fingerprint(rows), i, str(tmp_path)).select("message", "fingerprint", "cluster_id").collect()
        found.append({r.message: (r.fingerprint, r.cluster_id) for r in got})
    leader = found[0][first][0]
    assert found[0][first][1] == found[0][member][1] == found[2][member][1] == leader
    assert found[1][second][1] == found[1][second][0] != leader


def test_stateful_merge_holds_no_whole_file(spark, tmp_path):
    """A busy file is dealt by chunks of its lines, not held by one group."""
    stream = merge_stacktraces_stream(split_stream(spark, tmp_path), flush_after_ms=None, whole_files=True)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "chunk" in plan and "FlatMapGroupsInPandasWithState" not in plan


def test_entries_of_one_busy_file_are_parsed_by_many_tasks(spark):
    lines = spark.range(3000).selectExpr("'s' as source_id", "'S' as source_label", "'app.log' as file", "id as line_no",
                                         "concat('2026-01-01T00:00:00Z ERROR [pay] charge ', id, ' failed') as value", "timestamp_ntz'2026-01-01' as ingested_at")
    complete, still_open = assemble_batch(lines, None)
    assert (complete.count(), [r.line_no for r in still_open.collect()]) == (2999, [2999])
    parsed = _enriched(complete, 0, "", None, (), False, {})
    assert parsed.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_one_rolled_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    import gzip

    from tracewell.streaming import sources

    folder = tmp_path / "rolled"
    folder.mkdir()
    long = "".join(f"line {i} {'x' * (i * 7 % 90)}{chr(13) if i % 5 == 0 else ''}\n{chr(10) if i % 11 == 0 else ''}" for i in range(400))
    texts = {"a b%20#1.log": long.encode() + b"no end", "b.log": b"", "c.log": "﻿ü\n".encode() + b"bad \xff\xed\xa0\x80\n\n \n", "d.log": b"x" * 5000 + b"\ny"}
    for name, text in texts.items():
        (folder / name).write_bytes(text)
    (folder / "e.log.gz").write_bytes(gzip.compress(long.encode()))
    monkeypatch.setattr(sources, "RANGE_BYTES", 700)

    def rows(max_files):
        found = []
        stream = stream_log_files(spark, str(folder), "s", pattern="*.log*", max_files=max_files).withColumn("task", F.spark_partition_id())
        query = stream.writeStream.foreachBatch(lambda batch, batch_id: found.extend(batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return found

    got = rows(1)
    assert len({r.task for r in got if r.source_label.startswith("a")}) > 1
    key = lambda found: sorted((r.file, r.source_label, r.line_no, r.value, r.ingested_at) for r in found)
    for max_files in (1, None):
        found = got if max_files else rows(None)
        with monkeypatch.context() as m:
            m.setattr(sources, "_known", lambda *_: False)
            assert key(found) == key(rows(max_files)) and len(found) == 806
