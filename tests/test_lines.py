import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions.formats import CONTINUATIONS
from tracewell.operators.assemble import merge_stacktraces
from tracewell.operators.normalize import normalize_lines
from tracewell.operators.parsers import LineTemplate, compile_templates, only_parsed, parse_custom

DEPOT = LineTemplate("depot", "Depot", r"^(?P<timestamp>\S+) <(?P<level>\w+)> (?P<service>[\w-]+) => (?P<message>.*)$")
ARRIVED = dt.datetime(2030, 1, 1)


@pytest.fixture
def lines_of(spark):
    def build(values, hint=None):
        df = spark.createDataFrame([("s", "f", i, v) for i, v in enumerate(values)], "source_id string, file string, line_no long, value string")
        return df.withColumn("ingested_at", F.lit(ARRIVED).cast("timestamp_ntz")).withColumn("parser_hint", F.lit(hint).cast("string"))
    return build


def normalized(lines, **options):
    return {r["seq"]: r for r in normalize_lines(lines, templates=[DEPOT], **options).collect()}


def test_json(lines_of):
    rows = normalized(lines_of([
        '{"level":"warn","msg":"hi","service":3,"app":"z","ts":"2026-01-01T00:00:00.5Z"}',
        '{"level":30,"lvl":"E","message":"a","message":"b"}', "{bad}", '{"a":1}{"b":2}', "{'a':1}", '{"PRIORITY":"3","MESSAGE":"x"}',
        '{"log":"inner\\n","stream":"stdout","time":"2026-01-01T00:00:00Z"}', '{"app":"a1","text":"t","date":"2026-01-02T00:00:00Z","time":"soon"}',
    ]))
    assert set(rows) == {0, 1, 5, 6, 7}
    assert (rows[0]["level"], rows[0]["message"], rows[0]["service"], rows[0]["timestamp"]) == ("warn", "hi", None, dt.datetime(2026, 1, 1, 0, 0, 0, 500000))
    assert (rows[1]["level"], rows[1]["message"], rows[1]["timestamp"], rows[1]["ts_source"]) == ("error", "b", ARRIVED, "ingest")
    assert rows[1]["fields"] == '{"level":30,"lvl":"E","message":"b"}'
    assert (rows[5]["message"], rows[5]["level"]) == ("", "unknown")
    assert (rows[6]["format"], rows[6]["message"], rows[6]["level"], rows[6]["fields"]) == ("docker", "inner", "unknown", "{}")
    assert (rows[7]["service"], rows[7]["message"], rows[7]["timestamp"]) == ("a1", "t", dt.datetime(2026, 1, 2))


def test_key_value_and_text(lines_of):
    rows = normalized(lines_of([
        'a=1 a=2 level=err msg="hello w" time=2026-01-01T00:00:00Z app=x', 'x="" y="q', "[ERROR] [billing] x", "INFO", " ",
        "2026-01-01 00:00:00 INFO hi", "time=soon ts=2026-01-01T00:00:00Z", "2026-01-01T00:00:00+02:00 ERROR [pay] boom.",
        "Jan  1 00:00:00 host app[1]: x",
    ]))
    assert (rows[0]["level"], rows[0]["message"], rows[0]["service"]) == ("error", "hello w", "x")
    assert '"a":"2"' in rows[0]["fields"]
    assert (rows[1]["message"], rows[1]["fields"]) == ('x="" y="q', '{"x":"","y":"\\"q"}')
    assert (rows[2]["level"], rows[2]["service"], rows[2]["message"]) == ("error", "ERROR", "billing] x")
    assert (rows[3]["level"], rows[3]["message"]) == ("info", "INFO")
    assert 4 not in rows
    assert rows[5]["message"] == "2026-01-01 00:00:00  hi"
    assert rows[6]["ts_source"] == "ingest"
    assert (rows[7]["timestamp"], rows[7]["service"], rows[7]["message"]) == (dt.datetime(2025, 12, 31, 22), "pay", "pay] boom.")
    assert (rows[8]["format"], rows[8]["detected_format"], rows[8]["message"]) == ("plaintext", "syslog", "host app[1]: x")


def test_custom_templates(lines_of):
    rows = normalized(lines_of(["2025-03-09T10:00:00Z <ERROR> stock-keeper => shelf 12 is empty", "a line of another kind"], hint="depot"))
    assert (rows[0]["level"], rows[0]["service"], rows[0]["message"], rows[0]["timestamp"]) == ("error", "stock-keeper", "shelf 12 is empty", dt.datetime(2025, 3, 9, 10))
    assert rows[1]["format"] == "plaintext"
    compiled = compile_templates([LineTemplate("bad", "Bad", "([open"), DEPOT, LineTemplate("ts", "T", r"^(?P<timestamp>\S+ \S+) (?P<message>.*)$", "%Y/%m/%d %H:%M:%S")])
    assert set(compiled) == {"depot", "ts"}
    row = only_parsed(parse_custom(lines_of(["2025/03/09 10:00:00 lamp on", " "]), compiled["ts"])).first()["parsed"]
    assert (row["timestamp"], row["message"], row["level"], row["service"]) == (dt.datetime(2025, 3, 9, 10), "lamp on", "unknown", None)


def test_options(lines_of):
    rows = normalized(lines_of(["{bad}", '{"log":"ERROR [pay] inner"}']), on_malformed="plaintext", unwrap_container=True)
    assert rows[0]["message"] == "bad"
    assert (rows[1]["level"], rows[1]["service"], rows[1]["format"]) == ("error", "pay", "docker")


def test_extra_parser(lines_of):
    def extra(df, line, out):
        from tracewell.operators.parsers import _result
        return df.withColumn(out, F.when(F.startswith(line, F.lit("!!")), _result(None, "fatal", None, F.substring(line, 3, 100), "{}", "unknown")))
    rows = normalized(lines_of(["!!boom", "ok"]), extra=[extra])
    assert (rows[0]["level"], rows[0]["message"], rows[1]["message"]) == ("fatal", "boom", "ok")


def merge_model(values):
    """Sequential accumulator."""
    continued = re.compile("|".join(CONTINUATIONS))
    pending, trace, out = None, [], []
    for number, value in values:
        if continued.search(value):
            trace.append(value)
            continue
        if pending is not None:
            out.append((*pending, trace))
            trace = []
        pending = (number, value)
    if pending is not None:
        out.append((*pending, trace))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_merge_agrees_with_sequential_model(spark, chunk):
    rng, rows, expected = random.Random(chunk), [], []
    for f in range(6):
        share = [0.0, 0.3, 0.6, 0.95, 1.0, 0.5][f]
        values = [(n * 3, rng.choice(["\tat a.b(C.java:1)", "Caused by: x", "  deep"]) if rng.random() < share else f"head {f} {n}") for n in range(60)]
        rows += [("s", f"f{f}", n, v, f"extra {n}") for n, v in values]
        expected += [("s", f"f{f}", n, v, f"extra {n}", t or None) for n, v, t in merge_model(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_id string, file string, line_no long, value string, more string")
    got = merge_stacktraces(df, chunk_lines=chunk).select("source_id", "file", "line_no", "value", "more", "stacktrace").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_plaintext_searches_once_for_each_pattern(spark):
    from tracewell.operators.parsers import TEXT_EDGES, only_parsed, parse_plaintext

    lines = spark.createDataFrame([("2026-01-01T00:00:00Z ERROR [pay] charge failed",), (" ",), ("plain",)], "value string")
    parsed = only_parsed(parse_plaintext(lines)).select("parsed.*")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(TEXT_EDGES) == 1
    assert [(r.level, r.service, r.message) for r in parsed.collect()] == [("error", "pay", "pay] charge failed"), ("unknown", None, "plain")]


def test_short_rows_of_one_row_group_reach_all_tasks(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracewell.plans import fixtures as fx

    values = np.random.default_rng(1).integers(0, 1 << 62, (4, 800_000))
    pq.write_table(pa.table({f"c{i}": v for i, v in enumerate(values)}), tmp_path / "events.parquet", row_group_size=1 << 20)
    parts = [r["count"] for r in fx.table(spark, str(tmp_path), "events").groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 4 and max(parts) < 1.5 * sum(parts) / len(parts)
