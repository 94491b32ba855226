"""Exports of any size as ordered parts."""

import json

from tracewell.sinks import export as EX


def test_parts_of_an_export_are_one_document(spark, make_entries, tmp_path):
    e = make_entries([(i, i % 400 * 1.5, "error" if i % 3 else "info", "a|b", f"m {i} | \"q\"") for i in range(1500)]).select(
        "id", "timestamp", "level", "service", "message")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep several parts
    try:
        EX.export_all(e, str(tmp_path / "x.json"), "2026-01-01T00:00:00Z")
        EX.export_all(e, str(tmp_path / "x.md"), "2026-01-01T00:00:00Z", levels=("info",))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted(tmp_path.glob("x.json/part-*"))
    assert len(parts) > 1
    found = json.loads("".join(p.read_text() for p in parts))
    assert found["entry_count"] == len(found["entries"]) == 1500
    assert [x["id"] for x in found["entries"]] == [r.id for r in e.orderBy(e.timestamp.desc(), "id").select("id").collect()]
    assert [r.line for r in EX.read_lines(spark, str(tmp_path / "x.json")).orderBy("line_no").collect()] == "".join(p.read_text() for p in parts).splitlines()
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("x.md/part-*"))).splitlines()
    assert text[3] == "**Entries:** 500" and len(text) == 509 and text[9].endswith('\\| "q" |')


def test_export_of_nothing(spark, make_entries, tmp_path):
    e = make_entries([]).select("id", "timestamp", "level", "message")
    EX.export_all(e, str(tmp_path / "x.json"), "2026-01-01T00:00:00Z")
    assert json.loads("".join(p.read_text() for p in sorted(tmp_path.glob("x.json/part-*"))))["entries"] == []
