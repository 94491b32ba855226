import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import clusters as C, explain as X, queries as Q
from tracewell.sinks import export as EX, tables as S
from tracewell.sources import files


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    text = "\n".join(f"line {i}" if i % 5 else "" for i in range(3000)) + "\n"
    paths = [write(tmp_path, f"{n}.log", text) for n in "abc"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1900")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = files.read_log_files(spark, paths, "s").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3 * 2400
    assert all(r["value"] == f"line {r['line_no']}" for r in rows)


def test_readers(spark, tmp_path):
    write(tmp_path, "x/a.log", "one\r\n\n \ntwo  \n")
    write(tmp_path, "x/deep/b.log", "three\n")
    write(tmp_path, "x/c.txt", "no\n")
    rows = files.read_log_dir(spark, str(tmp_path / "x"), "d", "Logs").collect()
    assert sorted((r["source_label"], r["line_no"], r["value"]) for r in rows) == [("Logs (a.log)", 0, "one"), ("Logs (a.log)", 2, " "), ("Logs (a.log)", 3, "two  "), ("Logs (b.log)", 0, "three")]
    assert all(r["source_id"].startswith("d/file:") for r in rows)
    one = files.read_log_files(spark, str(tmp_path / "x/a.log")).first()
    assert one["source_label"] == "a.log"
    tail = files.read_container_logs(spark, str(tmp_path / "x/a.log"), "0123456789abcdef", tail=1).collect()
    assert [(r["source_label"], r["value"]) for r in tail] == [("0123456789ab", "two")]
    containers = spark.createDataFrame([("web", str(tmp_path / "x/a.log")), ("web", str(tmp_path / "x/deep/b.log")), ("db", "/none")], "service_name string, path string")
    service = files.read_container_service(spark, containers, "web", "w", "Web").collect()
    assert sorted(r["value"] for r in service) == ["one", "three", "two"]
    journal = files.read_system_export(spark, str(tmp_path / "x/a.log"), "j", "Journal").collect()
    assert sorted(r["value"] for r in journal) == ["one", "two  "]
    table = spark.createDataFrame([("a", "A", ("file", str(tmp_path / "x/a.log"), None, None), True), ("b", "B", ("directory", str(tmp_path / "x/deep"), None, None), True),
                                   ("c", "C", ("file", "/none", None, None), False)], "source_id string, label string, kind struct<type:string,path:string,pattern:string,name:string>, enabled boolean")
    assert files.read_sources(spark, table).count() == 4


def test_append_and_purge(spark, tmp_path, make_entries):
    path, day = str(tmp_path / "entries"), 86400
    entries = make_entries([(i, i * day / 4, "info", "s", "m") for i in range(12)])
    S.append_entries(entries.where("seq < 8"), path)
    S.append_entries(entries.unionByName(entries), path)
    assert S.count_entries(S.read_table(spark, path)).first()[0] == 12
    assert S.purge_before(spark, path, "2024-01-02 12:00:00") == 6
    assert S.purge_before(spark, path, "2024-01-02 12:00:00") == 0
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == list(range(6, 12))
    assert S.purge_before(spark, path, "2024-01-03 00:00:00") == 2
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == list(range(8, 12))
    plan = Q.filter_entries(S.read_table(spark, path), from_time="2024-01-03 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_upsert_keeps_identity_and_updates_counts(spark, tmp_path, make_entries):
    path = str(tmp_path / "clusters")
    first = C.cluster_exact(make_entries([(0, 50, "info", "a", "job 1"), (1, 60, "warn", "a", "other")]))
    both = C.cluster_exact(make_entries([(0, 10, "error", "b", "job 1"), (1, 60, "error", "b", "job 2"), (2, 70, "info", "a", "third")]))
    S.upsert_clusters(C.cluster_summary(first), path)
    S.upsert_clusters(C.cluster_summary(both), path)
    rows = {r["template"]: r for r in S.read_snapshot(spark, path).collect()}
    assert {t: r["count"] for t, r in rows.items()} == {"job <N>": 2, "other": 1, "third": 1}
    assert (rows["job <N>"]["level"], rows["job <N>"]["first_seen"].second, rows["job <N>"]["services"]) == ("info", 50, ["b"])


def test_exports(spark, tmp_path, make_entries):
    entries = make_entries([(i, i, "error" if i % 2 else "info", None if i == 5 else "s", "a|b " + "x" * 200) for i in range(620)])
    chosen = EX.export_selection(entries, ("error",)).select("id", "timestamp", "level", "service", "message")
    document = json.loads(EX.export_json(chosen, "2024-02-01T00:00:00Z").first()["document"])
    assert document["entry_count"] == 310 and document["ai_summary"] is None
    assert [e["id"] for e in document["entries"]][:2] == ["id000619", "id000617"]
    assert document["entries"][-3]["service"] is None
    summary = spark.createDataFrame([("All broken", ["k1", "k2"], [])], "overview string, key_issues array<string>, recommendations array<string>")
    text = EX.export_markdown(EX.export_selection(entries), "2024-02-01T00:00:00Z", summary).first()["document"]
    lines = text.split("\n")
    assert "**Entries:** 620" in text and "- k2" in lines and "### Recommendations" not in text
    table = [line for line in lines if line.startswith("| 2024")]
    assert len(table) == 500 and table[0].startswith("| 2024-01-01 00:10:19 | Error | s | a\\|b xxx")
    assert "_... and 120 more entries_" in lines
    EX.export(entries, str(tmp_path / "out.md"), "now")
    assert spark.read.text(str(tmp_path / "out.md")).first()[0].startswith("# ")


def test_filters(make_entries):
    entries = make_entries([(0, 0, "error", "a", "x' OR '1'='1"), (1, 1, "info", "b", "fine")]).withColumn("cluster_id", F.concat(F.lit("cluster-"), F.col("service")))
    assert Q.filter_entries(entries, cluster_id="x' OR '1'='1").count() == 0
    assert Q.filter_entries(entries, cluster_id="cluster-a").count() == 1
    assert Q.filter_entries(entries, has_stacktrace=False).count() == 2
    assert Q.filter_entries(entries, has_stacktrace=True).count() == 0
    assert Q.filter_entries(entries, from_time="2024-01-01 00:00:01", to_time="2024-01-01 00:00:01").count() == 1
    with pytest.raises(ValueError):
        Q.search_entries(entries, "(")
    assert [r["seq"] for r in Q.page(entries, 1, 1).collect()] == [0]
    assert Q.page_counts(entries, 1, 1).first().asDict() == {"total_matches": 2, "returned": 1}


REPLIES = [
    ("plain", '{"what":"w","why":"y","impact":"i","debug_steps":["a"],"possible_causes":[],"fix_suggestions":["f"],"confidence":0.9}'),
    ("prose", 'Sure! {"what":"w","debug_steps":["a",1,null,"b"]} Done.'), ("typed", '{"what":7,"confidence":"high","debug_steps":"x"}'),
    ("none", "no braces"), ("broken", "{oops}"),
]


def test_replies(spark):
    replies = spark.createDataFrame(REPLIES, "entry_id string, reply string")
    rows = {r["entry_id"]: r for r in X.parse_explanations(replies).collect()}
    assert set(rows) == {"plain", "prose", "typed"}
    assert rows["plain"]["confidence"] == pytest.approx(0.9) and rows["plain"]["fix_suggestions"] == ["f"]
    assert (rows["prose"]["debug_steps"], rows["prose"]["why"], rows["prose"]["confidence"]) == (["a", "b"], "", 0.5)
    assert (rows["typed"]["what"], rows["typed"]["confidence"], rows["typed"]["debug_steps"]) == ("", 0.5, [])
    causes = spark.createDataFrame([("c", '{"root_cause":"r","fix_suggestions":[{"title":"a"},{"step":9,"command":"ls"}]}')], "cluster_id string, reply string")
    row = X.parse_root_causes(causes).first()
    assert row["title"] == "Root Cause Analysis"
    assert [tuple(s) for s in row["fix_suggestions"]] == [(1, "a", "", None, None), (9, "", "", "ls", None)]
    summaries = spark.createDataFrame([("b", '{"overview":"o"}', 3, 4), ("c", "{}", None, 4)], "block string, reply string, input_tokens int, output_tokens int")
    assert sorted((r["block"], r["overview"], r["tokens_used"] or 0) for r in X.parse_summaries(summaries).collect()) == [("b", "o", 7), ("c", "", 0)]


def test_ask_model_and_cache(make_entries):
    entries = make_entries([(i, i, "error" if i % 2 else "info", "s", f"m{i}") for i in range(4)])
    prompts = X.explain_prompts(Q.errors_to_explain(entries))
    answered = X.ask_model(prompts, lambda texts: ['{"what":"' + t.split("Message: ")[1].split("\n")[0] + '"}' for t in texts])
    parsed = X.parse_explanations(answered)
    assert sorted(r["what"] for r in parsed.collect()) == ["m1", "m3"]
    stored = parsed.selectExpr("entry_id as id", "entry_id", "timestamp_ntz'2024-01-01 00:00:00' as created_at", "what")
    cached, missing = X.explanation_cache(entries, stored)
    assert (cached.count(), missing.count()) == (2, 2)
    assert Q.errors_to_explain(entries, stored).count() == 0
