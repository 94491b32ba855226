import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import clusters as C
from tracewell.operators.fuzzy import cluster_fuzzy, cluster_templates, distinct_templates


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def leader_model(templates):
    """Sequential leader clustering; ties go to the earliest leader."""
    leaders, out = [], {}
    for fp, text in templates:
        best = None
        for leader, other in leaders:
            longest = max(len(text), len(other))
            score = 1.0 if longest == 0 else 1 - edit_distance(text, other) / longest
            if score >= 0.85 and (best is None or score > best[0]):
                best = (score, leader)
        if best is None:
            leaders.append((fp, text))
        out[fp] = best[1] if best else fp
    return out


@pytest.fixture(scope="module")
def templates(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde fgé") for _ in range(rng.randint(0, 55))) for _ in range(14)]
    texts = []
    for _ in range(150):
        # One group holds a third of all templates.
        letters = list(base[0] + "x" * 20 if rng.random() < 0.33 else rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(letters) // 8))):
            at, kind = rng.randrange(len(letters) + 1), rng.random()
            if kind < 0.5 and at < len(letters):
                letters[at] = rng.choice("abcdefghij ")
            elif kind < 0.75 and at < len(letters):
                del letters[at]
            else:
                letters.insert(at, rng.choice("abcxyz"))
        texts.append("".join(letters))
    df = C.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "seq long, message string"))
    found = distinct_templates(df).cache()
    model = leader_model([(r["fingerprint"], r["template"]) for r in sorted(found.collect(), key=lambda r: r["seq"])])
    return found, model


@pytest.mark.parametrize("options", [{}, {"prefix_work": 3000, "smallest_prefix": 30}])
def test_fuzzy_agrees_with_sequential_model(templates, options):
    found, model = templates
    got = {r["fingerprint"]: r["cluster_id"] for r in cluster_templates(found, **options).collect()}
    assert got == model and len(set(model.values())) < len(model)


def test_fuzzy_with_existing_leaders(templates):
    found, model = templates
    first = cluster_templates(found.where("seq < 100"))
    leaders = first.select(F.col("cluster_id").alias("fingerprint"), F.col("leader_template").alias("template")).distinct()
    got = cluster_templates(found.where("seq >= 100"), leaders.join(found.select("fingerprint", "seq"), "fingerprint")).collect()
    assert got and all(model[r["fingerprint"]] == r["cluster_id"] for r in got)


def test_summary_follows_arrival_order(make_entries):
    rows = [(i, 100 - i, ["info", "unknown", "error"][i % 3], [None, "b", "a"][i % 3], f"job {i} failed") for i in range(9)]
    row = C.cluster_summary(C.cluster_exact(make_entries(rows))).first()
    assert (row["count"], row["template"], row["level"]) == (9, "job <N> failed", "unknown")
    assert row["services"] == ["b", "a"] and row["sample_ids"] == [f"id{i:06d}" for i in range(5)]
    assert row["first_seen"] < row["last_seen"] or row["first_seen"] == row["last_seen"]
    assert row["last_seen"].second == 32  # the last arrival, not the latest time


def test_views(make_entries):
    rows = [(i, i, "error" if i % 2 else "info", "s", "x failed" if i % 2 else "all good here") for i in range(7)]
    summary = C.cluster_summary(C.cluster_exact(make_entries(rows)))
    assert [r["count"] for r in C.list_clusters(summary).collect()] == [4, 3]
    assert [r["template"] for r in C.top_errors(summary).collect()] == ["x failed"]
    stats = C.cluster_stats(summary).first()
    assert (stats["total_clusters"], stats["total_entries"], stats["by_level"]) == (2, 7, {"error": 3, "info": 4})
    prefix = summary.first()["cluster_id"][:6]
    assert C.find_cluster(summary, prefix).first()["cluster_id"].startswith(prefix)


def test_fuzzy_entries_keep_their_fingerprint(make_entries):
    rows = [(0, 0, "error", "s", "connection to database lost"), (1, 1, "error", "s", "connection to databasf lost")]
    got = cluster_fuzzy(make_entries(rows)).orderBy("seq").collect()
    assert got[0]["cluster_id"] == got[1]["cluster_id"] == got[0]["fingerprint"] != got[1]["fingerprint"]


def test_plan_and_driver_do_not_grow_with_the_prefixes(spark):
    """Many prefixes leave as many scans in the plan as few, and their ends come from a fixed number of counts."""
    rows = [(f"{i:016x}", f"{i * 7919 % 100003:06d} request {i * 31337 % 99991:05d} of {i * 104729 % 100019:06d}", i) for i in range(240)]
    found = spark.createDataFrame(rows, "fingerprint string, template string, seq long")
    scans = []
    for options in ({"prefix_work": 2000, "smallest_prefix": 60}, {"prefix_work": 1, "smallest_prefix": 20}):
        plan = cluster_templates(found, **options)._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation "))
    assert scans[0] == scans[1]

    from tracewell.operators.fuzzy import _bound

    # Nearly all rows lie in the first of the cells, so it is looked into again.
    crowded = spark.range(5000).select(F.when(F.col("id") < 4990, F.col("id")).otherwise(F.col("id") * 10**12).cast("double").alias("_position"))
    for count in (1, 40, 700, 5000):
        assert count / 2 <= crowded.where(F.col("_position") <= _bound(crowded, count)).count() <= 2 * count
