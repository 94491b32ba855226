"""The pipeline's stages, rule index and entry guard."""

import os
import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from tracewell.llm import urls

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, SF)
        assert docs_out.columns == docs.columns
        docs = docs_out
        sizes.append(docs.count())
    kept = corpus_pipeline.STAGES[0][1](spark, good.select(docs.columns), SF)
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    assert kept.count() >= 0.95 * good.where(words >= 60).count()
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[3]


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://Example.NET/en/x"), (2, "https://a.example.net/de/"), (3, "http://badexample.net/en/"), (4, "http://x.example.com/de/?q"),
        (5, "http://example.net"), (6, None), (7, "no scheme"), (8, "http://x.org/casino/1"), (9, "http://y.org/fr/casino"), (10, "http://x.org/?a#b"),
        (6, None), (11, "http://ads3.x.com/"), (12, "http://example.net/EN/"),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).fillna("-").collect())
    assert got == [
        (1, "example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/de/", "net/", "block"),
        (3, "badexample.net", "/en/", "net/", "block"), (4, "x.example.com", "/de/", "example.com/de/", "block"),
        (5, "example.net", "", "-", "allow"), (6, "", "", "-", "allow"), (6, "", "", "-", "allow"), (7, "", "", "-", "allow"),
        (8, "x.org", "/casino/1", "-", "block"), (9, "y.org", "/fr/casino", "org/fr/", "allow"), (10, "x.org", "/", "-", "allow"),
        (11, "ads3.x.com", "/", "-", "block"), (12, "example.net", "/EN/", "net/", "block"),
    ]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0


def test_stages_take_columns_of_any_name(spark):
    names = ["target", "source_size", "copies", "text_a", "text_b", "_id", "_stay", "_text_a", "_text_b", "_lang", "hash", "_hash", "_size", "_row", "one"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.createDataFrame([(10**9, "Ein " * 2_500_000, "de", "src0", 10**7)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.unionByName(long, allowMissingColumns=True).select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).isEmpty()
        assert not out.isEmpty()


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from tracewell.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, {sf!r}).count(), flush=True)
print("all done")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    names = ["op2_quality_rules", "op5_suffix_tree", "op6_near_duplicates", "op7_decontaminate", "op9_token_files", "op11_languages",
             "op12_conversation_repair", "op13_spelling_variants"]
    script = FOREIGN.format(repo=repo, shared=str(tmp_path / "shared"), names=names, sf=SF)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in run.stdout, run.stderr[-3000:]
