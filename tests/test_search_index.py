"""The positional index against the scan."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import queries as Q, search_index as I
from tracewell.sinks.tables import read_table
from tracewell.streaming.ingest import read_feed, store_batch, stream_feed

TEXTS = ["the end of the end", "The END", "of the", "Été à la fin", "end-of-line, the", "x", "the the the", "theatre of the absurd", ""]


@pytest.fixture
def entries(make_entries):
    return make_entries([(i, i * 50_000.0, "error", f"end{i % 2}", t) for i, t in enumerate(TEXTS)])


@pytest.mark.parametrize("terms", [
    {"phrase": "the end"}, {"phrase": "the the"}, {"phrase": "end of the end"}, {"prefix": "th"}, {"prefix": "of th"}, {"all_of": "the end"},
    {"any_of": "x fin", "all_of": "à"}, {"phrase": "of the", "prefix": "abs"}, {"all_of": "the", "none_of": "of"}, {"any_of": "ete missing"}, {"phrase": "nowhere else"},
])
def test_index_finds_what_the_scan_finds(spark, entries, tmp_path, terms):
    path = str(tmp_path / "index")
    for batch in (0, 1):
        I.add_to_index(entries.where(F.col("seq") % 2 == batch), path, batch, ("message", "service"))
    for columns in (("message",), ("message", "service")):
        want = sorted(r.id for r in Q.search_entries(entries, columns=columns, **terms).collect())
        index = I.read_index(spark, path)
        assert sorted(r.id for r in I.search_index(index, entries, columns=columns, **terms).collect()) == want
    with pytest.raises(ValueError):
        I.index_matches(index)


def test_lookups_are_pushed_into_the_files(spark, entries, tmp_path):
    path = str(tmp_path / "index")
    I.add_to_index(entries, path, 0)
    index = I.read_index(spark, path)
    word = index.where(F.col("token") == "the")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,the)" in word
    dated = index.where("date = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in dated
    I.compact_index(index, str(tmp_path / "compact"))
    assert sorted(map(tuple, I.read_index(spark, str(tmp_path / "compact")).collect())) == sorted(map(tuple, index.select(
        *I.read_index(spark, str(tmp_path / "compact")).columns).collect()))


def test_feed_and_index_of_repeated_batches(spark, make_entries, tmp_path):
    from tracewell.operators.clusters import cluster_exact

    store = str(tmp_path / "store")
    e = cluster_exact(make_entries([(i, i * 1.0, "error", "s", f"boom {i}") for i in range(6)]))
    for batch, low in ((0, 0), (0, 0), (1, 3), (1, 3)):
        store_batch(e.where((F.col("seq") >= low) & (F.col("seq") < low + 4)), batch, store, feed=True, index_columns=("message",))
    assert read_table(spark, f"{store}/entries").count() == 6
    assert sorted((r.batch, r.seq) for r in read_feed(spark, store).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]
    assert [r.seq for r in read_feed(spark, store, after=0).orderBy("seq").collect()] == [4, 5]
    assert I.index_matches(I.read_index(spark, f"{store}/index"), "boom").count() == 6
    out = str(tmp_path / "out")
    stream_feed(spark, store).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_words_are_cut_once_and_stay_with_their_entries(spark, make_entries, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tracewell.operators import search_index as I

    entries = make_entries([(i, float(i), "info", "s", f"word{i % 7} the end") for i in range(400)])
    cut, counted = spark.sparkContext.accumulator(0), F.udf(lambda text: (cut.add(1), text)[1])
    I.add_to_index(entries.repartition(3).withColumn("message", counted("message")), str(tmp_path / "index"), 0, ("message",))
    assert cut.value == 400
    for file in (tmp_path / "index").rglob("*.parquet"):
        tokens = pq.ParquetFile(file).read(["token"]).column("token").to_pylist()
        assert tokens == sorted(tokens)
    assert I.index_matches(I.read_index(spark, str(tmp_path / "index")), "the").count() == 400
