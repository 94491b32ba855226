"""A positional full-text index that grows with the stored entries.

A row is one occurrence of a word: ``date, token, column, id, position``. Each batch of entries adds
its own folder, written once; within it files are sorted by word, so a look-up reads the row
groups and pages of its words only, and dates prune as they do in the entries. A frequent word is
spread over the files of its entries; a compacted index has ranges of words as files. Words that must follow each other meet by the position at which
their run would start, so a phrase is one scan and one grouping, without joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.functions.text import fold_column, words_of
from tracewell.operators.queries import SEARCH_COLUMNS
from tracewell.sinks.tables import write_once

INDEX = ["token", "column", "id", "position", "date"]


def _placed(column: str):
    return lambda token, i: F.struct(token.alias("token"), F.lit(column).alias("column"), i.cast("int").alias("position"))


def occurrences(entries: DataFrame, columns=SEARCH_COLUMNS) -> DataFrame:
    """``token, column, id, position, date`` of every word of every entry; made row by row, without a shuffle."""
    per_column = []
    for column in columns:
        tokens = F.filter(F.split(fold_column(F.col(column)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        per_column.append(F.transform(tokens, _placed(column)))
    flat = F.flatten(F.array_compact(F.array(*per_column)))
    return entries.select("id", F.to_date("timestamp").alias("date"), F.inline(flat)).select(*INDEX)


def add_to_index(entries: DataFrame, path: str, batch: int, columns=SEARCH_COLUMNS) -> None:
    """Write the words of a batch of new entries; a repeated batch changes nothing.

    Words are cut, sorted and written where their entries are. Ranges of words over all files would have the
    text cut twice, the first time to find the ranges, and every word shuffled.
    """
    found = occurrences(entries, columns).sortWithinPartitions("date", "token", "id")
    write_once(found, f"{path}/batch={batch}", "date")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def compact_index(index: DataFrame, path: str) -> None:
    """Rewrite an index of many small batches as the one batch of another index."""
    write_once(index.repartitionByRange("date", "token", "id").sortWithinPartitions("date", "token", "id"), f"{path}/batch=0", "date")


def _runs(index: DataFrame, words: list[str], last_is_prefix: bool) -> DataFrame:
    """``id, column, start`` of every place where the words follow each other."""
    last = len(words) - 1
    fits = lambda i: F.col("token").startswith(words[i]) if last_is_prefix and i == last else F.col("token") == words[i]
    # The places in the phrase that a word can take: several, if the phrase repeats it.
    offsets = F.array_compact(F.array(*[F.when(fits(i), F.lit(i)) for i in range(len(words))]))
    found = index.where(reduce(lambda a, b: a | b, [fits(i) for i in range(len(words))]))
    if last == 0:
        return found.select("id", "column", F.col("position").alias("start"))
    placed = found.select("id", "column", "position", F.explode(offsets).alias("offset"))
    whole = placed.groupBy("id", "column", (F.col("position") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("n"))
    return whole.where(F.col("n") == len(words)).select("id", "column", "start")


def index_matches(index: DataFrame, all_of: str = "", any_of: str = "", phrase: str = "", prefix: str = "", columns=None) -> DataFrame:
    """``id, occurrences`` of the entries that meet all given conditions, as
    :func:`tracewell.operators.queries.search_condition` defines them, from the index alone.

    ``occurrences`` counts the words and runs that were asked for, for ranking.
    """
    here = index if columns is None else index.where(F.col("column").isin(*columns))
    parts = [_runs(here, [word], False) for word in dict.fromkeys(words_of(all_of))]
    either = list(dict.fromkeys(words_of(any_of)))
    if either:
        parts.append(here.where(F.col("token").isin(*either)).select("id", "column", F.col("position").alias("start")))
    if words_of(phrase):
        parts.append(_runs(here, words_of(phrase), False))
    if words_of(prefix):
        parts.append(_runs(here, words_of(prefix), True))
    if not parts:
        raise ValueError("a search needs at least one word")
    marked = reduce(DataFrame.unionByName, [p.select("id", F.lit(i).alias("part")) for i, p in enumerate(parts)])
    # Counted by condition before they meet, so a frequent word is reduced on the map side.
    counted = marked.groupBy("id", "part").agg(F.count("*").alias("n")).groupBy("id").agg(
        F.count("*").alias("parts"), F.sum("n").alias("occurrences"))
    return counted.where(F.col("parts") == len(parts)).select("id", "occurrences")


def search_index(index: DataFrame, entries: DataFrame, none_of: str = "", condition: Column | None = None, **terms) -> DataFrame:
    """Entries that meet a full-text condition, found through the index.

    ``condition`` on the entries, such as a time range, applies to them; one on ``date`` prunes the index too
    if both have that column.
    """
    columns = terms.get("columns")
    hits = index_matches(index, **terms)
    unwanted = words_of(none_of)
    if unwanted:
        here = index if columns is None else index.where(F.col("column").isin(*columns))
        hits = hits.join(here.where(F.col("token").isin(*unwanted)).select("id"), "id", "left_anti")
    chosen = entries if condition is None else entries.where(condition)
    return chosen.join(hits.select("id"), "id", "left_semi")
