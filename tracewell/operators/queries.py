"""Filters, search, paging and views over entries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.levels import ERROR_RANK, at_least, level_label, level_rank
from tracewell.functions.text import fold_column, highlight, matches_of, word_regex, words_of

PAGE = 200
LIVE_ENTRIES = 5_000
TRACE_LINES_SHOWN = 5
SEARCH_COLUMNS = ("message", "service", "raw")


@dataclass(frozen=True)
class EntryFilter:
    """Conditions on entries; those left out do not restrict anything."""

    from_time: datetime | str | None = None
    to_time: datetime | str | None = None
    levels: tuple[str, ...] | None = None
    services: tuple[str, ...] | None = None
    source_ids: tuple[str, ...] | None = None
    pattern: str | None = None
    has_stacktrace: bool | None = None
    cluster_id: str | None = None


def _time(value) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def filter_entries(entries: DataFrame, f: EntryFilter | None = None, **conditions) -> DataFrame:
    """Entries that meet all conditions. Time bounds are inclusive.

    ``has_stacktrace`` restricts only when true. A stored table partitioned by
    ``date`` is pruned through the time bounds.
    """
    f = f or EntryFilter(**conditions)
    tests: list[Column] = []
    dated = "date" in entries.columns
    if f.from_time is not None:
        tests.append(F.col("timestamp") >= _time(f.from_time))
        if dated:
            tests.append(F.col("date") >= _time(f.from_time).cast("date"))
    if f.to_time is not None:
        tests.append(F.col("timestamp") <= _time(f.to_time))
        if dated:
            tests.append(F.col("date") <= _time(f.to_time).cast("date"))
    for column, allowed in (("level", f.levels), ("service", f.services), ("source_id", f.source_ids)):
        if allowed:
            tests.append(F.col(column).isin(*allowed))
    if f.pattern:
        tests.append(F.col("message").rlike(f.pattern))
    if f.has_stacktrace:
        tests.append(F.col("stacktrace").isNotNull())
    if f.cluster_id is not None:
        tests.append(F.col("cluster_id") == F.lit(f.cluster_id))
    return entries.where(reduce(lambda a, b: a & b, tests)) if tests else entries


def page(entries: DataFrame, limit: int = PAGE, offset: int = 0, descending: bool = True, tie: str = "id") -> DataFrame:
    """One page by time, newest first by default; ties by ``tie``."""
    order = F.col("timestamp").desc() if descending else F.col("timestamp").asc()
    ordered = entries.orderBy(order, F.col(tie).asc())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_counts(entries: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Total number of matches and the number of rows on the page."""
    total = entries.agg(F.count("*").alias("total_matches"))
    left = F.greatest(F.col("total_matches") - F.lit(offset), F.lit(0))
    return total.withColumn("returned", F.least(left, F.lit(limit)).cast("long"))


def matches_words(words: list[str], columns=SEARCH_COLUMNS, prefix: bool = False) -> Column:
    """Do the words, as one run, occur in any of the columns?"""
    pattern = word_regex(words, prefix)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns])


def search_condition(
    all_of: str | list[str] = (), any_of: str | list[str] = (), none_of: str | list[str] = (),
    phrase: str | None = None, prefix: str | None = None, columns=SEARCH_COLUMNS,
) -> Column:
    """Full-text condition. Case and accents are ignored, punctuation separates words.

    ``all_of`` words must all occur, in whichever column; ``any_of`` at least one;
    ``none_of`` none. ``phrase`` words must follow each other; ``prefix`` matches
    the beginning of a word.
    """
    words = lambda given: words_of(given if isinstance(given, str) else " ".join(given))
    parts: list[Column] = [matches_words([w], columns) for w in words(all_of)]
    either = [matches_words([w], columns) for w in words(any_of)]
    if either:
        parts.append(reduce(lambda a, b: a | b, either))
    parts += [~matches_words([w], columns) for w in words(none_of)]
    if phrase and words_of(phrase):
        parts.append(matches_words(words_of(phrase), columns))
    if prefix and words_of(prefix):
        parts.append(matches_words(words_of(prefix), columns, prefix=True))
    if not parts:
        raise ValueError("a search needs at least one word")
    return reduce(lambda a, b: a & b, parts)


def term_frequency(words: list[str], columns=SEARCH_COLUMNS) -> Column:
    """Number of occurrences of the words, for ranking."""
    counts = [F.size(matches_of(F.coalesce(F.col(c), F.lit("")), words)) for c in columns]
    return reduce(lambda a, b: a + b, counts)


def search_entries(entries: DataFrame, text: str | None = None, f: EntryFilter | None = None, **terms) -> DataFrame:
    """Entries that meet a full-text condition and, if given, a filter.

    ``text`` is short for ``all_of=text``. Page the result with :func:`page`.
    """
    if text is not None:
        terms["all_of"] = text
    return filter_entries(entries, f or EntryFilter()).where(search_condition(**terms))


def with_highlights(entries: DataFrame, text: str, column: str = "message") -> DataFrame:
    """Add the marked text and the list of matched snippets."""
    words = words_of(text)
    return entries.withColumn("highlighted", highlight(F.col(column), words)).withColumn(
        "highlights", matches_of(F.col(column), words)
    )


def build_token_index(entries: DataFrame, columns=SEARCH_COLUMNS) -> DataFrame:
    """Distinct ``(token, column, id)`` rows for repeated searches.

    Write it partitioned or bucketed by token. Deduplication happens inside each
    row, so no shuffle is needed.
    """
    per_column = []
    for column in columns:
        tokens = F.array_distinct(F.split(fold_column(F.col(column)), r"[^\p{L}\p{N}]+"))
        per_column.append(F.transform(tokens, lambda t, c=column: F.struct(t.alias("token"), F.lit(c).alias("column"))))
    flat = F.flatten(F.array_compact(F.array(*per_column)))
    return entries.select("id", F.inline(flat)).where(F.col("token") != "").select("token", "column", "id")


def search_token_index(index: DataFrame, entries: DataFrame, text: str) -> DataFrame:
    """Entries holding all words of ``text``, looked up through the token index."""
    words = words_of(text)
    hits = index.where(F.col("token").isin(*words)).groupBy("id").agg(F.count_distinct("token").alias("n"))
    return entries.join(hits.where(F.col("n") == len(words)).select("id"), "id", "left_semi")


def live_filter(entries: DataFrame, levels=(), substring: str = "", keep: int = LIVE_ENTRIES, order: str = "seq") -> DataFrame:
    """Level and substring filter over the newest ``keep`` entries by arrival."""
    newest = entries.orderBy(F.col(order).desc()).limit(keep)
    if levels:
        newest = newest.where(F.col("level").isin(*levels))
    if substring:
        newest = newest.where(F.contains(F.lower("message"), F.lower(F.lit(substring))))
    return newest


def watch_view(
    entries: DataFrame, min_level: str = "trace", unknown_passes: bool = True, trace_lines: int = TRACE_LINES_SHOWN
) -> DataFrame:
    """Console view: formatted time, label, service or ``-``, message, first trace lines."""
    shown = entries.where(at_least(F.col("level"), min_level, unknown_passes))
    return shown.select(
        "id", F.date_format("timestamp", "HH:mm:ss.SSS").alias("time"),
        level_label(F.col("level")).alias("level"), F.coalesce("service", F.lit("-")).alias("service"),
        "message", F.slice("stacktrace", 1, trace_lines).alias("stacktrace"),
    )


def errors_to_explain(entries: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """Entries at error or above without a stored explanation."""
    wanted = entries.where(level_rank(F.col("level")) >= ERROR_RANK)
    if explanations is None:
        return wanted
    return wanted.join(explanations.select(F.col("entry_id").alias("id")), "id", "left_anti")
