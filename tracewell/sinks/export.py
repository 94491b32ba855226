"""Exports of the newest entries as a JSON or Markdown document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.levels import level_label
from tracewell.operators.explain import iso_utc
from tracewell.operators.queries import EntryFilter, filter_entries, page
from tracewell.sources.files import numbered_lines

EXPORT_ENTRIES = 5_000
MARKDOWN_ROWS = 500
MESSAGE_SHOWN = 120
# The words of the Markdown document.
MARKDOWN_TITLE = "# Log Export"


def export_selection(entries: DataFrame, levels=None, limit: int = EXPORT_ENTRIES) -> DataFrame:
    """The newest entries, optionally of some levels only."""
    return page(filter_entries(entries, EntryFilter(levels=tuple(levels) if levels else None)), limit)


def _json_text(entries: DataFrame) -> Column:
    times = ("timestamp", "ingested_at")
    values = [iso_utc(F.col(c)).alias(c) if c in times else F.col(c) for c in entries.columns]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def export_json_rows(entries: DataFrame) -> DataFrame:
    """One JSON text per entry, for exports of any size (``write.text``)."""
    return entries.select("id", _json_text(entries).alias("json"))


def export_json(selection: DataFrame, exported_at: str, summary: DataFrame | None = None) -> DataFrame:
    """One document with ``exported_at, entry_count, ai_summary, entries``.

    The selection is at most a few thousand rows (see :func:`export_selection`).
    """
    ranked = selection.select(F.struct(F.col("timestamp"), F.col("id")).alias("_order"), "*")
    rows = export_json_rows(selection).join(ranked.select("id", "_order"), "id")
    document = rows.agg(
        F.count("*").alias("entry_count"),
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_order", "json")))), lambda r: r["json"]), ",").alias("_entries"),
    )
    if summary is None:
        document = document.withColumn("_summary", F.lit("null"))
    else:
        one = summary.limit(1).select(F.to_json(F.struct("*")).alias("_summary"), F.lit(1).alias("_one"))
        document = document.withColumn("_one", F.lit(1)).join(one, "_one", "left").fillna({"_summary": "null"})
    return document.select(
        F.concat(
            F.lit('{"exported_at":"' + exported_at + '","entry_count":'), F.col("entry_count").cast("string"),
            F.lit(',"ai_summary":'), F.col("_summary"), F.lit(',"entries":['), F.col("_entries"), F.lit("]}"),
        ).alias("document")
    )


def _table_line(message_shown: int) -> Column:
    message = F.replace(F.substring("message", 1, message_shown), F.lit("|"), F.lit("\\|"))
    return F.concat(
        F.lit("| "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level_label(F.col("level")),
        F.lit(" | "), F.coalesce("service", F.lit("-")), F.lit(" | "), message, F.lit(" |"),
    )


def export_markdown_rows(entries: DataFrame, rows: int = MARKDOWN_ROWS, message_shown: int = MESSAGE_SHOWN) -> DataFrame:
    """Table rows of the newest entries: ``rank, line``."""
    return page(entries, rows).select("timestamp", "id", _table_line(message_shown).alias("line"))


def export_markdown(
    selection: DataFrame, exported_at: str, summary: DataFrame | None = None, rows: int = MARKDOWN_ROWS,
    message_shown: int = MESSAGE_SHOWN,
) -> DataFrame:
    """One Markdown document of a selection of at most a few thousand entries.

    ``summary`` may hold one row with ``overview, key_issues, recommendations``.
    """
    total = selection.agg(F.count("*").alias("total"), F.lit(1).alias("_one"))
    table = export_markdown_rows(selection, rows, message_shown).agg(
        F.transform(
            F.reverse(F.array_sort(F.collect_list(F.struct("timestamp", "id", "line")))), lambda r: r["line"]
        ).alias("lines"), F.lit(1).alias("_one"),
    )
    parts = total.join(table, "_one")
    if summary is not None:
        parts = parts.join(summary.limit(1).select("overview", "key_issues", "recommendations", F.lit(1).alias("_one")), "_one", "left")

        def listing(title: str, column: str):
            items = F.array_join(F.transform(column, lambda x: F.concat(F.lit("- "), x)), "\n")
            return F.when(F.size(column) > 0, F.concat(F.lit(f"### {title}\n\n"), items, F.lit("\n\n")))

        block = F.when(
            F.col("overview").isNotNull(),
            F.concat_ws("", F.lit("## AI Summary\n\n"), F.col("overview"), F.lit("\n\n"),
                        listing("Key Issues", "key_issues"), listing("Recommendations", "recommendations")),
        )
    else:
        block = F.lit(None).cast("string")
    more = F.when(
        F.col("total") > rows,
        F.concat(F.lit("\n_... and "), (F.col("total") - rows).cast("string"), F.lit(" more entries_\n")),
    )
    return parts.select(
        F.concat_ws(
            "", F.lit(f"{MARKDOWN_TITLE}\n\n**Exported:** {exported_at}  \n**Entries:** "), F.col("total").cast("string"),
            F.lit("\n\n"), block,
            F.lit("## Log Entries\n\n| Timestamp | Level | Service | Message |\n|-----------|-------|---------|--------|\n"),
            F.array_join("lines", "\n"), F.lit("\n"), more,
        ).alias("document")
    )


def _sections(rows: DataFrame, above: list[Column], below: list[Column]) -> DataFrame:
    """``section, timestamp, id, line``: the rows with single lines above and below them, which may use their number ``n``."""
    lines = [(i - len(above), line) for i, line in enumerate(above)] + [(i + 1, line) for i, line in enumerate(below)]
    single = F.explode(F.array(*[F.struct(F.lit(section).alias("section"), line.alias("line")) for section, line in lines]))
    frame = rows.agg(F.count("*").cast("string").alias("n")).select(single.alias("at")).select(
        "at.section", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("id"), "at.line")
    return rows.select(F.lit(0).alias("section"), "timestamp", "id", "line").unionByName(frame)


def json_lines(entries: DataFrame, exported_at: str) -> DataFrame:
    """``section, timestamp, id, line``: the JSON document of :func:`export_json` line by line, for any number of entries."""
    newest = entries.orderBy(F.col("timestamp").desc(), F.col("id").asc()).select("id").first()
    comma = F.when(F.col("id") == F.lit(newest["id"] if newest else None), F.lit("")).otherwise(F.lit(","))
    rows = entries.select("timestamp", "id", F.concat(comma, _json_text(entries)).alias("line"))
    head = F.concat(F.lit('{"exported_at":"' + exported_at + '","entry_count":'), F.col("n"), F.lit(',"ai_summary":null,"entries":['))
    return _sections(rows, [head], [F.lit("]}")])


def markdown_lines(entries: DataFrame, exported_at: str, message_shown: int = MESSAGE_SHOWN) -> DataFrame:
    """``section, timestamp, id, line``: the Markdown document with all entries in its table, line by line."""
    rows = entries.select("timestamp", "id", _table_line(message_shown).alias("line"))
    above = [
        F.lit(MARKDOWN_TITLE), F.lit(""), F.lit(f"**Exported:** {exported_at}  "), F.concat(F.lit("**Entries:** "), "n"), F.lit(""),
        F.lit("## Log Entries"), F.lit(""), F.lit("| Timestamp | Level | Service | Message |"), F.lit("|-----------|-------|---------|--------|")]
    return _sections(rows, above, [])


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a document as text files whose names are in the order of their content: together they are the document."""
    ordered = lines.orderBy("section", F.col("timestamp").desc(), F.col("id").asc())
    ordered.select("line").write.mode("overwrite").text(path)


def read_lines(spark, path: str) -> DataFrame:
    """``line_no, line`` of a document that :func:`write_lines` has written."""
    from pyspark.sql import Window as W

    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    numbered = numbered_lines(raw)
    # One row for each file.
    sizes = numbered.groupBy("file").agg(F.count("*").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset"))
    return numbered.join(offsets, "file").select((F.col("line_no") + F.col("offset")).alias("line_no"), F.col("value").alias("line"))


def export_all(entries: DataFrame, output: str, exported_at: str, levels=None) -> None:
    """Write all entries, newest first, as the parts of one Markdown (``output`` ends in ``.md``) or JSON document."""
    chosen = filter_entries(entries, EntryFilter(levels=tuple(levels) if levels else None))
    write_lines(markdown_lines(chosen, exported_at) if output.endswith(".md") else json_lines(chosen, exported_at), output)


def export(
    entries: DataFrame, output: str, exported_at: str, levels=None, summary: DataFrame | None = None,
    limit: int = EXPORT_ENTRIES, **markdown_options,
) -> None:
    """Write the newest ``limit`` entries: Markdown if ``output`` ends in ``.md``, else JSON."""
    selection = export_selection(entries, levels, limit)
    if output.endswith(".md"):
        document = export_markdown(selection, exported_at, summary, **markdown_options)
    else:
        document = export_json(selection, exported_at, summary)
    document.coalesce(1).write.mode("overwrite").text(output)
