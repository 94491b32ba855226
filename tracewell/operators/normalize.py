"""From raw lines to canonical entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.fingerprint import fingerprint_of_template, template
from tracewell.functions.formats import detect_format
from tracewell.functions.levels import level_rank
from tracewell.operators.parsers import (
    compile_templates, only_parsed, parse_custom, parse_json, parse_kv, parse_plaintext,
)
from tracewell.session import configure
from tracewell.schema import ENTRIES

BROADCAST_SOURCES = 200_000


def with_source_hints(lines: DataFrame, sources: DataFrame | None, hint: str = "parser_hint") -> DataFrame:
    """Add the parser hint of each line's source.

    The sources with a hint are counted first and broadcast up to
    ``BROADCAST_SOURCES``; beyond that the lines are joined by shuffle.
    """
    if sources is None:
        return lines if hint in lines.columns else lines.withColumn(hint, F.lit(None).cast("string"))
    hints = sources.where(F.col("parser_hint").isNotNull()).select("source_id", F.col("parser_hint").alias(hint))
    hints = hints.dropDuplicates(["source_id"])
    if hints.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        hints = F.broadcast(hints)
    return lines.drop(hint).join(hints, "source_id", "left")


def parse_lines(
    lines: DataFrame,
    templates=(),
    line: str = "value",
    on_malformed: str = "drop",
    unwrap_container: bool = False,
    extra=(),
) -> DataFrame:
    """Add ``detected_format`` and the struct ``parsed`` to every accepted line.

    A line of a source with a parser hint goes to that template first; a line no
    template fits, and every other line, is routed by its detected format.

    ``on_malformed``: ``"drop"`` leaves out ``{...}`` lines that are not JSON,
    ``"plaintext"`` treats them as free text. ``unwrap_container`` parses the
    line inside a container envelope once more as free text. ``extra`` holds functions
    ``(df, line, out) -> df`` that add a struct column like the built-in parsers
    and are asked before them.
    """
    if on_malformed not in ("drop", "plaintext"):
        raise ValueError("on_malformed must be 'drop' or 'plaintext'")
    df = lines.withColumn("detected_format", detect_format(F.col(line)))
    candidates = []
    for i, compiled in enumerate(compile_templates(templates).values()):
        df = parse_custom(df, compiled, line, f"_custom{i}", when=F.col("parser_hint") == compiled.id)
        candidates.append(f"_custom{i}")
    for i, parser in enumerate(extra):
        df = parser(df, line, f"_extra{i}")
        candidates.append(f"_extra{i}")
    taken = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in candidates]) if candidates else F.lit(False)
    detected = F.col("detected_format")
    df = parse_json(df, line, "_json", when=(detected == "json") & ~taken)
    df = parse_kv(df, line, "_kv", when=(detected == "key_value") & ~taken)
    as_text = ~detected.isin("json", "key_value")
    if on_malformed == "plaintext":
        as_text = as_text | ((detected == "json") & F.col("_json").isNull())
    df = parse_plaintext(df, line, "_text", when=as_text & ~taken)
    if unwrap_container:
        df = df.withColumn("_inner", F.when(F.col("_json.format") == "docker", F.col("_json.message")))
        df = parse_plaintext(df, "_inner", "_unwrapped")
        df = df.withColumn(
            "_json",
            F.when(
                F.col("_unwrapped").isNotNull(),
                F.struct(
                    F.coalesce("_unwrapped.timestamp", "_json.timestamp").alias("timestamp"),
                    F.col("_unwrapped.level").alias("level"), F.col("_unwrapped.service").alias("service"),
                    F.col("_unwrapped.message").alias("message"), F.col("_json.fields").alias("fields"),
                    F.col("_json.format").alias("format"),
                ),
            ).otherwise(F.col("_json")),
        ).drop("_inner", "_unwrapped")
    parts = [*candidates, "_json", "_kv", "_text"]
    return only_parsed(df.withColumn("parsed", F.coalesce(*parts)).drop(*parts))


def entry_id(*parts) -> Column:
    """Stable identity of a line, equal on every rerun."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(p).cast("string") for p in parts]), 256)


def normalize_lines(lines: DataFrame, sources: DataFrame | None = None, templates=(), line: str = "value", **options) -> DataFrame:
    """Canonical entries of assembled lines, with fingerprint and template.

    Expects ``source_id, file, line_no, value, ingested_at`` and, if the lines
    were assembled, ``stacktrace``. Where a line carries no time, ``timestamp`` is
    the time of ingestion and ``ts_source`` says so. ``cluster_id`` is the
    fingerprint; fuzzy clustering replaces it.
    """
    configure(lines.sparkSession)
    df = with_source_hints(lines, sources)
    for name, kind in (("source_label", "string"), ("stacktrace", "array<string>")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.col("line_no"))
    return canonical_entries(parse_lines(df, templates, line, **options), line)


def canonical_entries(df: DataFrame, line: str) -> DataFrame:
    """Entries of parsed lines: ``source_id, source_label, file, line_no, seq, ingested_at, stacktrace, detected_format``,
    the line itself and the struct ``parsed`` of the line parsers."""
    p = F.col("parsed")
    df = df.select(
        entry_id("source_id", "file", "line_no").alias("id"),
        "source_id", F.coalesce("source_label", "source_id").alias("source_label"), "seq",
        F.coalesce(p["timestamp"], F.col("ingested_at")).alias("timestamp"),
        F.when(p["timestamp"].isNotNull(), "line").otherwise("ingest").alias("ts_source"),
        p["level"].alias("level"), p["service"].alias("service"), p["message"].alias("message"),
        "stacktrace", p["fields"].alias("fields"), F.col(line).alias("raw"), p["format"].alias("format"),
        "detected_format", "ingested_at",
    )
    df = df.withColumn("level_rank", level_rank(F.col("level"))).withColumn("template", template(F.col("message")))
    df = df.withColumn("fingerprint", fingerprint_of_template(F.col("template")))
    return df.withColumn("cluster_id", F.col("fingerprint")).select(*ENTRIES.names)
