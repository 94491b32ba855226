"""Canonical schemas of the library."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, NTZ = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()
STRINGS = T.ArrayType(STR)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LINES = _schema(
    ("source_id", STR), ("source_label", STR), ("file", STR), ("line_no", LONG),
    ("value", STR), ("ingested_at", NTZ),
)

ENTRIES = _schema(
    ("id", STR), ("source_id", STR), ("source_label", STR), ("seq", LONG),
    ("timestamp", NTZ), ("ts_source", STR), ("level", STR), ("level_rank", INT),
    ("service", STR), ("message", STR), ("stacktrace", STRINGS), ("fields", STR),
    ("raw", STR), ("format", STR), ("detected_format", STR), ("fingerprint", STR),
    ("template", STR), ("cluster_id", STR), ("ingested_at", NTZ),
)

CLUSTERS = _schema(
    ("cluster_id", STR), ("fingerprint", STR), ("template", STR), ("level", STR),
    ("level_rank", INT), ("count", LONG), ("first_seen", NTZ), ("last_seen", NTZ),
    ("source_ids", STRINGS), ("sample_ids", STRINGS), ("services", STRINGS),
    ("ai_summary", STR),
)

SOURCES = _schema(
    ("source_id", STR), ("label", STR),
    ("kind", _schema(("type", STR), ("path", STR), ("pattern", STR), ("name", STR))),
    ("parser_hint", STR), ("enabled", T.BooleanType()), ("created_at", NTZ),
)

EXPLANATIONS = _schema(
    ("id", STR), ("entry_id", STR), ("created_at", NTZ), ("what", STR), ("why", STR),
    ("impact", STR), ("debug_steps", STRINGS), ("possible_causes", STRINGS),
    ("fix_suggestions", STRINGS), ("confidence", T.FloatType()), ("ai_provider", STR),
    ("model", STR),
)

FIX_STEP = _schema(
    ("step", INT), ("title", STR), ("description", STR), ("command", STR), ("code", STR),
)
