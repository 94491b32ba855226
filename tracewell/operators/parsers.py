"""Line parsers.

Each ``parse_*`` adds one struct column ``out`` with the fields ``timestamp,
level, service, message, fields, format``; the struct is null where the parser
refuses the line. ``timestamp`` is null where the line carries no usable time.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.formats import KEY_VALUE, UNICODE
from tracewell.functions.levels import parse_level
from tracewell.functions.text import is_blank, trim_blank
from tracewell.functions.times import custom_time, rfc3339

log = logging.getLogger(__name__)

# Keys looked up in structured lines, in order of preference.
JSON_TIME_KEYS = ("timestamp", "time", "@timestamp", "ts", "datetime", "date")
JSON_LEVEL_KEYS = ("level", "severity", "lvl", "log_level", "loglevel")
JSON_MESSAGE_KEYS = ("message", "msg", "text", "body", "log", "event")
JSON_SERVICE_KEYS = ("service", "app", "logger")
KV_TIME_KEYS = ("time", "ts", "timestamp")
KV_LEVEL_KEYS = ("level", "lvl")
KV_MESSAGE_KEYS = ("msg", "message")
KV_SERVICE_KEYS = ("service", "app")

# Shapes looked for in free text.
TEXT_TIME = (
    r"^(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s*"
)
TEXT_TIME_SPACED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})"
TEXT_LEVEL = r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|CRIT)\b"
TEXT_SERVICE = r"\[([A-Za-z][\w\-.]{1,40})\]"
TEXT_EDGES = r"^[^\p{IsAlphabetic}\p{N}/.]+|[^\p{IsAlphabetic}\p{N}/.]+$"

_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _result(timestamp, level, service, message, fields, fmt) -> Column:
    as_column = lambda v, kind: (F.lit(v) if not isinstance(v, Column) else v).cast(kind)
    return F.struct(
        as_column(timestamp, "timestamp_ntz").alias("timestamp"),
        as_column(level, "string").alias("level"),
        as_column(service, "string").alias("service"),
        as_column(message, "string").alias("message"),
        as_column(fields, "string").alias("fields"),
        as_column(fmt, "string").alias("format"),
    )


def _line_if(line: Column, condition: Column | None) -> Column:
    return line if condition is None else F.when(condition, line)


def _last_index(reversed_keys: Column, key: str) -> Column:
    """Position of the last occurrence of ``key`` (keys come reversed), or null."""
    return F.nullif(F.array_position(reversed_keys, key), F.lit(0)).cast("int")


def only_parsed(df: DataFrame, out: str = "parsed") -> DataFrame:
    """Drop the rows a parser refused.

    An explode of zero or one structs rather than a filter: a filter would be
    pushed below the parsing projections and repeat their expressions there.
    """
    one = F.explode(F.when(F.col(out).isNotNull(), F.array(out))).alias(out)
    return df.select(*[c for c in df.columns if c != out], one)


def parse_json(df: DataFrame, line: str = "value", out: str = "parsed", when: Column | None = None) -> DataFrame:
    """Structured JSON lines and the container log envelope ``{"log": ...}``.

    A repeated key counts with its last value. Lines that are not one JSON
    object give null.
    """
    text = _line_if(F.col(line), when)
    # Inside brackets, anything behind the object makes the text invalid.
    objects = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", _STRICT_JSON)
    df = df.withColumn("_objects", objects)
    df = df.withColumn("_object", F.when(F.size("_objects") == 1, F.col("_objects")[0])).drop("_objects")
    df = df.withColumns({"_keys": F.reverse(F.map_keys("_object")), "_values": F.reverse(F.map_values("_object"))})
    as_string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    df = df.withColumn("_strings", F.transform("_values", as_string))
    keys, values = F.col("_keys"), F.col("_values")

    def string(key: str) -> Column:
        """Value of a key that holds a string, else null."""
        return F.try_element_at("_strings", _last_index(keys, key))

    def present(key: str) -> Column:
        return F.array_contains(keys, key)

    service = None
    for key in JSON_SERVICE_KEYS:
        service = F.when(present(key), string(key)) if service is None else service.when(present(key), string(key))
    inner = F.regexp_replace(string("log"), r"\n+\z", "")
    # try_parse_json refuses repeated keys; those lines keep the last of each.
    last_of_each = F.filter(
        F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.to_json(F.get(values, i)).alias("text"), i.alias("i"))),
        lambda e: F.array_position(keys, e["key"]) == e["i"] + 1,
    )
    rebuilt = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(
                F.array_sort(last_of_each),
                lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["text"]),
            ),
            ",",
        ),
        F.lit("}"),
    )
    fields = F.to_json(F.try_parse_json(text))
    plain = _result(
        F.get(F.array_compact(F.transform(F.array(*[string(k) for k in JSON_TIME_KEYS]), rfc3339)), F.lit(0)),
        parse_level(F.coalesce(*[string(k) for k in JSON_LEVEL_KEYS])),
        service,
        F.coalesce(*[string(k) for k in JSON_MESSAGE_KEYS], F.lit("")),
        F.coalesce(fields, rebuilt),
        "json",
    )
    envelope = _result(rfc3339(string("time")), "unknown", None, inner, "{}", "docker")
    parsed = F.when(F.col("_object").isNotNull(), F.when(inner.isNotNull(), envelope).otherwise(plain))
    return df.withColumn(out, parsed).drop("_object", "_keys", "_values", "_strings")


def parse_container_envelope(df: DataFrame, line: str = "value", out: str = "parsed") -> DataFrame:
    """Only the container envelope; other JSON gives null."""
    df = parse_json(df, line, out)
    return df.withColumn(out, F.when(F.col(out)["format"] == "docker", F.col(out)))


def parse_kv(df: DataFrame, line: str = "value", out: str = "parsed", when: Column | None = None) -> DataFrame:
    """``key=value`` and ``key="value"`` pairs; a repeated key counts with its last value."""
    text = F.col(line)
    some = ~is_blank(text) if when is None else (when & ~is_blank(text))
    pairs = F.lit(UNICODE + r"(\w+)=(?:\"([^\"]*)\"|(\S+))")
    source = F.when(some, text)
    groups = {"_keys": 1, "_quoted": 2, "_bare": 3}
    df = df.withColumns({n: F.reverse(F.regexp_extract_all(source, pairs, F.lit(g))) for n, g in groups.items()})
    keys = F.col("_keys")

    def value(key: str) -> Column:
        at = _last_index(keys, key)
        return F.concat(F.try_element_at("_quoted", at), F.try_element_at("_bare", at))

    def first_present(names) -> Column:
        # A value is null only where its key is absent.
        return F.coalesce(*[value(n) for n in names])

    entries = F.zip_with(
        keys, F.zip_with("_quoted", "_bare", lambda q, b: F.concat(q, b)),
        lambda k, v: F.struct(k.alias("key"), v.alias("value")),
    )
    # Pairs are in reverse order, so the first of each key is the one that counts.
    kept = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: F.array_position(keys, e["key"]) == e["i"] + 1,
    )
    fields = F.to_json(
        F.map_from_entries(
            F.transform(F.array_sort(kept), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        )
    )
    parsed = _result(
        rfc3339(first_present(KV_TIME_KEYS)),
        parse_level(first_present(KV_LEVEL_KEYS)),
        first_present(KV_SERVICE_KEYS),
        F.coalesce(first_present(KV_MESSAGE_KEYS), text),
        fields,
        "key_value",
    )
    return df.withColumn(out, F.when(some, parsed)).drop("_keys", "_quoted", "_bare")


def parse_plaintext(df: DataFrame, line: str = "value", out: str = "parsed", when: Column | None = None) -> DataFrame:
    """Leading time, first level word, first ``[service]`` and the remaining message."""
    text = F.col(line)
    some = ~is_blank(text) if when is None else (when & ~is_blank(text))
    # Each search is a column of its own: an expression that is used several times would be searched as often.
    df = df.withColumn("_line", F.when(some, text))
    df = df.withColumn("_head", F.regexp_extract("_line", UNICODE + TEXT_TIME, 0))
    df = df.withColumns({
        "_rest": F.expr("substring(_line, length(_head) + 1)"),
        "_time": trim_blank(F.col("_head")),
        "_spaced": F.regexp_extract("_line", TEXT_TIME_SPACED, 0),
    })
    rest = F.col("_rest")
    df = df.withColumn("_level", F.regexp_extract(rest, "(?iuU)" + TEXT_LEVEL, 1))
    without_level = F.when(F.col("_level") == "", rest).otherwise(F.regexp_replace(rest, r"(?isuU)^(.*?)" + TEXT_LEVEL, "$1"))
    df = df.withColumn("_without", without_level)
    df = df.withColumn("_message", F.regexp_replace("_without", TEXT_EDGES, ""))
    df = df.withColumn("_service", F.regexp_extract(rest, UNICODE + TEXT_SERVICE, 1))
    parsed = _result(
        F.coalesce(rfc3339(F.col("_time")), rfc3339(F.col("_spaced"))),
        parse_level(F.col("_level")),
        F.nullif(F.col("_service"), F.lit("")),
        F.when(F.col("_message") == "", trim_blank(rest)).otherwise(F.col("_message")),
        "{}",
        "plaintext",
    )
    return df.withColumn(out, F.when(F.col("_line").isNotNull(), parsed)).drop(
        "_line", "_head", "_rest", "_time", "_spaced", "_level", "_without", "_message", "_service")


@dataclass(frozen=True)
class LineTemplate:
    """User-defined line format with the optional named groups timestamp, level,
    service and message."""

    id: str
    name: str
    line_regex: str
    timestamp_format: str | None = None


@dataclass(frozen=True)
class CompiledTemplate:
    id: str
    pattern: str
    groups: dict
    timestamp_format: str | None


_NAMED_GROUP = re.compile(r"(?<!\\)\(\?P?<([A-Za-z_]\w*)>")


def compile_templates(templates) -> dict[str, CompiledTemplate]:
    """Templates by id. One with an invalid regex is skipped, the others still load."""
    out = {}
    for t in templates:
        try:
            groups = re.compile(_NAMED_GROUP.sub(r"(?P<\1>", t.line_regex)).groupindex
            if t.timestamp_format:
                custom_time(F.lit(""), t.timestamp_format)
        except (re.error, ValueError) as problem:
            log.warning("line template %r skipped: %s", t.id, problem)
            continue
        out[t.id] = CompiledTemplate(t.id, UNICODE + _NAMED_GROUP.sub("(", t.line_regex), dict(groups), t.timestamp_format)
    return out


def parse_custom(df: DataFrame, template: CompiledTemplate, line: str = "value", out: str = "parsed",
                 when: Column | None = None) -> DataFrame:
    """Lines that fit one user-defined template; the others give null."""
    text = F.col(line)
    fits = ~is_blank(text) & text.rlike(template.pattern)
    if when is not None:
        fits = when & fits

    def group(name: str) -> Column | None:
        number = template.groups.get(name)
        return None if number is None else F.regexp_extract(text, template.pattern, number)

    time, level, service, message = (group(n) for n in ("timestamp", "level", "service", "message"))
    parsed = _result(
        None if time is None else custom_time(time, template.timestamp_format),
        "unknown" if level is None else parse_level(level),
        None if service is None else F.nullif(service, F.lit("")),
        text if message is None else message,
        "{}",
        "unknown",
    )
    return df.withColumn(out, F.when(fits, parsed))
