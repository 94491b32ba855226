"""Line classification: continuation lines and line formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewell.functions.text import trim_blank

# Shapes of lines that continue the entry above them.
CONTINUATIONS = (
    r"^\s{2,}",
    r"^\tat\s",
    r"^at\s+\S+\s*\(",
    r"^\s*File\s+\"",
    r"^\s*Caused\s+by:",
    r"^\s*\d+:\s+0x[0-9a-f]+\s+-\s+",
    r"^\s+\d+\)\s+0x[0-9a-f]+",
    r"^\s+\.\.\.\s+\d+\s+more",
    r"^note:",
    r"^caused\s+by:",
)

# Shapes of the recognised line formats.
NGINX = r"^\S+ - \S+ \[.+\] \".+\" \d{3} \d+"
SYSLOG = r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ \S+"
KEY_VALUE = r"\w+=(?:\"[^\"]*\"|\S+)"

UNICODE = "(?dU)"


def is_continuation(line: Column) -> Column:
    """Does the line belong to the stack trace of the line above?"""
    return line.rlike(UNICODE + "|".join(CONTINUATIONS))


def detect_format(line: Column) -> Column:
    """Name of the first format that fits the line."""
    text = trim_blank(line)
    return (
        F.when(text.startswith("{") & text.endswith("}"), "json")
        .when(text.rlike(UNICODE + NGINX), "nginx")
        .when(text.rlike(UNICODE + SYSLOG), "syslog")
        .when(text.startswith('{"log":'), "docker")
        .when(text.rlike(UNICODE + KEY_VALUE), "key_value")
        .otherwise("plaintext")
    )
