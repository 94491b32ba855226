"""Message template and its stable fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewell.functions.text import trim_blank

# What is masked, in this order.
MASKS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*", "<TIMESTAMP>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
    (r"\b0x[0-9a-fA-F]{4,}\b", "<HEX>"),
    (r"/(?:tmp|var|home|users|root)/[^\s\"']+", "<PATH>"),
    (r"\b\d+\b", "<N>"),
)
FINGERPRINT_LENGTH = 16


def template(message: Column) -> Column:
    """Message with its variable parts masked."""
    for pattern, mask in MASKS:
        message = F.regexp_replace(message, "(?U)" + pattern, mask)
    return trim_blank(message)


def fingerprint_of_template(masked: Column) -> Column:
    # Declared not null: otherwise every join on it adds a null check to the scan,
    # which computes the whole fingerprint once more.
    return F.coalesce(F.substring(F.sha2(masked, 256), 1, FINGERPRINT_LENGTH), F.lit(""))


def fingerprint(message: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the template."""
    return fingerprint_of_template(template(message))
