"""Time parsing. Results are ``timestamp_ntz`` columns in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.(\d+))?"
    r"(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
)

# Strftime directives and the matching Spark letters.
_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "j": "DDD", "b": "MMM",
    "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "H": "HH", "I": "hh", "p": "a",
    "M": "mm", "S": "ss", "f": "SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS",
    ".f": "[.SSSSSSSSS][.SSSSSS][.SSS]", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS",
    "T": "HH:mm:ss", "R": "HH:mm", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "%": "'%'",
}


def rfc3339(text: Column) -> Column:
    """UTC time of an RFC 3339 text with a zone; null for anything else."""
    fraction = F.regexp_extract(text, _RFC3339, 1)
    local = F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
        F.when(fraction != "", F.concat(F.lit("."), F.substring(fraction, 1, 6))).otherwise(""),
    ).try_cast("timestamp_ntz")
    sign = F.substring(text, -6, 1)
    shift = F.make_dt_interval(
        F.lit(0), F.substring(text, -5, 2).try_cast("int"), F.substring(text, -2, 2).try_cast("int"), F.lit(0)
    )
    return F.when(
        text.rlike(_RFC3339),
        F.when(sign == "+", local - shift).when(sign == "-", local + shift).otherwise(local),
    )


def spark_pattern(strftime: str) -> str:
    """Translate a strftime pattern; unknown directives raise ``ValueError``."""
    out, i = [], 0
    while i < len(strftime):
        char = strftime[i]
        if char == "%":
            for width in (3, 2, 1):
                key = strftime[i + 1 : i + 1 + width]
                if len(key) == width and key in _STRFTIME:
                    out.append(_STRFTIME[key])
                    i += 1 + width
                    break
            else:
                raise ValueError(f"unsupported time directive in {strftime!r}")
        else:
            out.append(f"'{char}'" if char.isalpha() else "''" if char == "'" else char)
            i += 1
    return "".join(out)


def custom_time(text: Column, strftime: str | None) -> Column:
    """Parse by pattern first, then as RFC 3339."""
    if not strftime:
        return rfc3339(text)
    pattern = spark_pattern(strftime)
    has_clock = ("HH" in pattern or "hh" in pattern) and "mm" in pattern
    if not has_clock:
        return rfc3339(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"), rfc3339(text))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC ``timestamp_ntz``."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")
