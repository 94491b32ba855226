import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions import formats, levels, text, times
from tracewell.functions.fingerprint import fingerprint, template


def evaluate(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("line,expected", [
    ("ERROR 2026-01-01T00:00:00Z connection refused to 10.0.0.1 for user a@b.ch", "2fa932c23d4ab7ce"),
    ("irgendeine Zeile", "c33ae813fa8fddd6"),
])
def test_golden_fingerprints(spark, line, expected):
    assert evaluate(spark, line, fingerprint) == expected


def test_fingerprint_ignores_variable_parts(spark):
    a = evaluate(spark, "Printer 10.1.2.3:631 is out of paper since 14 pages", fingerprint)
    assert a == evaluate(spark, "Printer 10.9.8.7:631 is out of paper since 2 pages", fingerprint)
    assert a != evaluate(spark, "Printer door is open", fingerprint)


@pytest.mark.parametrize("message,expected", [
    ("Parcel 0b9f7c2e-1d34-4a6b-9c88-12ab34cd56ef lost", "Parcel <UUID> lost"),
    (" at 0xdeadBEEF in /var/lib/x.db ", "at <HEX> in <PATH>"),
    ("x1 é5 5é 7", "x1 é5 5é <N>"),
    ("2026-01-01 10:00:00.5+01:00 up", "<TIMESTAMP> up"),
])
def test_templates(spark, message, expected):
    assert evaluate(spark, message, template) == expected


@pytest.mark.parametrize("line,expected", [
    ("\tat org.depot.Shelf.lift(Shelf.java:7)", True), ("    at org.depot.Crane.turn(Crane.java:3)", True),
    ("   3: 0x77fe01a - depot::crane::turn", True), ('  File "crane.py", line 9, in turn', True),
    ("at turn (crane.js:8:5)", True), ("Caused by: java.io.IOException", True), ("caused by: disk", True),
    ("note: run with", True), ("2025-05-05 ERROR the crane stands still", False), ('{"level":"error","msg":"crane stuck"}', False),
    ("at noon", False), (" x", False),
])
def test_continuation(spark, line, expected):
    assert evaluate(spark, line, formats.is_continuation) is expected


@pytest.mark.parametrize("line,expected", [
    (' {"a":1} ', "json"), ("{bad}", "json"), ('{"log":"open', "docker"), ("a=1", "key_value"), ("hello", "plaintext"),
    ('127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.1" 200 2326', "nginx"),
    ("Jan  1 00:00:00 host app[1]: x", "syslog"), ("größe=5", "key_value"),
])
def test_formats(spark, line, expected):
    assert evaluate(spark, line, formats.detect_format) == expected


@pytest.mark.parametrize("spelling,level,rank,score", [
    ("ERROR", "error", 4, 4), ("[warning]", "warn", 3, 3), ("i", "info", 2, 2), ("Crit", "fatal", 5, 5), ("dbg", "debug", 1, 1),
    ("trace", "trace", 0, 0), ("nonsense", "unknown", 6, 2), ("", "unknown", 6, 2),
])
def test_levels(spark, spelling, level, rank, score):
    row = evaluate(spark, spelling, lambda c: F.struct(
        levels.parse_level(c).alias("l"), levels.level_rank(levels.parse_level(c)).alias("r"),
        levels.level_score(levels.parse_level(c)).alias("s")))
    assert tuple(row) == (level, rank, score)


@pytest.mark.parametrize("value,expected", [
    ("2026-01-01T00:00:00Z", dt.datetime(2026, 1, 1)), ("2026-01-01T00:00:00.1234567+02:00", dt.datetime(2025, 12, 31, 22, 0, 0, 123456)),
    ("2026-01-01 00:00:00-00:30", dt.datetime(2026, 1, 1, 0, 30)), ("2026-01-01", None), ("2026-01-01T00:00:00", None),
    ("2026-13-01T00:00:00Z", None), ("2026-01-01T00:00:00+25:00", None), ("x", None),
])
def test_rfc3339(spark, value, expected):
    assert evaluate(spark, value, times.rfc3339) == expected


def test_rfc3339_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, "2026-03-08T07:30:00Z", times.rfc3339) == dt.datetime(2026, 3, 8, 7, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_custom_time(spark):
    assert evaluate(spark, "2026/07/13 10:00:00", lambda c: times.custom_time(c, "%Y/%m/%d %H:%M:%S")) == dt.datetime(2026, 7, 13, 10)
    assert evaluate(spark, "2026-07-13T10:00:00Z", lambda c: times.custom_time(c, "%Y/%m/%d %H:%M:%S")) == dt.datetime(2026, 7, 13, 10)
    with pytest.raises(ValueError):
        times.spark_pattern("%Q")


@pytest.mark.parametrize("value,words,found", [
    ("Café au lait", ["cafe"], True), ("CAFE", ["cafe"], True), ("cafes", ["cafe"], False), ("svc-a: up", ["svc", "a"], True),
    ("10.0.0.1", ["10", "0", "0", "1"], True), ("of, THE end", ["of", "the"], True), ("often the", ["of", "the"], False),
])
def test_word_search(spark, value, words, found):
    assert evaluate(spark, value, lambda c: c.rlike(text.word_regex(words))) is found


def test_folding_agrees_between_column_and_driver(spark):
    for word in ("Été", "ÅNGSTRÖM", "naïve", "Čeština", "plain"):
        assert evaluate(spark, word, text.fold_column) == text.fold(word)
