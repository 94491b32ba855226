"""Parser plugins with state between lines."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tracewell.operators.plugins import ParserPlugin, PluginRegistry, normalize_with_plugins, plugin_entries

LINES = "source_id string, source_label string, file string, line_no long, value string, ingested_at timestamp_ntz"


class Numbered(ParserPlugin):
    """Entries begin with ``#n``; what follows belongs to them. An entry is given when the next one begins."""

    id = "numbered"
    begins = r"^#\d+"

    def __init__(self):
        self.held = None

    @classmethod
    def can_handle(cls, source):
        return source["label"].startswith("numbered")

    def push_line(self, line, line_no):
        done = None
        if line.startswith("#"):
            done, self.held = self.held, {"line_no": line_no, "level": "ERROR", "message": line, "timestamp": datetime(2026, 1, 1, 2, tzinfo=timezone.utc), "stacktrace": []}
        elif self.held:
            self.held["stacktrace"].append(line)
        return done

    def flush(self):
        return self.held


class Framed(ParserPlugin):
    """Entries end with a line ``.``, whatever they begin with; the rest of a file is given up."""

    id = "framed"

    def __init__(self):
        self.lines, self.first = [], None

    def push_line(self, line, line_no):
        if line == ".":
            lines, self.lines = self.lines, []
            return {"line_no": self.first, "message": " ".join(lines), "fields": '{"n":%d}' % len(lines), "service": "f"} if lines else None
        if not self.lines:
            self.first = line_no
        self.lines.append(line)
        return None


REGISTRY = PluginRegistry(Numbered, Framed)


def sources(spark):
    return spark.createDataFrame(
        [("n", "numbered one", None), ("f", "other", "framed"), ("p", "plain", None)], "source_id string, label string, parser_hint string")


def lines_of(spark, rows):
    return spark.createDataFrame([(s, s.upper(), f, n, v) for s, f, n, v in rows], "source_id string, source_label string, file string, line_no long, value string").withColumn(
        "ingested_at", F.lit("2026-02-02 00:00:00").cast("timestamp_ntz"))


def test_plugins_are_chosen_by_hint_then_by_source(spark):
    assert REGISTRY.choose(sources(spark)) == {"n": "numbered", "f": "framed"}
    assert REGISTRY.detect({"label": "numbered", "parser_hint": "framed"}) == "framed"
    assert REGISTRY.detect({"label": "x", "parser_hint": "unknown"}) is None
    assert isinstance(REGISTRY.create("framed"), Framed)


def test_chunks_of_a_file_give_what_one_run_gives(spark):
    values = ["lead", "#1 a", "x", "y"] + ["z"] * 25 + ["#2 b", "#3 c", "w"] + [f"#{i}" for i in range(4, 40)]
    rows = [("n", "a.log", i, v) for i, v in enumerate(values)] + [("n", "b.log", 0, "#1 other")]
    got = {}
    for chunk in (3, 10, 1000):
        found = plugin_entries(lines_of(spark, rows), {"n": "numbered"}, REGISTRY, chunk)
        got[chunk] = sorted((r.seq, r.message, r.stacktrace and len(r.stacktrace), r.level, str(r.timestamp), r.raw, r.source_label) for r in found.collect())
    assert got[3] == got[10] == got[1000] and len(got[3]) == 40
    assert got[3][0][:3] == (0, "#1 other", None)
    assert got[3][1] == (1, "#1 a", 27, "error", "2026-01-01 02:00:00", "#1 a", "N")


def test_whole_files_and_other_sources(spark):
    rows = [("f", "a", i, v) for i, v in enumerate(["one", "two", ".", ".", "three", ".", "open"])]
    rows += [("p", "b", 0, "2026-01-01T00:00:00Z ERROR boom"), ("p", "b", 1, "\tat x"), ("n", "c", 0, "no number")]
    found = {(r.source_id, r.seq): r for r in normalize_with_plugins(lines_of(spark, rows), sources(spark), REGISTRY).collect()}
    assert set(found) == {("f", 0), ("f", 4), ("p", 0)}
    assert (found["f", 0].message, found["f", 0].service, found["f", 0].fields, found["f", 0].level) == ("one two", "f", '{"n":2}', "unknown")
    assert str(found["f", 4].timestamp) == "2026-02-02 00:00:00" and found["f", 4].ts_source == "ingest"
    assert found["p", 0].stacktrace == ["\tat x"] and found["p", 0].detected_format == "plaintext"
    assert found["f", 0].id != found["f", 4].id and found["f", 0].fingerprint
    assert plugin_entries(lines_of(spark, rows), {}, REGISTRY).isEmpty()
