"""Parser plugins that keep state between the lines of a file.

A plugin gets the lines of a file one by one and gives an entry whenever one is complete.
It runs as a table function over partitions of ordered lines. A plugin that says how
the lines look at which an entry begins is run on chunks of a file side by side: a chunk
starts at its first such line and takes the lines up to the next chunk's first one. One that
cannot say so reads each file as one partition, in a stream.
"""

from __future__ import annotations

import sys
from abc import ABC, abstractmethod
from collections import deque
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import udtf

from tracewell.functions.levels import parse_level
from tracewell.functions.times import rfc3339
from tracewell.operators.assemble import CHUNK_LINES, _run_targets, merge_stacktraces
from tracewell.operators.normalize import canonical_entries, normalize_lines

KEYS = ["source_id", "file"]
FOUND = ("source_id string, file string, line_no long, source_label string, ingested_at timestamp_ntz, timestamp string, level string, service string, "
         "message string, fields string, format string, raw string, stacktrace array<string>")


class ParserPlugin(ABC):
    """A parser of one file or chunk. ``begins`` is a Java regular expression for the lines at which an entry begins and
    nothing of the lines before is needed; None if there is no such line."""

    id: str
    begins: str | None = None

    @classmethod
    def can_handle(cls, source: dict) -> bool:
        """Should lines of this source (a row of the source table) go to this plugin if no hint names another one?"""
        return False

    @abstractmethod
    def push_line(self, line: str, line_no: int) -> dict | None:
        """Take the next line; the entry that is complete now, if any.

        An entry has ``line_no`` (of its first line) and ``message`` and may have ``timestamp`` (a text in RFC 3339 or a
        datetime), ``level``, ``service``, ``fields`` (JSON text), ``format``, ``raw`` and ``stacktrace``.
        """

    def flush(self) -> dict | None:
        """The entry that is still open at the end."""
        return None


class PluginRegistry:
    """Plugins by id, asked in the order in which they were registered."""

    def __init__(self, *plugins: type[ParserPlugin]):
        self.plugins: dict[str, type[ParserPlugin]] = {}
        for plugin in plugins:
            self.register(plugin)

    def register(self, plugin: type[ParserPlugin]) -> None:
        # Executors need no copy of the module that defines the plugin.
        module = sys.modules.get(plugin.__module__)
        if module is not None and plugin.__module__ != "__main__":
            cloudpickle.register_pickle_by_value(module)
        self.plugins[plugin.id] = plugin

    def create(self, plugin_id: str) -> ParserPlugin:
        return self.plugins[plugin_id]()

    def detect(self, source: dict) -> str | None:
        """Id of the plugin for a source: the one its ``parser_hint`` names, else the first that can handle it."""
        if source.get("parser_hint") in self.plugins:
            return source["parser_hint"]
        return next((i for i, plugin in self.plugins.items() if plugin.can_handle(source)), None)

    def choose(self, sources: DataFrame) -> dict[str, str]:
        """Plugin by source for a source table, which is configuration and read on the driver."""
        found = {row["source_id"]: self.detect(row.asDict(recursive=True)) for row in sources.collect()}
        return {source: plugin for source, plugin in found.items() if plugin is not None}


def _time(value) -> str | None:
    if isinstance(value, datetime):
        value = value if value.tzinfo is None else value.astimezone(timezone.utc).replace(tzinfo=None)
        return value.isoformat() + "Z"
    return value


def _runner(registry: PluginRegistry):
    plugins = registry.plugins

    class RunPlugin:
        def __init__(self):
            self.plugin, self.row, self.open = None, None, deque()

        def _out(self, entry: dict) -> tuple:
            while len(self.open) > 1 and self.open[0][0] < entry["line_no"]:
                self.open.popleft()
            _, arrived, value = self.open[0]
            return (*self.row, entry["line_no"], self.label, arrived, _time(entry.get("timestamp")), entry.get("level"), entry.get("service"),
                    entry.get("message"), entry.get("fields"), entry.get("format"), entry.get("raw", value), entry.get("stacktrace") or None)

        def eval(self, row):
            if self.plugin is None:
                self.plugin, self.row, self.label = plugins[row["plugin"]](), (row["source_id"], row["file"]), row["source_label"]
            # Lines since the last entry, to know when and as what the next one's first line arrived.
            self.open.append((row["line_no"], row["ingested_at"], row["value"]))
            entry = self.plugin.push_line(row["value"], row["line_no"])
            if entry is not None:
                yield self._out(entry)

        def terminate(self):
            entry = self.plugin.flush() if self.plugin is not None else None
            if entry is not None:
                yield self._out(entry)

    return udtf(RunPlugin, returnType=FOUND)


def _units(lines: DataFrame, registry: PluginRegistry, chunk_lines: int) -> DataFrame:
    """Add ``unit``: the chunk whose plugin run takes the line."""
    begins = F.lit(False)
    chunked = [i for i, p in registry.plugins.items() if p.begins is not None]
    for plugin_id in chunked:
        begins = F.when(F.col("plugin") == plugin_id, F.col("value").rlike(registry.plugins[plugin_id].begins)).otherwise(begins)
    chunk = F.expr(f"line_no div {chunk_lines}")
    split = lines.where(F.col("plugin").isin(chunked))
    # The entry that is open where a chunk starts, and the first entry of the chunk.
    targets = _run_targets(split, KEYS, "line_no", begins, chunk)
    firsts = split.groupBy(*KEYS, chunk.alias("_chunk")).agg(F.min(F.when(begins, F.col("line_no"))).alias("_begin"))
    placed = split.withColumn("_chunk", chunk).join(targets, [*KEYS, "_chunk"]).join(firsts, [*KEYS, "_chunk"])
    own = F.col("line_no") >= F.col("_begin")
    unit = F.when(own, F.col("_chunk")).otherwise(F.coalesce(F.expr(f"_target div {chunk_lines}"), F.lit(-1)))
    whole = lines.where(~F.col("plugin").isin(chunked)).withColumn("unit", F.lit(0).cast("long"))
    return placed.withColumn("unit", unit.cast("long")).drop("_chunk", "_target", "_begin").unionByName(whole)


def plugin_entries(lines: DataFrame, chosen: dict[str, str], registry: PluginRegistry, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Canonical entries of the lines of the sources in ``chosen`` (source: plugin).

    Lines are raw, as they are read: a plugin joins what belongs together itself. Lines of other sources are
    left out.
    """
    if not chosen:
        return canonical_entries(_parsed(lines.sparkSession.createDataFrame([], FOUND)), "raw")
    table = lines.sparkSession.createDataFrame(sorted(chosen.items()), "source_id string, plugin string")
    label = F.col("source_label") if "source_label" in lines.columns else F.lit(None).cast("string")
    mine = lines.join(table, "source_id").select(*KEYS, "line_no", "value", label.alias("source_label"), "ingested_at", "plugin")
    units = _units(mine, registry, chunk_lines)
    found = _runner(registry)(units.asTable().partitionBy(*KEYS, "unit").orderBy("line_no"))
    return canonical_entries(_parsed(found), "raw")


def _parsed(found: DataFrame) -> DataFrame:
    parsed = F.struct(
        rfc3339(F.col("timestamp")).alias("timestamp"), F.coalesce(parse_level(F.col("level")), F.lit("unknown")).alias("level"), F.col("service"),
        F.coalesce("message", F.lit("")).alias("message"), F.coalesce("fields", F.lit("{}")).alias("fields"), F.coalesce("format", F.lit("unknown")).alias("format"))
    return found.select("*", parsed.alias("parsed"), F.lit("plugin").alias("detected_format"), F.col("line_no").alias("seq"))


def normalize_with_plugins(lines: DataFrame, sources: DataFrame, registry: PluginRegistry, templates=(), chunk_lines: int = CHUNK_LINES, **options) -> DataFrame:
    """Canonical entries of raw lines: sources that a plugin takes go to it, all others are assembled and normalised."""
    chosen = registry.choose(sources)
    table = lines.sparkSession.createDataFrame(sorted(chosen.items()), "source_id string, plugin string")
    rest = merge_stacktraces(lines.join(table, "source_id", "left_anti"))
    return normalize_lines(rest, sources, templates, **options).unionByName(plugin_entries(lines, chosen, registry, chunk_lines))
