"""Stack traces of a stream, assembled by chunks of a file and stitched by a small state.

All lines of a micro-batch are dealt by chunks of line numbers, so one busy file keeps many
tasks busy. A chunk gives its complete entries at once; only the run of continuation lines at
its start and its last entry, two rows a chunk, go on to the state of the file. There an
open entry is held as a head and a list of trace lines until the next head arrives or
nothing came for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.formats import is_continuation
from tracewell.operators.assemble import CHUNK_LINES
from tracewell.session import configure

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECES = "source_id string, file string, part long, line_no long, value string, trace array<string>"
MERGED = "source_id string, file string, line_no long, value string, stacktrace array<string>"
# Part of the pieces that the state of a file stitches; complete entries keep the number of their chunk.
STITCHED = -1


class ChunkAssembler(StatefulProcessor):
    """Entries and loose ends of one chunk in one micro-batch. A chunk that goes on later has more loose ends then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source, file, chunk = key
        lines = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        numbers, values, continues = (lines[c].to_numpy() for c in ("line_no", "value", "continues"))
        heads = (~continues.astype(bool)).nonzero()[0].tolist()
        out = []
        first = heads[0] if heads else len(numbers)
        if first:
            out.append((source, file, STITCHED, numbers[0], None, values[:first].tolist()))
        for at, following in zip(heads, [*heads, len(numbers)][1:], strict=True):
            part = STITCHED if following == len(numbers) else chunk
            # The first head of a file also takes the lines above it.
            part = STITCHED if at == first else part
            out.append((source, file, part, numbers[at], values[at], values[at + 1:following].tolist()))
        yield pd.DataFrame(out, columns=["source_id", "file", "part", "line_no", "value", "trace"])

    def close(self) -> None:
        pass


class FileStitcher(StatefulProcessor):
    """The open entry of a file: its head as a value, its trace as a list."""

    def __init__(self, flush_after_ms: int | None, whole_files: bool):
        self.flush_after_ms, self.whole_files = flush_after_ms, whole_files

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "line_no long, value string, timer long")
        self.trace = handle.getListState("trace", "line string")

    def _take(self, key) -> tuple:
        """The open entry, which ends here."""
        number, value, _ = self.head.get()
        trace = [line for (line,) in self.trace.get()] if self.trace.exists() else None
        self.trace.clear()
        return (key[0], key[1], number, value, trace)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source_id", "file", "line_no", "value", "stacktrace"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[2] != STITCHED:
            for frame in rows:
                traces = [list(t) if len(t) else None for t in frame["trace"]]
                yield self._frame(list(zip(frame["source_id"], frame["file"], frame["line_no"], frame["value"], traces, strict=True)))
            return
        out = []
        timer = self.head.get()[2] if self.head.exists() else None
        if timer is not None:
            self.handle.deleteTimer(timer)
        # Two rows for each chunk of the micro-batch.
        pieces = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        opened = self.head.exists() and self.head.get()[1] is not None
        for number, value, trace in zip(pieces["line_no"], pieces["value"], pieces["trace"], strict=True):
            if value is not None:
                if opened:
                    out.append(self._take(key))
                self.head.update((int(number), value, None))
                opened = True
            if len(trace):
                # Lines above the first head of a file wait for it.
                self.trace.appendList([(line,) for line in trace])
        if self.whole_files and opened:
            out.append(self._take(key))
            self.head.clear()
        elif self.flush_after_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.flush_after_ms
            self.handle.registerTimer(timer)
            number, value, _ = self.head.get() if opened else (None, None, None)
            self.head.update((number, value, timer))
        elif opened:
            number, value, _ = self.head.get()
            self.head.update((number, value, None))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists() and self.head.get()[1] is not None:
            yield self._frame([self._take(key)])
        self.trace.clear()
        self.head.clear()

    def close(self) -> None:
        pass


def assemble_stream(lines: DataFrame, flush_after_ms: int | None = 10_000, whole_files: bool = False, chunk: int = CHUNK_LINES) -> DataFrame:
    """Head lines with their traces from a stream of ``source_id, file, line_no, value``.

    The result is that of :func:`tracewell.operators.assemble.merge_stacktraces` over all lines,
    but for an entry that is still open. An entry is put out when the next head of its file arrives
    or nothing arrived for ``flush_after_ms``; None never flushes. ``whole_files`` says that no file
    goes on in a later micro-batch. ``chunk`` is the width of a chunk in ``line_no``, in
    bytes if lines are numbered by position. Lines of a file must not arrive in an earlier
    micro-batch than lines above them. Uses the RocksDB state store, which list states and timers need.
    """
    spark = configure(lines.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marked = lines.select("source_id", "file", "line_no", "value", is_continuation(F.col("value")).alias("continues"),
                          F.floor(F.col("line_no") / chunk).cast("long").alias("chunk"))
    pieces = marked.groupBy("source_id", "file", "chunk").transformWithStateInPandas(ChunkAssembler(), PIECES, "append", "None")
    mode = "None" if flush_after_ms is None else "ProcessingTime"
    return pieces.groupBy("source_id", "file", "part").transformWithStateInPandas(
        FileStitcher(flush_after_ms, whole_files), MERGED, "append", mode)
