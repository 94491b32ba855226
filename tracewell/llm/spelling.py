"""Spelling variants by finite-state composition.

The words of a corpus form a minimised acceptor A. Composed with a transducer E that makes
exactly one edit and with A again, the machine A . E . A accepts the pairs of words that
differ by one inserted, deleted or replaced code point. Its start is split into initial
states: the state that a shared first half leads to, with the edit still to come, and the
state that remains if the last half is shared, with the edit already past. Each of these
partitions is one group of a shuffle; a task builds the minimised acceptor of what the
group's words do not share and enumerates the accepted pairs from it. A pair belongs to the
half in which its words part, so each pair comes from one partition only.

A group above ``GROUP`` words is split again by halves of what is still open, down to one
open code point, where it has one word for each letter. So no task holds a large group,
whatever the share of words with the same start or end, and no pair is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm import arrays as A
from tracewell.session import cut_lineage, drop_stage

LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGE = 97
RATIO = 2
# Words and code points of a group that one task composes at once.
GROUP = 4096
GROUP_CHARS = 1 << 20
# Distinct runs that a counting task holds before it sums and puts them out.
HELD_RUNS = 400_000
# Bytes of a run whose checksum is computed in step with all others; the rest goes on alone.
STEPS = 64


# ---------------------------------------------------------------- counting
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
ONES = np.uint32(0xFFFFFFFF)


def checksums(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans that follow what has the checksum ``before``, all spans byte by byte in step."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    sizes, at = sizes[order], starts[order]
    state = (before[order] ^ ONES).astype(np.uint32)
    active = len(order) - np.searchsorted(sizes[::-1], np.arange(1, STEPS + 1))
    for step, n in enumerate(active.tolist()):
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ text[at[:n] + step]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    state ^= ONES
    for i in range(int(np.searchsorted(-sizes, -STEPS, side="left"))):
        state[i] = zlib.crc32(text[at[i] + STEPS:at[i] + sizes[i]].tobytes(), int(state[i]))
    out[order] = state
    return out


def _strings(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes as an Arrow array."""
    sizes = ends - starts
    offsets = np.r_[0, np.cumsum(sizes)]
    data = text[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def damaged_runs(ids: list, text: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of letters of all texts, A-Z lower-cased, that have ``LEAST_LENGTH`` code points after damage.

    A run whose checksum, together with the id of its document, is divisible by ``DAMAGE`` loses one code point.
    """
    read = A.LOWER[text]
    lead = read == 0xC3
    after = np.zeros_like(lead)
    after[1:] = lead[:-1]
    after[bounds[:-1][bounds[:-1] < len(text)]] = False
    letter = ((read >= 0x61) & (read <= 0x7A)) | lead | after
    starts, ends, at = A.spans(read, bounds, letter)
    # Code points are bytes that do not follow a lead byte.
    points = np.r_[0, np.cumsum(~after)]
    length = points[ends] - points[starts]
    long = length >= LEAST_LENGTH
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(at))[long]
    starts, ends, length = starts[long], ends[long], length[long]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    sums = checksums(read, starts, ends, prefix[owner])
    hit = sums % np.uint32(DAMAGE) == 0
    whole = _strings(read, starts[~hit], ends[~hit])
    changed = []
    for start, end, n, crc in zip(starts[hit].tolist(), ends[hit].tolist(), length[hit].tolist(), sums[hit].tolist(), strict=True):
        if n > LEAST_LENGTH:
            run, place = read[start:end].tobytes().decode(), crc % n
            changed.append(run[:place] + run[place + 1:])
    return pa.concat_arrays([whole, pa.array(changed, pa.large_string())])


COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(batches):
    """Sums of words inside one task."""
    held, size = [], 0

    def summed():
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return table.rename_columns([c.replace("n_sum", "n") for c in table.column_names]).select(["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for rows, text, bounds in A.text_slices(batch.column(1)):
            found = pc.value_counts(damaged_runs(ids[rows], text, bounds))
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            size += len(found)
            if size > HELD_RUNS:
                held = [summed()]
                size = len(held[0])
                if size > HELD_RUNS // 2:
                    yield from held[0].cast(COUNTED).to_batches(50_000)
                    held, size = [], 0
    if held:
        yield from summed().cast(COUNTED).to_batches(50_000)


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the damaged words of whole texts with at least ``least`` occurrences. A null text has none."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- composition
class Acceptor:
    """Minimal acceptor of sorted distinct words. States are numbered so that successors come first."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.moves: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, dict]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                (final,), moves = path.pop()
                key = (final, tuple(moves.items()))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.final)
                    self.final.append(final)
                    self.moves.append(moves)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same)
            path += [([False], {}) for _ in word[same:]]
            path[-1][0][0] = True
            last = word
        close(0)
        (final,), moves = path[0]
        self.final.append(final)
        self.moves.append(moves)


class Composition:
    """The pairs that acceptor, one edit and acceptor accept one after the other."""

    def __init__(self, acceptor: Acceptor):
        self.acceptor = acceptor
        self.shared: dict[tuple[int, int], list[str]] = {}

    def rest(self, left: int, right: int) -> list[str]:
        """What both states accept: the edit is past, both sides read the same."""
        final, moves, shared = self.acceptor.final, self.acceptor.moves, self.shared
        todo = [(left, right)]
        while todo:
            pair = todo[-1]
            if pair in shared:
                todo.pop()
                continue
            one, two = moves[pair[0]], moves[pair[1]]
            steps = [(c, (to, two[c])) for c, to in one.items() if c in two]
            open_steps = [step for _, step in steps if step not in shared]
            if open_steps:
                todo += open_steps
                continue
            found = [""] if final[pair[0]] and final[pair[1]] else []
            for c, step in steps:
                found += [c + end for end in shared[step]]
            shared[pair] = found
            todo.pop()
        return shared[left, right]

    def pairs(self) -> list[tuple[str, str]]:
        """All accepted pairs: of replaced code points once, of a deleted one as (longer, shorter).

        A deletion inside equal code points is made at the last of them, where the words part.
        """
        ahead: list[list[tuple[str, str]]] = []
        for state, moves in enumerate(self.acceptor.moves):
            found = [(c + left, c + right) for c, to in moves.items() for left, right in ahead[to]]
            steps = list(moves.items())
            for i, (a, to) in enumerate(steps):
                for b, other in steps[i + 1:]:
                    found += [(a + end, b + end) for end in self.rest(to, other)]
                found += [(a + end, end) for end in self.rest(to, state) if not end.startswith(a)]
            ahead.append(found)
        return ahead[-1]


PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
PAIR_TYPES = "word string, n long, near string, near_n long"


def group_pairs(longest: int, low: int, tail: int, words: list[tuple[str, int]]) -> list[tuple[str, int, str, int]]:
    """Near words of one partition: they share ``low`` first and ``tail`` last code points and part between them;
    the longer word of a pair has ``longest`` code points."""
    of = {word[low:len(word) - tail]: (word, n) for word, n in words}
    width = longest - tail - low
    first = words[0][0]
    beyond = first[len(first) - tail] if tail else ""
    out = []
    for left, right in Composition(Acceptor(sorted(of))).pairs():
        # Pairs of two shorter words belong to the class below; a deletion at the end that the shared
        # rest repeats belongs to the other half.
        if len(left) < width or (len(right) < width and tail and left[:-1] == right and left[-1] == beyond):
            continue
        out.append((*of[left], *of[right]))
    return out


def _compose(batches):
    """Near pairs from rows sorted by partition; one partition is held at a time."""
    key, words = None, []

    def out(found):
        for low in range(0, len(found), 50_000):
            columns = list(zip(*found[low:low + 50_000], strict=True))
            yield A.table_of(PAIRS, **{f.name: pa.array(columns[i], f.type) for i, f in enumerate(PAIRS)})

    found: list[tuple] = []
    for batch in batches:
        for longest, shared, low, tail, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (longest, shared) != key:
                if len(words) > 1:
                    found += group_pairs(*place, words)
                    if len(found) > 50_000:
                        yield from out(found)
                        found = []
                key, place, words = (longest, shared), (longest, low, tail), []
            words.append((word, n))
    if len(words) > 1:
        found += group_pairs(*place, words)
    yield from out(found)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's open stretch cut in two: once its first half becomes shared, once its last."""
    middle = F.col("low") + F.floor((F.col("longest") - F.col("tail") - F.col("low")) / 2).cast("int")
    places = F.array(
        F.struct(middle.alias("low"), F.col("tail").alias("tail")),
        F.struct(F.col("low").alias("low"), (F.col("longest") - middle).alias("tail")))
    cut = rows.select("word", "n", "longest", F.explode(places).alias("place"))
    low, tail = F.col("place.low"), F.col("place.tail")
    size = F.length("word")
    # Words hold letters only, so the mark shows where the shared start ends.
    shared = F.concat(F.substring(F.col("word"), F.lit(1), low), F.lit("-"), F.substring(F.col("word"), size - tail + 1, tail))
    return cut.select("longest", shared.alias("shared"), low.alias("low"), tail.alias("tail"), "word", "n")


def near_words(words: DataFrame, group: int = GROUP, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``word, n, near, near_n`` of all pairs of ``words`` (``word, n``, written) one edit apart, once in any direction."""
    size = F.length("word")
    rows = _halves(words.select(
        "word", "n", F.explode(F.array(size, size + 1)).alias("longest"), F.lit(0).alias("low"), F.lit(0).alias("tail")))
    parts, stages = [], []
    while True:
        sizes = rows.groupBy("longest", "shared").agg(
            F.count("*").alias("rows"), F.sum(size).alias("chars"), F.max(size == F.col("longest")).alias("whole"))
        met = rows.join(sizes.where("rows > 1 and whole").drop("whole"), ["longest", "shared"])
        met = cut_lineage(met.withColumn("split", (
            (F.col("rows") > group) | (F.col("chars") > group_chars)) & (F.col("longest") - F.col("tail") - F.col("low") > 1)))
        stages.append(met)
        dealt = met.where("not split").select("longest", "shared", "low", "tail", "word", "n")
        # A stated number, since composing takes much time for few bytes: partitions must not be merged by size.
        tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.repartition(tasks, "longest", "shared").sortWithinPartitions("longest", "shared")
        parts.append(dealt.mapInArrow(_compose, PAIR_TYPES))
        rest = met.where("split")
        if rest.isEmpty():
            break
        rows = _halves(rest)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    pairs = cut_lineage(found)
    drop_stage(*stages)
    return pairs


# ---------------------------------------------------------------- forms
def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of a table ``word, form`` without cycles: the end of each word's chain of forms, by pointer doubling."""
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = cut_lineage(ends.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_stage(ends)
        if grown.where("moved").isEmpty():
            return grown.select("word", "root")
        ends = grown.select("word", "root")
        ends._tracewell_stage = grown._tracewell_stage


def spelling_variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of whole texts.

    ``form`` is the near word of largest count, of several the least in code points, if its count is
    at least ``ratio`` times the word's own; ``root`` is where the chain of forms ends. Only ``doc_id``
    and ``text`` are read; a null id counts as an empty one in the damage rule, repeated rows are
    counted as often as they occur, a text of any length is read whole. No words give no rows.
    """
    words = cut_lineage(word_counts(docs, least))
    pairs = near_words(words, group)
    both = pairs.unionByName(pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("near"))).alias("best"))
    known: Column = F.col("best.down") <= -F.lit(ratio) * F.col("n")
    table = cut_lineage(words.join(best, "word", "left").select(
        "word", F.when(known, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, -F.col("best.down")).alias("form_n")))
    drop_stage(pairs, words)
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
