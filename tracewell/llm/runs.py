"""Runs of words of all texts: counted, and looked up in tables that may be larger than any task.

What a task sends is dealt by hash into as many buckets as there are shuffle partitions, one
row of packed arrays for each, so the shuffle moves bytes and numpy sums and looks up. A bucket holds
a share of all runs that falls with the number of buckets. Large inputs are read in ``PASSES`` passes, each for its
part of the buckets or texts, so that only that part of the rows lies on disk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.bitmap import may_hold
from tracewell.session import cut_lineage, drop_stage, union_stages

PASSES = 4
# Tokens above which another pass pays.
TOKENS_A_PASS = 4_000_000
# Rows that a task holds before it sends them.
HELD = 2_000_000
RUN_TYPES = "hash long, context long, suffix long, n long"
RUNS = pa.schema([("hash", pa.int64()), ("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])
SENT_RUNS = pa.schema([("bucket", pa.int32()), ("context", pa.binary()), ("suffix", pa.binary()), ("n", pa.binary())])
SENT_RUN_TYPES = "bucket int, context binary, suffix binary, n binary"
TEXTS = [(c, pa.binary()) for c in ("text", "bounds", "keys")]
LOOKED = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("hashes", pa.binary()), *TEXTS])
LOOKED_TYPES = "bucket int, slice long, hashes binary, text binary, bounds binary, keys binary"
FOUND = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("met", pa.binary()), ("values", pa.binary()), *TEXTS])
FOUND_TYPES = "slice long, bucket int, met binary, values binary, text binary, bounds binary, keys binary"
SCORED = pa.schema([("key", pa.int64()), ("score", pa.float64())])
SCORED_TYPES = "key long, score double"


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the run of words that is ``context`` without its last word and ``suffix`` without its first."""
    return A.mix(A.mix(context + A.ODD) * A.STEP + suffix)


def longer(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, suffixes and texts of the runs that are one word longer than those given, which lie text by text."""
    inside = owner[1:] == owner[:-1]
    return hashes[:-1][inside], hashes[1:][inside], owner[1:][inside]


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _passes(buckets: int, tokens: int) -> list[tuple[int, int]]:
    """First and next bucket of each pass."""
    n = min(PASSES, buckets, 1 + tokens // TOKENS_A_PASS)
    return [(buckets * k // n, buckets * (k + 1) // n) for k in range(n)]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _bucket_column(hashes: Column, buckets: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(hashes, 32) * F.lit(buckets).cast("long"), 32).cast("int")


def _within(hashes: np.ndarray, buckets: int, part: tuple[int, int]) -> np.ndarray:
    bucket = _bucket_of(hashes, buckets)
    return (bucket >= part[0]) & (bucket < part[1])


def _small(values: np.ndarray) -> bytes:
    """Bytes of the narrowest unsigned type that holds the values."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def _cuts(hashes: np.ndarray, buckets: int):
    """Bucket, first and next place of the runs of sorted hashes that share a bucket."""
    bucket = _bucket_of(hashes, buckets)
    starts, sizes = A.grouped(bucket)
    return zip(bucket[starts].tolist(), starts.tolist(), (starts + sizes).tolist())


# ---------------------------------------------------------------- counting
def _merged(parts: list) -> tuple:
    hashes, context, suffix, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes)
    starts, _ = A.grouped(hashes[order])
    first = order[starts]
    return hashes[first], context[first], suffix[first], np.add.reduceat(n[order], starts) if len(starts) else n


def _sent_runs(runs_of, buckets: int, part: tuple[int, int], held=None):
    def out(parts):
        hashes, context, suffix, n = _merged(parts)
        for bucket, low, high in _cuts(hashes, buckets):
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket], pa.int32()), pa.array([context[low:high].tobytes()], pa.binary()),
                pa.array([suffix[low:high].tobytes()], pa.binary()), pa.array([_small(n[low:high])], pa.binary())], schema=SENT_RUNS)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, text, bounds in A.text_slices(batch.column(0)):
                context, suffix = runs_of(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))
                hashes = joined(context, suffix)
                inside = np.flatnonzero(_within(hashes, buckets, part))
                if held is not None:
                    inside = inside[may_hold(held.value, context[inside])]
                    inside = inside[may_hold(held.value, suffix[inside])]
                parts.append(_merged([(hashes[inside], context[inside], suffix[inside], np.ones(len(inside), np.int64))]))
                size += len(parts[-1][0])
                if size >= HELD:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size >= HELD // 2:
                        yield from out(parts)
                        parts, size = [], 0
        if size:
            yield from out(parts)
    return run


def _counted_runs(least: float):
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for context, suffix, n in zip(*(table.column(c).to_pylist() for c in ("context", "suffix", "n"))):
            context, suffix = (np.frombuffer(x, np.uint64) for x in (context, suffix))
            parts.append((joined(context, suffix), context, suffix, _wide(n, len(context))))
        hashes, context, suffix, n = _merged(parts)
        often = n >= least
        return pa.table([pa.array(A.signed(x[often])) for x in (hashes, context, suffix)] + [pa.array(n[often])], schema=RUNS)
    return run


def count_runs(texts: DataFrame, runs_of, tokens: int, least: float, held=None) -> DataFrame:
    """``hash, context, suffix, n`` of the runs that occur ``least`` times or more, as written tables.

    ``runs_of(words)`` gives contexts and suffixes of all runs of a slice of the one-column table of texts.
    Those whose context or suffix is not in the bitmap ``held``, if given, are left out.
    """
    buckets = _buckets(texts)
    parts = []
    for part in _passes(buckets, tokens):
        sent = texts.mapInArrow(_sent_runs(runs_of, buckets, part, held), SENT_RUN_TYPES)
        parts.append(cut_lineage(sent.groupBy("bucket").applyInArrow(_counted_runs(least), RUN_TYPES)))
    return union_stages(parts)


def joined_parts(runs: DataFrame, others: DataFrame, column: str, tokens: int, join) -> DataFrame:
    """``join(part, others)`` for each part that :func:`count_runs` wrote, with the ``others`` whose ``column`` is a hash of that part.

    Each part is deleted once its result is written.
    """
    buckets, done = _buckets(runs), []
    for part, (low, high) in zip(runs._tracewell_parts, _passes(buckets, tokens), strict=True):
        bucket = _bucket_column(F.col(column), buckets)
        done.append(cut_lineage(join(part, others.where((bucket >= low) & (bucket < high)))))
        drop_stage(part)
    return union_stages(done)


# ---------------------------------------------------------------- values for texts
def _asked(hashes: np.ndarray, model, held) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted hashes in the model, and which of them are to be asked for."""
    at = A.lookup(model.hashes, hashes)
    return at, np.flatnonzero((at < 0) & may_hold(held, hashes))


def _sent_lookups(runs_of, model, held, buckets: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(1)):
                hashes = np.unique(np.concatenate(runs_of(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))))
                hashes = hashes[_asked(hashes, model.value, held.value)[1]]
                keys = np.asarray(batch.column(0)[rows])
                yield _lookup_row(int(_bucket_of(A.mix(np.array([number], np.uint64)), buckets)[0]), number, None, text, bounds.astype(np.int64), keys)
                for bucket, low, high in _cuts(hashes, buckets):
                    yield _lookup_row(bucket, number, hashes[low:high])
                number += 1
    return run


def _lookup_row(bucket, number, *packed) -> pa.RecordBatch:
    packed = [None if x is None else x.tobytes() for x in (*packed, None, None, None)[:4]]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], schema=LOOKED)


def _looked_up(names: list[str]):
    """For each slice of texts and bucket one row: which of the hashes asked for are in the table, and their values; texts pass."""
    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        wanted = np.asarray(table.column("hash")).view(np.uint64)
        order = np.argsort(wanted)
        wanted = wanted[order]
        values = [np.asarray(table.column(c))[order] for c in names]
        out = []
        for bucket, number, hashes, *whole in zip(*(rows.column(c).to_pylist() for c in LOOKED.names)):
            met = found = None
            if hashes is not None:
                at = A.lookup(wanted, np.frombuffer(hashes, np.uint64))
                met = np.flatnonzero(at >= 0)
                if not len(met):
                    continue
                met, found = _small(met), np.array([v[at[met]] for v in values]).tobytes()
            out.append((number, bucket, met, found, *whole))
        columns = zip(*out) if out else [()] * len(FOUND)
        return pa.table([pa.array(c, t) for c, t in zip(columns, FOUND.types)], schema=FOUND)
    return run


def _scored(runs_of, score, model, held, names: int, buckets: int):
    """The scores of the texts of a slice, from what all buckets know of their runs."""
    def run(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        whole = next(r for r in found if r["keys"] is not None)
        words = A.words_of(np.frombuffer(whole["text"], np.uint8), np.frombuffer(whole["bounds"], np.int64), A.BETWEEN_SPACES, lower=True)
        runs = runs_of(words)
        hashes, places = np.unique(np.concatenate(runs), return_inverse=True)
        at, asked = _asked(hashes, model.value, held.value)
        values = np.array([np.append(known, np.nan)[at] for known in model.value.values])
        first = {bucket: low for bucket, low, _ in _cuts(hashes[asked], buckets)}
        for r in found:
            if r["keys"] is None:
                part = np.frombuffer(r["values"]).reshape(names, -1)
                values[:, asked[first[r["bucket"]] + _wide(r["met"], part.shape[1])]] = part
        ends = np.cumsum([len(x) for x in runs])
        scores = score(words, *(values[:, at] for at in np.split(places, ends[:-1])))
        return pa.table([pa.array(np.frombuffer(whole["keys"], np.int64)), pa.array(scores)], schema=SCORED)
    return run


def scores_by_text(rows: DataFrame, runs_of, score, table: DataFrame, names: list[str], model, held, tokens: int = 0) -> DataFrame:
    """``key, score`` for each key of ``rows``, from values of all runs of its text.

    ``rows`` has columns ``key, text``; rows that share a key must be equal, and count once. ``runs_of(words)`` gives an array of
    hashes of runs for each length, and ``score(words, *values)`` the scores of the texts from the columns ``names`` of these runs, NaN for
    a run that is not in ``table``. ``table`` has a row for each ``hash``; ``model`` holds the same ``values`` of its most
    frequent ``hashes``, which are not sent. ``held`` is a bitmap of its hashes. ``tokens`` decides the passes, each over a part of the texts.
    """
    buckets = _buckets(rows)
    passes = len(_passes(buckets, tokens))
    dealt = table.select(_bucket_column(F.col("hash"), buckets).alias("bucket"), "hash", *names)
    parts = []
    for k in range(passes):
        some = rows.select("key", "text").where(F.pmod("key", F.lit(passes)) == k)
        sent = some.mapInArrow(_sent_lookups(runs_of, model, held, buckets), LOOKED_TYPES)
        # The texts go along, to any bucket.
        found = sent.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_looked_up(names), FOUND_TYPES)
        parts.append(cut_lineage(found.groupBy("slice").applyInArrow(_scored(runs_of, score, model, held, len(names), buckets), SCORED_TYPES)))
    return union_stages(parts).groupBy("key").agg(F.first("score").alias("score"))
