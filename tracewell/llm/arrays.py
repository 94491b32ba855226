"""Words of whole texts as numpy arrays, read from Arrow buffers without Python strings.

Everything here runs inside tasks on bounded slices of a batch: the words of all
texts of a slice are one array, ``bounds[i]:bounds[i + 1]`` are those of text i.
A null text is an empty one. Hashes are 64 bits wide and the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
BASE = 0xDA942042E4DD58B5
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_set(ranges) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# Word bytes between white space, and word bytes of lower-cased letters and digits.
BETWEEN_SPACES = ~byte_set([(0x20, 0x20), (0x09, 0x0D)])
LETTERS_DIGITS = byte_set([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)
_powers: dict[str, np.ndarray] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < length:
        size = max(length, HASH_BYTES + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of disjoint ascending byte spans, from prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODES[text[low:high]] * up[:high - low], out=sums[1:])
        first, last = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[last] - sums[first]) * down[first]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def spans(text: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that do not cross texts: starts, ends, bounds."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(text)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


@dataclass
class Words:
    text: np.ndarray
    text_bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(text: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    read = LOWER[text] if lower else text
    starts, ends, at = spans(read, bounds, word_bytes[read])
    return Words(text, bounds, starts, ends, at, hash_spans(read, starts, ends))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, bytes and bounds of runs of texts of about ``limit`` bytes; a longer text is alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1))
        yield slice(i, j), raw[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; texts are not told apart here."""
    n = max(0, len(hashes) - k + 1)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * STEP + hashes[j:n + j]
    return mix(total + np.uint64(k))


def within_text(owner: np.ndarray, k: int) -> np.ndarray:
    """Does the run of k words that starts here end in the same text?"""
    n = max(0, len(owner) - k + 1)
    return owner[:n] == owner[k - 1:k - 1 + n]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name].cast(f.type) for f in schema], schema=schema)


def grouped(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    if not len(order_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, order_keys[1:] != order_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(order_keys)])


def totals(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    ordered = np.sort(hashes)
    starts, sizes = grouped(ordered)
    return ordered[starts], sizes


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Counter:
    """Sums of counts by hash inside one task, emptied before it grows beyond ``limit`` hashes."""

    def __init__(self, limit: int = 4_000_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((values, counts))
        self.size += len(values)

    @property
    def full(self) -> bool:
        if self.size < self.limit:
            return False
        self._merge()
        return self.size >= self.limit // 2

    def _merge(self) -> None:
        values = np.concatenate([v for v, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts, _ = grouped(values)
        sums = np.add.reduceat(counts, starts) if len(starts) else counts
        self.parts, self.size = [(values[starts], sums)], len(starts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        (result,) = self.parts
        self.parts, self.size = [], 0
        return result
