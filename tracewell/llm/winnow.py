"""Benchmark decontamination by winnowing.

A text keeps the smallest k-gram hash of every run of ``WINDOW - K + 1`` k-grams
(Schleimer, Wilkerson, Aiken: "Winnowing", SIGMOD 2003), so two texts that share
``WINDOW`` words share a fingerprint inside them. Fingerprints are joined, and each hit is
extended by the words around it, which travel with the fingerprint. Items shorter than a
window are one fingerprint of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.bitmap import may_hold, send_bitmap
from tracewell.llm.texts import PLAIN_WORDS, UPPER, packed, text_marks
from tracewell.session import cut_lineage

WINDOW = 13
K = 7
SIDE = WINDOW - K
AROUND = WINDOW + SIDE
# What stands for a missing neighbour differs on both sides, so it never matches.
NO_DOCUMENT_WORD, NO_ITEM_WORD = np.uint64(1), np.uint64(2)

# Rows of texts have an id and a size, rows of fingerprints the columns after them.
PRINTS = pa.schema([
    ("row_key", pa.int64()), ("id", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()), ("length", pa.int32()), ("around", pa.binary()),
])
PRINT_TYPES = "row_key long, id long, text_a long, text_b long, n_words long, hash long, place long, length int, around binary"
SPANS = pa.schema([("row_key", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("around_id", pa.int64())])


def _sliding(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``size`` values, by doubling."""
    pick = np.minimum if least else np.maximum
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def fingerprints(words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that winnowing keeps; of equal minima all are kept."""
    owner = words.owner
    grams = A.rolling(words.hashes, K)
    if len(owner) < WINDOW:
        return np.zeros(0, np.int64), grams[:0]
    least = _sliding(grams, SIDE + 1, least=True)
    least[~A.within_text(owner, WINDOW)] = 0
    pad = np.zeros(SIDE, np.uint64)
    best = _sliding(np.r_[pad, least, pad], SIDE + 1, least=False)
    at = np.flatnonzero((best == grams) & A.within_text(owner, K))
    return at, grams[at]


def _around(words: A.Words, at: np.ndarray, before: int, count: int, none: np.uint64) -> np.ndarray:
    """The words around each place, as rows of ``AROUND`` hashes."""
    out = np.full((len(at), AROUND), none)
    owner = np.searchsorted(words.bounds, at, side="right") - 1
    for j in range(-before, count):
        place = at + j
        there = (place >= words.bounds[owner]) & (place < words.bounds[owner + 1])
        out[there, SIDE + j] = words.hashes[place[there]]
    return out


def _print_rows(words, key, at, hashes, need, none):
    """Arrow rows of fingerprints, a bounded number at a time."""
    owner = np.searchsorted(words.bounds, at, side="right") - 1
    for low in range(0, len(at), 50_000):
        part = slice(low, low + 50_000)
        near = _around(words, at[part], SIDE if need == WINDOW else 0, WINDOW if need == WINDOW else need, none)
        none_here = pa.nulls(len(near), pa.int64())
        yield A.table_of(
            PRINTS, row_key=key + owner[part], id=none_here, text_a=none_here, text_b=none_here, n_words=none_here, hash=A.signed(hashes[part]),
            place=at[part] - words.bounds[owner[part]], length=np.full(len(near), need, np.int32),
            around=pa.array([row.tobytes() for row in near], pa.binary()))


def _prints(bitmap, lengths: list[int]):
    """Fingerprints of documents (those the bitmap may hold) or, without a bitmap, of items."""
    none = NO_ITEM_WORD if bitmap is None else NO_DOCUMENT_WORD

    def run(batches):
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(0)):
                words = A.words_of(text, bounds, A.LETTERS_DIGITS, lower=True)
                size = words.counts
                parts = [(*fingerprints(words), WINDOW)]
                for n in lengths:
                    runs = A.rolling(words.hashes, n)
                    whole = A.within_text(words.owner, n)
                    if bitmap is None:
                        whole &= size[words.owner[:len(whole)]] == n
                    at = np.flatnonzero(whole)
                    parts.append((at, runs[at], n))
                for at, hashes, need in parts:
                    if bitmap is not None:
                        may = may_hold(bitmap.value, hashes)
                        at, hashes = at[may], hashes[may]
                    yield from _print_rows(words, key, at, hashes, need, none)
                yield A.table_of(
                    PRINTS, row_key=key + np.arange(len(size)), id=batch.column(1)[rows], text_a=batch.column(2)[rows],
                    text_b=batch.column(3)[rows], n_words=size, hash=pa.nulls(len(size), pa.int64()),
                    place=pa.nulls(len(size), pa.int64()), length=pa.nulls(len(size), pa.int32()), around=pa.nulls(len(size), pa.binary()))
                key += len(size)
    return run


def _extend(batches):
    """Spans of words that agree around joined fingerprints and reach the needed length."""
    for batch in batches:
        key, place, need, around_id = (batch.column(i).to_numpy() for i in range(4))
        ours, theirs = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, AROUND) for i in (4, 5))
        same = ours == theirs
        core = np.where(need == WINDOW, K, need)
        left = np.cumprod(same[:, :SIDE][:, ::-1], axis=1).sum(axis=1)
        run = np.cumprod(same[:, SIDE:], axis=1).sum(axis=1)
        # A longer run on the right counts only as far as the words that came along.
        good = (run >= core) & (left + run >= need)
        yield A.table_of(SPANS, row_key=key[good], first=(place - left)[good], last=(place + run)[good], around_id=around_id[good])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_a, text_b`` of every row of ``docs``.

    Words are runs of letters and digits, lower-cased in A-Z. A document word is hit if it
    lies in a run of 13 words that an item holds too; an item of fewer words must occur
    whole. ``contaminated`` if one word in twenty or more is hit. Null and empty texts
    have no words and no hits, null or empty items hit nothing, an item without id counts
    under the empty id, and rows with one item id are one item. No hits give the checksum of the empty text. Repeated
    documents are judged alike. Only ``doc_id, text`` and ``item_id, text`` are read.
    """
    named = cut_lineage(items.where("text is not null").groupBy("text").agg(
        F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids")))
    size = F.regexp_count(F.translate("text", UPPER, UPPER.lower()), F.lit(PLAIN_WORDS))
    short = sorted(r.n for r in named.select(size.alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect())
    read = lambda rows, key, bitmap: cut_lineage(
        rows.select("text", key.alias("id"), *text_marks(F.col("text"))).mapInArrow(_prints(bitmap, short), PRINT_TYPES))
    item_rows = read(named, F.xxhash64("text"), None)
    # Items with the same surroundings of a fingerprint are met once.
    item_prints = item_rows.where("hash is not null").withColumn("around_id", F.xxhash64("length", "around"))
    known = cut_lineage(item_prints.select("hash", "length", "around_id", F.col("around").alias("theirs")).distinct())
    doc_rows = read(docs, F.col("doc_id").cast("long"), send_bitmap(known, "hash"))
    met = doc_rows.where("hash is not null").join(known, ["hash", "length"])
    spans = cut_lineage(
        met.select("row_key", "place", "length", "around_id", "around", "theirs")
        .mapInArrow(_extend, "row_key long, first long, last long, around_id long"))

    before = W.partitionBy("row_key").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(F.max("last").over(before), F.lit(0).cast("long"))))
    hits = (
        spans.groupBy("row_key", "first").agg(F.max("last").alias("last"))
        .select("row_key", covered.alias("covered")).groupBy("row_key").agg(F.sum("covered").alias("n_hit"))
    )
    item_keys = item_rows.where("hash is null").select("row_key", F.col("id").alias("item_key"))
    owners = (
        item_prints.select("row_key", "around_id").distinct().join(item_keys, "row_key")
        .join(named.select(F.xxhash64("text").alias("item_key"), F.explode("ids").alias("item_id")), "item_key")
        .select("around_id", "item_id").distinct()
    )
    found = (
        spans.select("row_key", "around_id").distinct().join(owners, "around_id")
        .groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("found"))
    )
    texts = doc_rows.where("hash is null").select("row_key", F.col("id").alias("doc_id"), "n_words", "text_a", "text_b")
    joined = texts.join(hits, "row_key", "left").join(found, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found_ids = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(found_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(found_ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_a", "text_b",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Rows without text or words stay; repeated rows stay or go together; texts of any length are read
    whole. Empty tables of documents or items are fine.
    """
    marks = dict(zip(("_text_a", "_text_b"), text_marks(F.col("_row.text")), strict=True))
    bad = contamination(docs, items).where("contaminated").select(
        F.col("text_a").alias("_text_a"), F.col("text_b").alias("_text_b")).distinct()
    return packed(docs).withColumns(marks).join(cut_lineage(bad), list(marks), "left_anti").select("_row.*")
