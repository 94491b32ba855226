"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` words (after Ron, Singer and Tishby: "The Power of
Amnesia", 1996). A context is retained if what follows it diverges from what follows its
longest proper suffix: the information that its tokens gain must exceed ``GAIN`` bits a
token. A state's distribution is its discounted counts, and what remains goes to its
suffix; the root is the add-one distribution over all words with one place for unknown
ones. Each token is scored in the longest retained suffix of its history.

Contexts and successors enter the tree from ``LEAST`` occurrences on, however large the
corpus, so the tree grows with it and stays in tables. A run of words (its context, its
suffix) changes the logarithm of a chance by a sum: what its last word gains as a successor
of a retained context, and what a retained context takes from all its successors. So the
score of a text is a sum over its runs, found by one join. Runs with at least ``SENT`` of all
training tokens, ``1 / SENT`` at most of each length, go to every task instead. A bitmap of fixed
size spares rows of many runs that are not in the tree; it never hides one that is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.bitmap import may_hold, send_bitmap
from tracewell.llm.counts import arrow_columns, written_counts
from tracewell.llm.sending import send
from tracewell.session import cut_lineage, drop_stage

LEAST = 2
SENT = 1e-5
DEPTH = 2
GAIN = 0.05
DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
END = A.mix(np.array([7], np.uint64) * A.STEP)[0]


def _with_ends(words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and their bounds."""
    return np.insert(words.hashes, words.bounds[1:], END), words.bounds + np.arange(len(words.bounds))


def _tokens(words: A.Words):
    yield _with_ends(words)[0]


def _joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the run of words that is ``context`` without its last word and ``suffix`` without its first."""
    return A.mix(A.mix(context + A.ODD) * A.STEP + suffix)


def _longer(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, suffixes and texts of the runs that are one word longer than those given, which lie text by text."""
    inside = owner[1:] == owner[:-1]
    return hashes[:-1][inside], hashes[1:][inside], owner[1:][inside]


RUNS = pa.schema([("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])
RUN_TYPES = "context long, suffix long, n long"


def _runs(depth: int, held=None):
    """All runs of ``depth + 1`` words whose context and suffix may be among the ``held`` ones, counted slice by slice."""
    def run(batches):
        for batch in batches:
            for _, text, bounds in A.text_slices(batch.column(0)):
                hashes, at = _with_ends(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for _ in range(depth):
                    context, suffix, owner = _longer(hashes, owner)
                    hashes = _joined(context, suffix)
                if held is not None:
                    both = may_hold(held.value, context) & may_hold(held.value, suffix)
                    hashes, context, suffix = hashes[both], context[both], suffix[both]
                order = np.argsort(hashes)
                starts, sizes = A.grouped(hashes[order])
                first = order[starts]
                for low in range(0, len(first), 200_000):
                    part = slice(low, low + 200_000)
                    yield A.table_of(RUNS, context=A.signed(context[first[part]]), suffix=A.signed(suffix[first[part]]), n=sizes[part])
    return run


def _named(batches):
    """The runs with their own hash."""
    for batch in batches:
        context, suffix = (np.asarray(batch.column(i)).view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(A.signed(_joined(context, suffix))), *batch.columns], ["hash", *RUNS.names])


def _grown(texts: DataFrame, shorter: DataFrame, depth: int, least: float, gain: float) -> tuple[DataFrame, DataFrame]:
    """The states of contexts of ``depth`` words.

    ``hash, n, chance, gained`` of every run that occurs often enough: the chance of its last
    word after the others, and what its logarithm has more than that of the shorter context and the
    weight of this one. ``context, weight`` of the retained contexts. ``shorter`` are the runs of ``depth`` words.
    """
    held = send_bitmap(shorter, "hash") if depth > 1 else None
    found = texts.mapInArrow(_runs(depth, held), RUN_TYPES).groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = cut_lineage(found.mapInArrow(_named, "hash long, " + RUN_TYPES))
    # Every context is followed by a token, so it occurs as often as all its successors together.
    entries = cut_lineage(
        found.join(shorter.select(F.col("hash").alias("context"), F.col("n").alias("total")), "context")
        .join(shorter.select(F.col("hash").alias("suffix"), F.col("chance").alias("lower")), "suffix")
        .select("hash", "context", "n", "lower", (F.col("n") / F.col("total")).alias("share"), ((F.col("n") - DISCOUNT) / F.col("total")).alias("own")))
    # Divergence of the successors from those of the suffix; the rest is one class.
    rest, lower_rest = F.greatest(1 - F.sum("share"), F.lit(0.0)), F.greatest(1 - F.sum("lower"), F.lit(1e-12))
    divergence = F.sum(F.col("share") * F.log2(F.col("share") / F.col("lower"))) + F.when(
        rest > 0, rest * F.log2(F.greatest(rest, F.lit(1e-12)) / lower_rest)).otherwise(0.0)
    contexts = cut_lineage(entries.groupBy("context").agg(divergence.alias("divergence"), (1 - F.sum("own")).alias("weight"))
                           .where(F.col("divergence") >= gain).select("context", "weight"))
    chance = F.col("own") + F.col("weight") * F.col("lower")
    runs = cut_lineage(entries.join(contexts, "context", "left").select(
        "hash", "n", F.coalesce(chance, "lower").alias("chance"),
        F.coalesce(F.log10(chance) - F.log10("weight") - F.log10("lower"), F.lit(0.0)).alias("gained")))
    drop_stage(found, entries)
    return runs, contexts


@dataclass
class Frequent:
    """The frequent words and runs, by sorted hash: occurrences of words, 0 for longer runs, and sums of logarithms."""

    hashes: np.ndarray
    times: np.ndarray
    logs: np.ndarray


@dataclass
class SuffixTree:
    """``hash, word, n, logs`` of all words and all runs that change a score, and totals of the training tokens."""

    runs: DataFrame
    tokens: int
    types: int

    def frequent(self) -> Frequent:
        found = self.runs.where(F.col("n") >= F.lit(SENT * self.tokens))
        hashes, times, logs = arrow_columns(found.withColumn("times", F.when(F.col("word"), F.col("n")).otherwise(0)), "hash", "times", "logs")
        hashes = hashes.view(np.uint64)
        order = np.argsort(hashes)
        return Frequent(hashes[order], times[order], logs[order])


def train(texts: DataFrame, counts: DataFrame, share: float = 0.0, depth: int = DEPTH, gain: float = GAIN) -> SuffixTree:
    """Grow the tree from a one-column table of texts and the written counts of its tokens.

    Contexts and successors have at least ``LEAST`` occurrences, and ``share`` of all training tokens.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    tokens, types = total.n or 0, total.types
    least = max(float(LEAST), share * tokens)
    levels = [counts.select("hash", "n", ((F.col("n") + 1.0) / F.lit(float(tokens + types + 1))).alias("chance"), F.lit(0.0).alias("gained"))]
    weights = []
    for d in range(1, depth + 1):
        runs, contexts = _grown(texts, levels[-1], d, least, gain)
        levels.append(runs)
        weights.append(contexts)
    parts = []
    for d, runs in enumerate(levels):
        taken = F.lit(0.0)
        if d < depth:
            # Each run that does not end a text is the context of the token that follows it.
            runs = runs.join(weights[d].withColumnRenamed("context", "hash"), "hash", "left")
            taken = F.coalesce(F.log10("weight"), F.lit(0.0))
        part = runs.select("hash", F.lit(d == 0).alias("word"), "n", (F.col("gained") + taken).alias("logs"))
        parts.append(part if d == 0 else part.where("logs <> 0"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = cut_lineage(whole)
    drop_stage(*levels[1:], *weights)
    return SuffixTree(whole, tokens, types)


DOC = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("tree", pa.float64()), ("root", pa.float64())])
SCORED = pa.schema([("row_key", pa.int64()), ("hash", pa.int64()), ("times", pa.int64()), ("doc", DOC)])
SCORED_TYPES = ("row_key long, hash long, times long, "
                "doc struct<doc_id: long, n_tokens: long, n_known: long, tree: double, root: double>")


def _rare(hashes: np.ndarray, owner: np.ndarray, key: int):
    """Rows of the runs of each text with their occurrences there."""
    own = A.mix(hashes + owner.astype(np.uint64) * A.ODD)
    order = np.argsort(own)
    starts, sizes = A.grouped(own[order])
    first, turn = order[starts], np.argsort(owner[order[starts]], kind="stable")
    first, sizes = first[turn], sizes[turn]
    for low in range(0, len(first), 100_000):
        part = first[low:low + 100_000]
        yield A.table_of(SCORED, row_key=key + owner[part], hash=A.signed(hashes[part]), times=sizes[low:low + 100_000], doc=pa.nulls(len(part), DOC))


def _score(sent, held, whole: float, depth: int):
    """A row for each text, and one for each of its words and runs that may be in the tree and are not frequent."""
    def run(batches):
        key = TaskContext.get().partitionId() << 40
        model = sent.value
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(1)):
                hashes, at = _with_ends(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))
                size = np.diff(at)
                count = len(size)
                owner = np.repeat(np.arange(count), size)
                # As if all that is not frequent were unknown.
                root, tree, known = size * -np.log10(whole), np.zeros(count), np.zeros(count, np.int64)
                for d in range(depth + 1):
                    if d:
                        context, suffix, owner = _longer(hashes, owner)
                        hashes = _joined(context, suffix)
                    place = A.lookup(model.hashes, hashes)
                    sure, there = place[place >= 0], owner[place >= 0]
                    tree += np.bincount(there, model.logs[sure], minlength=count)
                    if not d:
                        root += np.bincount(there, np.log10(model.times[sure] + 1.0), minlength=count)
                        known += np.bincount(there, minlength=count)
                    rare = (place < 0) & may_hold(held.value, hashes)
                    yield from _rare(hashes[rare], owner[rare], key)
                n = np.arange(count)
                doc = pa.StructArray.from_arrays(
                    [batch.column(0)[rows].cast(pa.int64()), *(pa.array(x) for x in (size, known, tree, root))], fields=list(DOC))
                yield A.table_of(SCORED, row_key=key + n, hash=A.signed(A.mix((key + n).astype(np.uint64))), times=np.zeros(count, np.int64), doc=doc)
                key += count
    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def score_documents(docs: DataFrame, depth: int = DEPTH, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Training takes the documents that are not held out; a null id is not. Tokens are words,
    lower-cased in A-Z, and one end. ``base_score`` is the root's log10 probability of the
    text, ``score`` the tree's. A null or empty text is its end alone. Repeated rows are
    learned as often as they occur. Without training rows every word is unknown. Only ``doc_id`` and ``text`` are read.
    """
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = written_counts(training, _tokens)
    tree = train(training, counts, depth=depth, **options)
    drop_stage(counts)
    sent, held = send(docs.sparkSession, tree.frequent()), send_bitmap(tree.runs, "hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(sent, held, float(tree.tokens + tree.types + 1), depth), SCORED_TYPES)
    # The table is smaller than the rows; hashing it spares sorting them.
    found = rows.join(tree.runs.hint("shuffle_hash"), "hash", "left").where("doc is not null or n is not null")
    times = lambda x: F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col("times") * x)), F.lit(0))
    texts = found.groupBy("row_key").agg(
        F.first("doc", ignorenulls=True).alias("doc"), times(F.col("word").cast("long")).alias("seen"),
        times(F.when(F.col("word"), F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("root"), times(F.col("logs")).alias("logs"))
    base = F.col("doc.root") + F.col("root")
    return texts.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "doc.n_tokens", (F.col("doc.n_known") + F.col("seen")).alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("doc.tree") + F.col("logs")).alias("score"))
