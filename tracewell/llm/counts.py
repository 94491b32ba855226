"""Corpus counts of words and of runs of frequent words.

Words are counted by hash over all texts, with sums inside each task before the shuffle.
The frequent words are those with at least ``share`` of all tokens: there are at most
``1 / share`` of them whatever the corpus, so they may be sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm import arrays as A
from tracewell.session import cut_lineage

COUNTS = pa.schema([("hash", pa.int64()), ("n", pa.int64())])
COUNT_TYPES = "hash long, n long"


def counted(values_of):
    """A task function that sums ``values_of(words)``, hashes or packed ids, and puts out sums."""
    def run(batches):
        counter = A.Counter()

        def out():
            values, sums = counter.take()
            for low in range(0, len(values), 200_000):
                yield A.table_of(COUNTS, hash=A.signed(values[low:low + 200_000]), n=sums[low:low + 200_000])

        for batch in batches:
            for _, text, bounds in A.text_slices(batch.column(0)):
                words = A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True)
                for values in values_of(words):
                    counter.add(*A.totals(values))
                if counter.full:
                    yield from out()
        yield from out()
    return run


def count_values(texts: DataFrame, values_of) -> DataFrame:
    """``hash, n`` of all values of a one-column table of texts."""
    return texts.mapInArrow(counted(values_of), COUNT_TYPES).groupBy("hash").agg(F.sum("n").alias("n"))


def word_hashes(words: A.Words):
    yield words.hashes


def arrow_columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of proven size as arrays."""
    found = df.select(*names).toArrow()
    return [found.column(n).to_numpy() for n in names]


@dataclass
class Vocabulary:
    """The frequent words, by sorted hash, with their counts, and totals over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the frequent ones, -1 for all others."""
        return A.lookup(self.hashes, hashes)


def vocabulary(counts: DataFrame, share: float) -> Vocabulary:
    """Frequent words of a ``hash, n`` table that is already written."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    tokens = total.n or 0
    hashes, n = arrow_columns(counts.where((F.col("n") >= F.lit(share * tokens)) & (F.col("n") > 1)), "hash", "n")
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order], tokens, total.types)


def written_counts(texts: DataFrame, values_of) -> DataFrame:
    return cut_lineage(count_values(texts, values_of))
