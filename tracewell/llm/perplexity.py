"""Quality rules: text statistics and n-gram perplexity bands.

The language model is an interpolated modified Kneser-Ney trigram model (Chen and
Goodman: "An Empirical Study of Smoothing Techniques for Language Modeling", 1999) over all
words, pairs and triples, counted by Spark over all texts. The model grows with the corpus and stays in tables (:func:`tables`)
of what occurs twice or more; what the texts look up there is sent back to them. A run that is in no table occurs
once, and its chance follows from its count of 1 and the values of its parts, so nothing is left out.

Given shares of all tokens, :func:`train` fits a model of proven size instead, which is sent to
every task: the words of at least ``word_share`` and one class for all others, all their pairs,
and the triples and contexts of at least ``entry_share``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.bitmap import send_bitmap
from tracewell.llm.counts import Vocabulary, arrow_columns, vocabulary, word_hashes, written_counts
from tracewell.llm.runs import count_runs, joined, joined_parts, longer, scores_by_text
from tracewell.llm.sending import send
from tracewell.llm.texts import packed, text_marks
from tracewell.session import cut_lineage, drop_stage, union_stages

WORD_SHARE = 1e-4
ENTRY_SHARE = 1e-6
# Occurrences from which on a pair or triple is in the model: all of them.
LEAST = 1
# Words and runs with so much of all tokens go to every task, at most 1 / SENT of each length.
SENT = 1e-5
MAP_BITS = 28
BEFORE_TEXT, END = (A.mix(np.array([x], np.uint64) * A.STEP)[0] for x in (5, 7))
BITS = 20
START, OTHER, STOP, FIRST_WORD = 0, 1, 2, 3
MASK = (1 << BITS) - 1
LEAST_WORDS = 50
MOST_REPEATED = 50
# Widths of the accepted band in robust standard deviations of log perplexity, below and above the median.
BELOW, ABOVE = 8.0, 6.0
LEAST_SPREAD = 0.02
# A text of so many words has a band wider by the square root of two: its mean varies more.
SHORT_WORDS = 150
SYMBOLS = A.byte_set([(ord(c), ord(c)) for c in "#*$%&|<>"])


def sequences(words: A.Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed histories and ids of every token, the end of each text included, and token bounds."""
    known = vocabulary.ids(words.hashes)
    ids = np.where(known < 0, OTHER, known + FIRST_WORD).astype(np.int64)
    bounds = words.bounds + np.arange(len(words.bounds))
    tokens = np.insert(ids, words.bounds[1:], STOP)
    one, two = np.r_[START, tokens[:-1]], np.r_[START, START, tokens[:-2]][:len(tokens)]
    first = bounds[:-1]
    one[first] = START
    two[first] = START
    second = first + 1
    two[second[second < bounds[1:]]] = START
    return (two << BITS) | one, tokens, bounds


def _trigrams(vocab):
    def values(words: A.Words):
        history, tokens, _ = sequences(words, vocab.value)
        yield ((history << BITS) | tokens).view(np.uint64)
    return values


def _discounts(counts: DataFrame, column: str, single: int = 0) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the counts of counts 1 to 4; ``single`` counts of 1 are not in the table."""
    found = counts.agg(*[F.count_if(F.col(column) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (found[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    n1 += single
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _discounted(n: np.ndarray, discounts) -> np.ndarray:
    return n - np.choose(np.minimum(n, 3).astype(np.int64) - 1, discounts)


@dataclass
class Level:
    """Entries (packed n-gram: probability) and contexts (packed: weight of the shorter context), by sorted hash."""

    grams: np.ndarray
    chances: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _hashed(packed: np.ndarray) -> np.ndarray:
    return A.mix(packed.view(np.uint64) * A.ODD + np.uint64(1))


def _level(grams: DataFrame, column: str, least: float, lower) -> Level:
    """One order of the model; ``lower`` gives probabilities of packed shorter n-grams."""
    discounts = _discounts(grams, column)
    by_context = grams.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum(column).alias("total"))
    context, total = arrow_columns(by_context.where(F.col("total") >= least), "context", "total")
    gram, n = arrow_columns(grams.where(F.col(column) >= least), "gram", column)
    order = np.argsort(context)
    context, total = context[order], total[order]
    at = A.lookup(context, gram >> BITS)
    gram, n, at = gram[at >= 0], n[at >= 0], at[at >= 0]
    share = _discounted(n, discounts) / total[at]
    weights = np.clip(1.0 - np.bincount(at, weights=share, minlength=len(context)), 1e-9, 1.0)
    chances = share + weights[at] * lower(gram & ((1 << (BITS * 2)) - 1) if column == "n" else gram & MASK)
    grams_order, context_order = np.argsort(_hashed(gram)), np.argsort(_hashed(context))
    return Level(_hashed(gram)[grams_order], np.log(chances)[grams_order].astype(np.float32),
                 _hashed(context)[context_order], np.log(weights)[context_order].astype(np.float32))


@dataclass
class KneserNey:
    vocabulary: Vocabulary
    single: np.ndarray
    pairs: Level
    triples: Level
    # Log of the number of words in the class of all others; each gets an equal part of it.
    others: float

    def log_pairs(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = A.lookup(self.pairs.grams, _hashed((history << BITS) | word))
        context = A.lookup(self.pairs.contexts, _hashed(history))
        back = self.single[word] + np.where(context < 0, 0, np.append(self.pairs.weights, 0)[context])
        return np.where(at < 0, back, np.append(self.pairs.chances, 0)[at])

    def score(self, words: A.Words) -> np.ndarray:
        """Natural log probability of each text, its end included."""
        history, tokens, bounds = sequences(words, self.vocabulary)
        at = A.lookup(self.triples.grams, _hashed((history << BITS) | tokens))
        context = A.lookup(self.triples.contexts, _hashed(history))
        back = self.log_pairs(history & MASK, tokens) + np.where(context < 0, 0, np.append(self.triples.weights, 0)[context])
        logs = np.where(at < 0, back, np.append(self.triples.chances, 0)[at]) - self.others * (tokens == OTHER)
        return np.diff(np.r_[0.0, np.cumsum(logs, dtype=np.float64)][bounds])


def train(texts: DataFrame, word_share: float = WORD_SHARE, entry_share: float = ENTRY_SHARE) -> KneserNey:
    """Count a one-column table of texts and fit the model."""
    counts = written_counts(texts, word_hashes)
    vocab = vocabulary(counts, word_share)
    drop_stage(counts)
    sent = send(texts.sparkSession, vocab)
    triples = cut_lineage(
        texts.mapInArrow(_counted(sent), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    # Shorter n-grams count how many words precede them; at the start of a text nothing else can.
    history = F.shiftright("gram", BITS).bitwiseAND(F.lit(MASK))
    pairs = cut_lineage(
        triples.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (2 * BITS)) - 1)).alias("gram"))
        .agg(F.when(F.first(history) == START, F.sum("n")).otherwise(F.count("*")).alias("before")))
    single = pairs.groupBy(F.col("gram").bitwiseAND(F.lit(MASK)).alias("word")).agg(F.count("*").alias("before"))
    word, before = arrow_columns(single, "word", "before")
    size = len(vocab.hashes) + FIRST_WORD
    share = np.full(size, 0.0)
    if len(word):
        d = _discounts(single, "before")
        share[word] = _discounted(before, d) / before.sum()
    one = share + max(0.0, 1.0 - share.sum()) / size
    # Pairs count different words before them, not tokens: a share of the tokens says nothing about them.
    pair_level = _level(pairs, "before", 1.0, lambda w: one[w])
    model = KneserNey(vocab, np.log(one).astype(np.float32), pair_level, pair_level, float(np.log(max(1, vocab.types - len(vocab.hashes)))))
    model.triples = _level(triples, "n", max(1.0, entry_share * vocab.tokens), lambda g: np.exp(model.log_pairs(g >> BITS, g & MASK)))
    drop_stage(triples, pairs)
    return model


def _counted(vocab):
    from tracewell.llm.counts import counted

    return counted(_trigrams(vocab))


# ---------------------------------------------------------------- the model in tables
def _padded(words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of all tokens, two starts before and the end after each text."""
    bounds, count = words.bounds, len(words.bounds) - 1
    size = np.diff(bounds) + 3
    at = np.r_[0, np.cumsum(size)]
    hashes = np.empty(at[-1], np.uint64)
    inside = np.ones(at[-1], bool)
    hashes[at[:-1]] = hashes[at[:-1] + 1] = BEFORE_TEXT
    hashes[at[1:] - 1] = END
    inside[at[:-1]] = inside[at[:-1] + 1] = inside[at[1:] - 1] = False
    hashes[inside] = words.hashes
    return hashes, np.repeat(np.arange(count), size)


def _tokens(words: A.Words):
    hashes, _ = _padded(words)
    yield hashes[hashes != BEFORE_TEXT]


def _pairs(words: A.Words):
    context, suffix, _ = longer(*_padded(words))
    # The pair of two starts precedes no word.
    real = suffix != BEFORE_TEXT
    return context[real], suffix[real]


def _triples(words: A.Words):
    context, suffix, owner = longer(*_padded(words))
    context, suffix, _ = longer(joined(context, suffix), owner)
    return context, suffix


def _all_runs(words: A.Words) -> list[np.ndarray]:
    """Hashes of the words, pairs and triples of each text, with two starts and the end."""
    hashes, owner = _padded(words)
    runs = [hashes]
    for _ in range(2):
        context, suffix, owner = longer(runs[-1], owner)
        runs.append(joined(context, suffix))
    return runs


def _scores(lone: tuple[float, float]):
    """Natural log probabilities of texts from the values of their runs; ``lone`` are those of a pair that occurs once."""
    def score(words: A.Words, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
        _, owner = _padded(words)
        new = owner[1:] != owner[:-1]
        first, last = np.r_[True, new], np.r_[new, True]
        second = np.r_[False, first[:-1]]
        before, word = word[:, ~(first | last)], word[:, ~(first | second)]
        # The pair that ends at a word lies at that word's place, less the first of its text.
        context, suffix = pair[:, ~last[~first]], pair[:, ~second[~first]]
        once = np.isnan(context[0])
        share = np.where(np.isnan(triple[0]), np.where(once, lone[0], context[0]), triple[0])
        weight = np.where(once, lone[1], context[1])
        chance = np.where(np.isnan(suffix[2]), before[0] + before[1] * word[2], suffix[2])
        return np.bincount(owner[~(first | second)], np.log(share + weight * chance), minlength=len(words.bounds) - 1)
    return score


def _less(column: str, discounts) -> Column:
    """A count without its discount."""
    n = F.col(column)
    return n - F.when(n == 1, discounts[0]).when(n == 2, discounts[1]).otherwise(discounts[2])


def _left(taken: Column) -> Column:
    """What a context leaves to the shorter one."""
    return F.greatest(F.least(1 - taken, F.lit(1.0)), F.lit(1e-9))


@dataclass
class Frequent:
    """The frequent words and runs by sorted hash, and their columns of the table."""

    hashes: np.ndarray
    values: list


def tables(texts: DataFrame) -> tuple[DataFrame, int, tuple[float, float]]:
    """``hash, n, share, weight, chance`` of every word and of the pairs and triples that occur twice or more, the number of tokens,
    and ``share, weight`` of a pair that occurs once.

    The ``share`` of a triple is what its context gives it beside ``weight`` times the ``chance`` of the shorter run; that of a word or pair
    is what it gives each run that continues it and occurs once. Counts of what occurs once follow from the totals: a word or pair has as many
    different predecessors as occurrences, less the repetitions of the longer runs that end with it, and as many followers that occur
    once as occurrences that no longer run in the tables begins with.
    """
    words = written_counts(texts, _tokens)
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    tokens, types = total.n or 0, total.types
    start, starts = (int(A.signed(np.array([x], np.uint64))[0]) for x in (BEFORE_TEXT, joined(*[np.array([BEFORE_TEXT])] * 2)[0]))
    ended = words.where(F.col("hash") == F.lit(int(A.signed(np.array([END], np.uint64))[0]))).first()
    pairs = count_runs(texts, _pairs, tokens, 2)
    # One row, with the number of texts, or none.
    ends = lambda hash: texts.sparkSession.range(1 if ended else 0).select(F.lit(hash).alias("hash"), F.lit(ended.n if ended else 0).cast("long").alias("n"))
    held = send_bitmap(pairs.select("hash").unionByName(ends(starts).select("hash")), "hash", MAP_BITS)
    # A triple that occurs twice is made of pairs that do.
    triples = count_runs(texts, _triples, tokens, 2, held)
    # Every executor and the driver keep a file of it.
    held.destroy()

    again = lambda runs: runs.groupBy(F.col("suffix").alias("hash")).agg(F.sum(F.col("n") - 1).alias("again"))
    before = F.when(F.col("context") == start, F.col("n")).otherwise(F.col("n") - F.coalesce("again", F.lit(0)))
    pairs = joined_parts(pairs, triples, "suffix", tokens, lambda part, longer_runs: part.join(again(longer_runs), "hash", "left").select(
        "hash", "context", "suffix", "n", before.alias("before")))
    single = tokens - (triples.agg(F.sum("n")).first()[0] or 0)
    d3 = _discounts(triples, "n", single)
    counted = words
    words = cut_lineage(words.join(again(pairs), "hash", "left").select("hash", "n", (F.col("n") - F.coalesce("again", F.lit(0))).alias("before")))
    drop_stage(counted)
    d1, d2 = _discounts(words, "before"), _discounts(pairs, "before", tokens - (pairs.agg(F.sum("n")).first()[0] or 0))

    enters = F.col("n") >= LEAST
    # What a context gives a run that occurs once, times the total of the context.
    lone2, lone3 = (1 - d[0] if LEAST <= 1 else 0.0 for d in (d2, d3))
    shares = words.agg(F.sum("before").alias("n"), F.sum(_less("before", d1)).alias("kept")).first()
    spare = max(0.0, 1.0 - (shares.kept or 0.0) / max(1, shares.n or 0)) / max(1, types)
    one = _less("before", d1) / float(max(1, shares.n or 0)) + spare
    zero = lambda column: F.coalesce(column, F.lit(0))
    kept = lambda column, discounts: F.sum(F.when(enters, _less(column, discounts))).alias("kept")
    followed = pairs.groupBy(F.col("context").alias("hash")).agg(F.sum("n").alias("again"), F.sum(F.col("n") - F.col("before")).alias("less"), kept("before", d2))
    # A context is followed by as many different pairs as it has occurrences, less the repetitions.
    given = words.select("hash", "n", one.alias("chance")).unionByName(ends(start).withColumn("chance", F.lit(0.0))).join(followed, "hash", "left")
    given = given.withColumn("total", F.col("n") - zero("less"))
    singles = cut_lineage(given.select(
        "hash", "n", "total", (lone2 / F.col("total")).alias("share"),
        _left((zero("kept") + lone2 * (F.col("n") - zero("again"))) / F.col("total")).alias("weight"), "chance"))
    drop_stage(words)
    continued = triples.groupBy(F.col("context").alias("hash")).agg(F.sum("n").alias("again"), kept("n", d3))
    own = F.when(enters, _less("before", d2) / F.col("total")).otherwise(0.0)
    chances = pairs.join(singles.select(F.col("hash").alias("context"), "total", "weight"), "context").join(
        singles.select(F.col("hash").alias("suffix"), F.col("chance").alias("lower")), "suffix").select(
        "hash", "n", (own + F.col("weight") * F.col("lower")).alias("chance"))
    # Nothing ends with the two starts.
    of_pairs = cut_lineage(chances.unionByName(ends(starts).withColumn("chance", F.lit(0.0))).join(continued, "hash", "left").select(
        "hash", "n", (lone3 / F.col("n")).alias("share"),
        _left((zero("kept") + lone3 * (F.col("n") - zero("again"))) / F.col("n")).alias("weight"), "chance"))
    drop_stage(pairs)
    of_triples = cut_lineage(triples.join(of_pairs.select(F.col("hash").alias("context"), F.col("n").alias("total")), "context").select(
        "hash", "n", F.when(enters, _less("n", d3) / F.col("total")).otherwise(0.0).alias("share"),
        F.lit(0.0).alias("weight"), F.lit(0.0).alias("chance")))
    drop_stage(triples)
    return union_stages([singles.drop("total"), of_pairs, of_triples], [singles, of_pairs, of_triples]), tokens, (lone3, max(1 - lone3, 1e-9))


def text_logs(rows: DataFrame) -> DataFrame:
    """``key, logs`` of every key of a table ``key, text``: natural log probability of its text among all texts, its end included."""
    table, tokens, lone = tables(rows.select("text"))
    names = ["share", "weight", "chance"]
    hashes, *values = arrow_columns(table.where(F.col("n") >= F.lit(SENT * tokens)), "hash", *names)
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    model = send(rows.sparkSession, Frequent(hashes[order], [v[order] for v in values]))
    held = send_bitmap(table, "hash", MAP_BITS)
    found = scores_by_text(rows, _all_runs, _scores(lone), table, names, model, held, tokens)
    found = cut_lineage(found.select("key", F.col("score").alias("logs")))
    drop_stage(table)
    held.destroy()
    model.broadcast.destroy()
    return found


# ---------------------------------------------------------------- text statistics
def _sums(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(marked, dtype=np.int64)][bounds])


def _distinct(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    keys, first = np.unique(A.mix(hashes + owner.astype(np.uint64) * A.ODD), return_index=True)
    return np.bincount(owner[first], minlength=texts)


def repeated_words(words: A.Words) -> np.ndarray:
    """Words in three-word windows that their text holds twice or more."""
    owner = words.owner
    keys = A.mix(A.rolling(words.hashes, 3) + owner[:max(0, len(owner) - 2)].astype(np.uint64) * A.ODD)
    whole = np.flatnonzero(A.within_text(owner, 3))
    ordered = whole[np.argsort(keys[whole])]
    starts, sizes = A.grouped(keys[ordered])
    again = ordered[np.repeat(sizes > 1, sizes)]
    covered = np.zeros(len(owner), bool)
    for j in range(3):
        covered[again + j] = True
    return np.bincount(owner[covered], minlength=len(words.bounds) - 1)


def statistics(words: A.Words) -> dict[str, np.ndarray]:
    text, bounds = words.text, words.text_bounds
    letters = (text & 0xC0) != 0x80
    first, last, at = A.spans(text, bounds, text != 0x0A)
    line_owner = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    used = np.searchsorted(words.starts, last) > np.searchsorted(words.starts, first)
    lines = A.hash_spans(text, first, last)[used]
    line_owner = line_owner[used]
    return {
        "n_words": words.counts,
        "word_chars": _sums(A.BETWEEN_SPACES[text] & letters, bounds),
        "n_symbols": _sums(SYMBOLS[text], bounds),
        "n_dup_lines": np.bincount(line_owner, minlength=len(bounds) - 1) - _distinct(line_owner, lines, len(bounds) - 1),
        "n_repeat_words": repeated_words(words),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_a", pa.int64()), ("text_b", pa.int64()),
                      *[(m, pa.int64()) for m in MEASURES], ("log_perplexity", pa.float64())])
MEASURED_TYPES = "doc_id long, lang string, text_a long, text_b long, " + ", ".join(f"{m} long" for m in MEASURES) + ", log_perplexity double"


def _measure(model):
    def run(batches):
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(4)):
                found = statistics(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=False))
                logs = np.zeros(len(bounds) - 1)
                if model is not None:
                    logs = model.value.score(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield A.table_of(MEASURED, **{MEASURED.field(i).name: part.column(i) for i in range(4)}, **found,
                                 log_perplexity=-logs / (found["n_words"] + 1))
    return run


def quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, **model_options) -> DataFrame:
    """Statistics, ``log_perplexity``, its band and the verdict of every row of ``docs``.

    ``base_failed`` marks texts of fewer than 50 words or with more than half of their
    words in repeated three-word windows. Of the others, ``kept`` are those whose log
    perplexity lies within the band of their language: from ``below`` robust standard
    deviations under the median of its distinct texts to ``above`` over it, wider for short texts. A null language is one
    of its own; a null text has no words. An empty table gives no rows. Columns other
    than ``doc_id, lang, text`` are not read. ``model_options`` (shares, see :func:`train`) ask for a model of
    proven size instead of all words, pairs and triples.
    """
    model = send(docs.sparkSession, train(docs.select("text"), **model_options)) if model_options else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", *text_marks(F.col("text")), "text")
    measured = rows.mapInArrow(_measure(model), MEASURED_TYPES)
    if model is None:
        key = lambda text_a, text_b: F.xxhash64("doc_id", text_a, text_b).alias("key")
        logs = text_logs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(key(*text_marks(F.col("text"))), "text"))
        measured = measured.withColumn("key", key(F.col("text_a"), F.col("text_b"))).join(logs, "key").withColumn(
            "log_perplexity", -F.col("logs") / (F.col("n_words") + 1)).drop("key", "logs")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = cut_lineage(measured.withColumn("base_failed", failed))
    # A text counts once for the band, however many copies it has; its copies differ in nothing that is measured.
    judged = cut_lineage(measured.where("not base_failed").groupBy("lang", "text_a", "text_b").agg(F.min("log_perplexity").alias("log_perplexity")))
    middle = cut_lineage(judged.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")))
    same = lambda x, y: F.col(f"{x}.lang").eqNullSafe(F.col(f"{y}.lang"))
    spread = judged.alias("j").join(middle.alias("m"), same("j", "m")).groupBy("m.lang", "m.middle").agg(
        (1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000)).alias("spread"))
    bands = cut_lineage(spread.select("lang", "middle", F.greatest("spread", F.lit(LEAST_SPREAD)).alias("spread")))
    wide = F.col("spread") * F.sqrt(1 + F.lit(SHORT_WORDS) / F.greatest("n_words", F.lit(1)))
    joined = measured.alias("d").join(bands.alias("b"), same("d", "b"), "left").withColumns(
        {"least": F.col("middle") - below * wide, "most": F.col("middle") + above * wide})
    inside = F.col("log_perplexity").between(F.col("least"), F.col("most"))
    return joined.select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "log_perplexity", "least", "most", F.col("d.lang").alias("lang"), "text_a", "text_b")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns, whatever their names.

    A null, empty or blank text has too few words and goes; repeated rows stay or go together; texts of any
    length are read whole. An empty table stays empty.
    """
    marks = dict(zip(("_text_a", "_text_b"), text_marks(F.col("_row.text")), strict=True))
    bad = cut_lineage(quality(docs, **options).where("not kept").select(
        F.col("text_a").alias("_text_a"), F.col("text_b").alias("_text_b"), F.col("lang").alias("_lang")).distinct())
    rows = packed(docs).withColumns(marks)
    same = (rows["_text_a"] == bad["_text_a"]) & (rows["_text_b"] == bad["_text_b"]) & rows["_row.lang"].eqNullSafe(bad["_lang"])
    return rows.join(bad, same, "left_anti").select("_row.*")
