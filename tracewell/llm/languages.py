"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of n-gram presence: the number of byte
n-grams of ``SIZES`` that both have, over the root of the product of their own numbers.
N-grams are taken of whole texts in which A-Z is lower-cased and any ASCII byte that is no
letter is a blank; those of three bytes and more are told apart by a hash of 16 or 17
bits, so that a text is a set of at most ``BINS`` features whatever its length.

Nystroem: ``LANDMARKS`` texts span the feature space, and a text is its kernel row against
them times the inverse root of the landmarks' own kernel matrix. One ridge regression for
each language (it against the rest) is solved on a sample of ``SAMPLE`` distinct labelled texts a
language, chosen by hash among all of them: a documented bound, as the fit is closed form
and more rows hardly move it. As kernel rows are sums over n-grams, landmarks and weights
fold into one row of weights for each feature; a batch is scored by the product of its
presence matrix, in rows of the features present, with that table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.llm import arrays as A
from tracewell.session import cut_lineage, drop_stage

SIZES = (1, 2, 3, 4)
SHIFTS = (8, 16, 16, 17)  # bits of the features of each size
BINS = sum(1 << s for s in SHIFTS)
LANDMARKS = 256
SAMPLE = 500
RIDGE = 1e-3
# Parts in which the texts of a language are ranked before they are ranked together.
PARTS = 64
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Texts whose presence is marked at once, and the bytes that are read for them at a time.
MARKED = 32
SLICE_BYTES = 1 << 20

FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLDED[0x80:] = np.arange(0x80, 0x100)


def _features(read: np.ndarray) -> list[np.ndarray]:
    """Feature of the n-gram that starts at each byte, for each size; n-grams may cross texts here."""
    out, low, packed = [], 0, np.zeros(len(read), np.uint32)
    for size, bits in zip(SIZES, SHIFTS, strict=True):
        n = max(0, len(read) - size + 1)
        packed = (packed[:n] << np.uint32(8)) | read[size - 1:size - 1 + n]
        code = packed if size * 8 <= bits else (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        out.append(code.astype(np.int32) + low)
        low += 1 << bits
    return out


def presence(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text of a slice, ascending, as one array and its bounds."""
    read = FOLDED[text]
    features = _features(read)
    parts, counts = [], []
    for low in range(0, len(bounds) - 1, MARKED):
        high = min(low + MARKED, len(bounds) - 1)
        marked = np.zeros((high - low, BINS), bool)
        owner = np.repeat(np.arange(high - low, dtype=np.int64) * BINS, np.diff(bounds[low:high + 1]))
        first = bounds[low]
        flat = marked.reshape(-1)
        for size, feature in zip(SIZES, features, strict=True):
            n = max(0, len(owner) - size + 1)
            inside = owner[:n] == owner[size - 1:size - 1 + n]
            flat[(owner[:n] + feature[first:first + n])[inside]] = True
        # Eight marks at a time: nearly all are empty.
        words = np.flatnonzero(flat.view(np.uint64) != 0)
        row, bit = np.nonzero(flat.reshape(-1, 8)[words])
        at = words[row] * 8 + bit
        parts.append(at % BINS)
        counts.append(np.bincount(at // BINS, minlength=high - low))
    present = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return present, np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)


def _product(present: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The presence matrix of a slice times a table of a row for each feature, as many texts at a time as fill a block."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), np.float64)
    # Sums of marks are whole and small enough for single precision.
    wide = np.float32 if table.dtype == np.uint8 else np.float64
    block = max(1, (1 << 22) // table.shape[1])
    low = 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + block, side="right")) - 1)
        filled = np.flatnonzero(np.diff(bounds[low:high + 1])) + low
        if len(filled):
            rows = table[present[bounds[low]:bounds[high]]].astype(wide)
            out[filled] = np.add.reduceat(rows, bounds[filled] - bounds[low])
        low = high
    return out


def _norms(bounds: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diff(bounds), 1))[:, None]


# ---------------------------------------------------------------- training
def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``lang, mark, text``: at most ``sample`` distinct texts of each language, by hash over all labelled rows.

    Copies are one text. Texts without a letter are left out.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    labelled = labelled.select("lang", "text", F.xxhash64("text").alias("mark"))
    # First within parts of a language, so that no task has all texts of a frequent one.
    marks = labelled.select("lang", F.pmod(F.hash("mark"), F.lit(PARTS)).alias("part"), "mark").distinct()
    for by in (("lang", "part"), ("lang",)):
        marks = marks.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("mark"))).where(F.col("rank") <= sample)
    last = cut_lineage(marks.groupBy("lang").agg(F.max("mark").alias("last")))
    return labelled.join(last, "lang").where("mark <= last").dropDuplicates(["lang", "mark"]).select("lang", "mark", "text")


ROWS = pa.schema([("lang", pa.string()), ("mark", pa.int64()), ("values", pa.binary())])
ROW_TYPES = "lang string, mark long, values binary"


def _presence_rows(batches):
    """Each text's features, packed as bits."""
    for batch in batches:
        for rows, text, bounds in A.text_slices(batch.column(2), SLICE_BYTES):
            present, at = presence(text, bounds)
            packed = []
            for i in range(len(at) - 1):
                bits = np.zeros(BINS, np.uint8)
                bits[present[at[i]:at[i + 1]]] = 1
                packed.append(np.packbits(bits).tobytes())
            yield A.table_of(ROWS, lang=batch.column(0)[rows], mark=batch.column(1)[rows], values=pa.array(packed, pa.binary()))


def _kernel_rows(landmarks):
    """Each text's kernel against all landmarks."""
    def run(batches):
        bits = np.unpackbits(landmarks.value, axis=1)
        size = np.sqrt(np.maximum(bits.sum(axis=1), 1))
        table = np.ascontiguousarray(bits.T)
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(2), SLICE_BYTES):
                present, at = presence(text, bounds)
                kernel = _product(present, at, table) / _norms(at) / size
                yield A.table_of(ROWS, lang=batch.column(0)[rows], mark=batch.column(1)[rows],
                                 values=pa.array([k.tobytes() for k in kernel], pa.binary()))
    return run


def _blocks(packed: np.ndarray, width: int = 2048):
    """The landmarks' presence, some features at a time, as numbers."""
    for low in range(0, packed.shape[1], width):
        yield np.unpackbits(packed[:, low:low + width], axis=1).astype(np.float32)


def train(docs: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the weights of each feature for each of them.

    The driver sees the kernel rows of the sample, ``sample`` times ``landmarks`` numbers a
    language, and the landmarks' packed features; all texts stay in the tasks.
    """
    chosen = cut_lineage(training_sample(docs, sample))
    languages = [r.lang for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        drop_stage(chosen)
        return [], np.zeros((BINS, 0), np.float32)
    each = max(1, landmarks // len(languages))
    order = W.partitionBy("lang").orderBy("mark")
    spanning = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("lang", "mark", "text")
    found = spanning.mapInArrow(_presence_rows, ROW_TYPES).orderBy("lang", "mark").limit(max(landmarks, len(languages))).toArrow()
    packed = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in found.column("values")])
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    rows = chosen.mapInArrow(_kernel_rows(sent), ROW_TYPES).orderBy("lang", "mark").toArrow()
    sent.unpersist()
    drop_stage(chosen)
    kernel = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in rows.column("values")])
    wanted = np.array(rows.column("lang").to_pylist(), object)

    counts = np.zeros((len(packed), len(packed)))
    for part in _blocks(packed):
        counts += part @ part.T
    size = np.sqrt(np.maximum(np.diag(counts), 1))
    own = counts / size[:, None] / size
    values, vectors = np.linalg.eigh(own)
    used = values > values.max() * 1e-10
    root = vectors[:, used] / np.sqrt(values[used])
    features = kernel @ root
    target = np.where(wanted[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * len(features) * np.eye(features.shape[1]), features.T @ target)
    weights = ((root @ solved) / size[:, None]).astype(np.float32)
    return languages, np.concatenate([part.T @ weights for part in _blocks(packed)])


# ---------------------------------------------------------------- prediction
def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


JUDGED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
JUDGED_TYPES = "doc_id long, held_out boolean, lang_pred string, score double"


def _judge(model):
    def run(batches):
        languages, weights = model.value
        names = pa.array([*languages, UNKNOWN], pa.string())
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(3), SLICE_BYTES):
                part = batch.slice(rows.start, rows.stop - rows.start)
                n = len(part)
                best, score = np.full(n, len(languages)), np.zeros(n)
                lettered = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if languages:
                    present, at = presence(text, bounds)
                    values = _product(present, at, weights) / _norms(at)
                    best = np.where(lettered, values.argmax(axis=1), len(languages))
                    score = np.where(lettered, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0.0)
                yield A.table_of(JUDGED, doc_id=part.column(0), held_out=part.column(1), lang_pred=names.take(pa.array(best)), score=score)
    return run


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    Learned from text and language of the rows that are not held out and whose language is
    not null; a null id is not held out. ``score`` is the winning regression's value, -1 to 1,
    moved to 0 to 1. A text that is null or has no letter is ``und`` with score 0, as is every
    text if there is nothing to learn from. Of equal values the language first in
    order wins. Repeated rows are judged alike, texts of any length are read whole. Only
    ``doc_id``, ``text`` and ``lang`` are read.
    """
    model = train(docs, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), has_letter(F.col("text")).alias("lettered"), "text")
    return rows.mapInArrow(_judge(sent), JUDGED_TYPES)
