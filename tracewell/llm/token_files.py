"""Token ids in bit-plane files.

The ids of all documents, in ascending id order and each document closed by an end id,
form one sequence. It is cut into files of whole documents and files into chunks of
``CHUNK`` ids. A chunk stores bit b of all its ids as plane b, each plane packed and
compressed with zstandard on its own: high planes of small or similar ids are almost
nothing. Each chunk row carries its index entry (file, first position, number of ids,
plane sizes), each document row its file, position and length, so a reader takes only the
chunks that hold a document. Spark's Parquet files are the container: they are written by
its commit protocol to any store, and the index columns are read without the planes.
"""

from __future__ import annotations

import itertools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.texts import text_marks
from tracewell.session import cut_lineage, shared_dir

CHUNK = 1 << 16
END_ID = 1
FILE_BYTES = 32 << 20
# Pieces that an encoder remembers, about 50 bytes each, and those it adds between two merges of its tables.
CACHE = 600_000
YOUNG = 60_000
# Bytes of text encoded at a time.
ENCODED_BYTES = 1 << 20
TOKEN_ID = operator.attrgetter("id")


# ---------------------------------------------------------------- encoding
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1, then 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that start at ``first`` and have ``count`` values, one after the other."""
    ends = np.cumsum(count)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)]


LETTER = A.byte_set([(0x41, 0x5A), (0x61, 0x7A)])
# Second bytes of the letters U+00C0 to U+00FF, without the two signs among them.
AFTER_LEAD = A.byte_set([(0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)])
# Punctuation that no special token and no contraction begins with.
MARK = A.byte_set([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3D, 0x3D), (0x3F, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)])


def _pieces(text: np.ndarray, words: A.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kind (is it a word of Latin letters?) of the pieces of runs, and the bounds of texts.

    A run of letters with closing punctuation is two pieces; any other run is one.
    """
    after = np.zeros(len(text), bool)
    lead = text == 0xC3
    after[1:] = lead[:-1]
    follow = np.zeros(len(text), bool)
    follow[:-1] = AFTER_LEAD[text[1:]]
    letter = LETTER[text] | (lead & follow) | (after & AFTER_LEAD[text])
    letters, marks = (np.r_[0, np.cumsum(m, dtype=np.int32)] for m in (letter, MARK[text]))
    starts, ends = words.starts, words.ends
    size = letters[ends] - letters[starts]
    middle = starts + size
    plain = (size > 0) & (letters[middle] - letters[starts] == size) & (marks[ends] - marks[middle] == ends - middle)
    split = plain & (middle < ends)
    # A split run takes two places.
    place = np.arange(len(starts)) + np.r_[0, np.cumsum(split)[:-1]] if len(starts) else np.zeros(0, np.int64)
    total = len(starts) + int(split.sum())
    first, last, kind = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    first[place], last[place], kind[place] = starts, np.where(split, middle, ends), plain
    first[place[split] + 1], last[place[split] + 1] = middle[split], ends[split]
    bounds = np.append(place, total)[words.bounds]
    return first, last, kind, bounds


class _Table:
    """Known pieces by sorted hash: a second mark of each, where its ids start and how many they are, and its uses."""

    def __init__(self):
        self.keys, self.marks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.marks, self.first, self.count, self.used

    def put(self, *columns: np.ndarray) -> None:
        joined = [np.concatenate([mine, theirs.astype(mine.dtype)]) for mine, theirs in zip(self.columns(), columns, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.keys, self.marks, self.first, self.count, self.used = (c[order] for c in joined)

    def keep(self, chosen: np.ndarray) -> None:
        self.keys, self.marks, self.first, self.count, self.used = (c[chosen] for c in self.columns())


class Encoder:
    """Ids of texts, each distinct piece encoded once and remembered while it is in use.

    ``direct`` vocabularies drop white space and split letters from all else, so a text's ids are those
    of its runs between white space, and a run of Latin letters with closing punctuation is two pieces.
    Such letters need neither normalising nor splitting and go to the vocabulary's merges directly; all other
    runs take the whole way. Pieces are told apart by a hash of 64 bits and a second mark. Texts of any
    other vocabulary are encoded whole.
    """

    def __init__(self, path: str, direct: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Kept, since each look-up of the attribute makes a new wrapper.
        self.merge = self.tokenizer.model.tokenize
        self.direct = direct
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.old, self.young, self.ids = _Table(), _Table(), np.zeros(0, np.uint32)

    def _whole(self, run: bytes) -> list[int]:
        return self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _word(self, word: bytes) -> list[int]:
        lower = word.lower().decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(self.letters)
        return list(map(TOKEN_ID, self.merge(lower)))

    def _settle(self) -> None:
        """Move young pieces to the large table; if that is full, forget all that occurred once and the least used half."""
        self.old.put(*self.young.columns())
        self.young = _Table()
        if len(self.old.keys) <= CACHE:
            return
        often = np.flatnonzero(self.old.used > 1)
        if len(often) > CACHE // 2:
            often = np.sort(often[np.argpartition(-self.old.used[often], CACHE // 2)[:CACHE // 2]])
        self.old.keep(often)
        self.ids = _gathered(self.ids, self.old.first, self.old.count)
        self.old.first = np.cumsum(self.old.count, dtype=np.int64) - self.old.count
        # Older uses weigh half, so pieces of earlier texts give way.
        self.old.used = self.old.used // 2

    def encode(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids of each text of a slice."""
        if not self.direct:
            made = [self._whole(text[bounds[i]:bounds[i + 1]].tobytes()) for i in range(len(bounds) - 1)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            return np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes
        if len(self.young.keys) > YOUNG:
            self._settle()
        starts, ends, kind, at = _pieces(text, A.words_of(text, bounds, A.BETWEEN_SPACES, lower=False))
        hashes = A.hash_spans(text, starts, ends)
        keys, sample, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        low, high = starts[sample], ends[sample]
        marks = ((high - low).astype(np.uint64) << np.uint64(32)) | (text[low].astype(np.uint64) << np.uint64(16)) | (
            text[(low + high) // 2].astype(np.uint64) << np.uint64(8)) | text[high - 1]
        first, count, new = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        known = np.zeros(len(keys), bool)
        for table in (self.old, self.young):
            found = A.lookup(table.keys, keys)
            here = np.flatnonzero(found >= 0)
            found = found[here]
            known[here] = True
            same = table.marks[found] == marks[here]
            here, found = here[same], found[same]
            first[here], count[here], new[here] = table.first[found], table.count[found], False
            table.used[found] += times[here].astype(np.int32)
        fresh = np.flatnonzero(new)
        raw = text.tobytes()
        made = [self._word(raw[i:j]) if word else self._whole(raw[i:j])
                for i, j, word in zip(low[fresh].tolist(), high[fresh].tolist(), kind[sample[fresh]].tolist(), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        first[fresh], count[fresh] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.r_[self.ids, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum()))]
        # A piece whose hash belongs to another one is not remembered.
        added = fresh[~known[fresh]]
        self.young.put(keys[added], marks[added], first[added], count[added], times[added])
        per_piece = count[inverse]
        return _gathered(self.ids, first[inverse], per_piece), np.diff(np.r_[0, np.cumsum(per_piece)][at])


def direct_words(path: str) -> bool:
    """Does the vocabulary lower-case, drop white space and split letters from all else, bytewise and merged?"""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    rule = split[0].get("pattern", {}).get("Regex", "")
    return (steps == ["NFC", "Replace", "Lowercase"] and rule.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
            and [s["type"] for s in split] == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE")


# ---------------------------------------------------------------- planes
def pack_planes(ids: np.ndarray) -> list[bytes]:
    """Compressed bit planes of a chunk, lowest bit first, up to the highest bit in use."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    squeeze = zstandard.ZstdCompressor(level=3)
    out = []
    for plane in range(bits):
        column = np.ascontiguousarray(octets[:, plane // 8]) >> np.uint8(plane % 8) & np.uint8(1)
        out.append(squeeze.compress(np.packbits(column, bitorder="little").tobytes()))
    return out


def unpack_planes(planes: list[bytes], count: int) -> np.ndarray:
    octets = np.zeros((4, count), np.uint8)
    expand = zstandard.ZstdDecompressor()
    for plane, packed in enumerate(planes):
        column = np.unpackbits(np.frombuffer(expand.decompress(packed), np.uint8), count=count, bitorder="little")
        octets[plane // 8] |= column << np.uint8(plane % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


STORED = pa.schema([
    ("file", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("is_document", pa.bool_()), ("planes", pa.list_(pa.binary())),
])
STORED_TYPES = "file int, first long, n long, doc_id long, is_document boolean, planes array<binary>"


def _document_rows(file, firsts, sizes, ids):
    n = len(firsts)
    return A.table_of(STORED, file=np.full(n, file, np.int32), first=np.array(firsts, np.int64), n=np.array(sizes, np.int64), doc_id=pa.array(ids, pa.int64()),
                      is_document=np.ones(n, bool), planes=pa.nulls(n, pa.list_(pa.binary())))


def _chunk_row(file, first, ids):
    return A.table_of(STORED, file=[file], first=[first], n=[len(ids)], doc_id=pa.nulls(1, pa.int64()), is_document=[False],
                      planes=pa.array([pack_planes(ids)], pa.list_(pa.binary())))


def _write_file(path: str, end_id: int, dtype: str):
    """Chunk and document rows of one file from its documents in order; one chunk is held at a time."""
    def run(batches):
        file = TaskContext.get().partitionId()
        encoder, first, held, size, total = None, 0, [], 0, 0
        for batch in batches:
            for rows, text, bounds in A.text_slices(batch.column(1), ENCODED_BYTES):
                encoder = encoder or Encoder(path, direct_words(path))
                ids, sizes = encoder.encode(text, bounds)
                # The end id goes behind each text.
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(dtype)
                sizes = sizes + 1
                yield _document_rows(file, total + np.cumsum(sizes) - sizes, sizes, batch.column(0)[rows])
                total += len(ids)
                while size + len(ids) >= CHUNK:
                    cut = CHUNK - size
                    yield _chunk_row(file, first, np.concatenate([*held, ids[:cut]]))
                    first, held, size, ids = first + CHUNK, [], 0, ids[cut:]
                if len(ids):
                    held.append(ids.copy())
                    size += len(ids)
        if size:
            yield _chunk_row(file, first, np.concatenate(held))
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` and write the sequence to ``path``.

    Documents come in ascending ``doc_id`` order, null first, rows with one id in an order
    that follows from their texts. A null or empty text is the end id alone. No documents
    make an empty table. Only ``doc_id`` and ``text`` are read; a text of any length is encoded
    whole, and one task holds one text, one slice of ids and one chunk.
    """
    from tokenizers import Tokenizer

    highest = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id)
    dtype = "<u2" if highest < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_marks(F.col("text")), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Files are ranges of the order, cut by a sample of it; equal rows are told apart so that ranges may part them.
    order = ["doc_id", "text_a", "text_b", "copy"]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(int(size // FILE_BYTES + 1), *order)
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_write_file(tokenizer, end_id, dtype), STORED_TYPES).write.option("compression", "none").parquet(path)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of documents from chunk and document rows in file order; chunks pass by once."""
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    file, low, ids, waiting = None, 0, np.zeros(0, "<u4"), []
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["file"] != file:
                file, low, ids, waiting = row["file"], 0, np.zeros(0, "<u4"), []
            if row["is_document"]:
                waiting.append([row["doc_id"], row["first"], row["first"] + row["n"], row["first"], 0])
            else:
                low, ids = row["first"], unpack_planes(row["planes"], row["n"])
            # A document takes what the present chunk has of it; what is missing comes later.
            for w in waiting:
                start, end = max(w[3], low), min(w[2], low + len(ids))
                if start < end and start == w[3]:
                    w[4] = zlib.crc32(ids[start - low:end - low].tobytes(), w[4])
                    w[3] = end
            done += [(w[0], file, w[1], w[2] - w[1], w[4]) for w in waiting if w[3] == w[2]]
            waiting = [w for w in waiting if w[3] < w[2]]
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield A.table_of(schema, **{f.name: pa.array(columns[i], f.type) for i, f in enumerate(schema)})


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    from pyspark.sql import Window as W

    stored = spark.read.parquet(path)
    sizes = stored.where("not is_document").groupBy("file").agg(F.sum("n").alias("n"))
    # One row for each file of about ``FILE_BYTES`` of text.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base")))
    files = (starts.agg(F.max("file")).first()[0] or 0) + 1
    order = ["file", "first", "is_document"]
    read = stored.repartitionById(files, F.col("file")).sortWithinPartitions(*order).mapInArrow(
        _read_documents, "doc_id long, file int, first long, n_tokens long, ids_crc32 long")
    return read.join(starts, "file").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a fresh folder below the shared one and read the documents back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
