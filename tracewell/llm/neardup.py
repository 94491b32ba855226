"""MinHash near-duplicates of documents over shingles of words.

Sketches follow Dahlgaard, Knudsen and Thorup ("Fast Similarity Sketching", FOCS 2017): in
each round every shingle falls into one hashed bin, later rounds only fill bins that are
still empty, and after as many rounds as there are bins each round is tied to one bin,
so every coordinate is filled; agreement of coordinates is concentrated around the
Jaccard similarity. Bands of coordinates give candidates, which are checked on the full
shingle sets.

Large groups of copies never become pairs. Equal sets are one node from the start.
Within a band bucket, tasks of at most ``TILE`` nodes tie nodes whose sketches come near
the threshold into a forest; a larger bucket is tied whole. The candidate groups that
result are checked in tiles of at most ``TILE`` nodes per side, and each tile returns a
forest of its confirmed links, so rows grow with nodes. Only tiles that can still join
different components are looked at across blocks. No link that a candidate group holds
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewell.llm import arrays as A
from tracewell.llm.bitmap import may_hold, send_bitmap
from tracewell.llm.graph import components
from tracewell.llm.texts import packed, text_marks
from tracewell.session import cut_lineage, drop_stage

SHINGLE = 5
BANDS, WIDTH = 32, 6
BINS = BANDS * WIDTH
TILE = 512
PAIRWISE = 24
# Sketch agreement is within this of the similarity but for one pair in 10^6.
SKETCH_SLACK = 0.14


# ---------------------------------------------------------------- shingles and sketches
def shingle_sets(words: A.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds.

    A text with fewer than k words has its whole sequence as the only shingle, a text
    without words none.
    """
    runs = A.rolling(words.hashes, k)
    parts, sizes = [], []
    for i, n in enumerate(words.counts):
        at = words.bounds[i]
        if n >= k:
            part = np.unique(runs[at:at + n - k + 1])
        elif n:
            part = A.rolling(words.hashes[at:at + n], int(n))
        else:
            part = runs[:0]
        parts.append(part)
        sizes.append(len(part))
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return joined, np.r_[0, np.cumsum(sizes)].astype(np.int64)


def sketches(values: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sketch of each set: ``bins`` coordinates, all filled; an empty set keeps empty ones."""
    sets = len(bounds) - 1
    sketch = np.full(sets * bins, A.NONE)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    for step in range(2 * bins):
        if not len(values):
            break
        x = A.mix(values ^ A.mix(np.full(1, step + 1, np.uint64) * A.ODD))
        low = (x & np.uint64((1 << 48) - 1)) | np.uint64(step << 48)
        if step < bins:
            place = ((x >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64)
        else:
            place = np.full(len(x), step - bins)
        np.minimum.at(sketch, owner * bins + place, low)
        open_sets = (sketch.reshape(sets, bins) == A.NONE).any(axis=1)
        keep = open_sets[owner]
        values, owner = values[keep], owner[keep]
    return sketch.reshape(sets, bins)


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    coordinates = sketch.reshape(len(sketch), BANDS, WIDTH)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), BANDS)).copy()
    for j in range(WIDTH):
        total = A.mix(total * A.STEP + coordinates[:, :, j])
    return total


def set_marks(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that name a set."""
    marks = []
    for salt in (1, 2):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(A.mix(values * A.ODD + np.uint64(salt)))]
        marks.append(A.mix(sums[bounds[1:]] - sums[bounds[:-1]]))
    return marks[0], marks[1]


SIGNATURES = pa.schema([
    ("row_key", pa.int64()), ("doc_id", pa.int64()), ("text_a", pa.int64()), ("text_b", pa.int64()), ("n_shingles", pa.int64()), ("mark_a", pa.int64()), ("mark_b", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("sig", pa.binary()),
])
SIGNATURE_TYPES = "row_key long, doc_id long, text_a long, text_b long, n_shingles long, mark_a long, mark_b long, bands array<long>, sig binary"
SET_TYPES = "mark_a long, mark_b long, shingles binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        for rows, text, bounds in A.text_slices(batch.column(1)):
            words = A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True)
            values, at = shingle_sets(words)
            sketch = sketches(values, at)
            n = np.diff(at)
            a, b = set_marks(values, at)
            bands = A.signed(band_hashes(sketch)[n > 0].ravel())
            ends = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
            short = (A.mix(sketch) & np.uint64(255)).astype(np.uint8)
            yield A.table_of(
                SIGNATURES, row_key=key + np.arange(len(n)), doc_id=batch.column(0)[rows],
                text_a=batch.column(2)[rows], text_b=batch.column(3)[rows], n_shingles=n, mark_a=A.signed(a), mark_b=A.signed(b),
                bands=pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)), sig=pa.array([r.tobytes() for r in short], pa.binary()),
            )
            key += len(n)


def _sets_of(wanted):
    """Shingle sets of the documents whose id may be wanted."""
    schema = pa.schema([("mark_a", pa.int64()), ("mark_b", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        bitmap = wanted.value
        for batch in batches:
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(may_hold(bitmap, ids)))
            for _, text, bounds in A.text_slices(batch.column(1)):
                values, at = shingle_sets(A.words_of(text, bounds, A.BETWEEN_SPACES, lower=True))
                a, b = set_marks(values, at)
                sets = [values[at[i]:at[i + 1]].tobytes() for i in range(len(at) - 1)]
                yield A.table_of(schema, mark_a=A.signed(a), mark_b=A.signed(b), shingles=pa.array(sets, pa.binary()))
    return run


# ---------------------------------------------------------------- groups of sorted rows
def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by their first ``keys`` columns, many groups at a time."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        marks = [held.column(i).to_numpy() for i in range(keys)]
        changes = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        if len(changes):
            yield held.slice(0, changes[-1]).combine_chunks()
            held = held.slice(changes[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _group_numbers(table: pa.Table, keys: int) -> np.ndarray:
    marks = [table.column(i).to_numpy() for i in range(keys)]
    return np.r_[0, np.cumsum(np.any([m[1:] != m[:-1] for m in marks], axis=0))].astype(np.int64)


def _root(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(pairs) -> list[tuple[int, int]]:
    parent, kept = {}, []
    for x, y in pairs:
        a, b = _root(parent, x), _root(parent, y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(a, b) -> pa.RecordBatch:
    return A.table_of(EDGES, a=np.asarray(a, np.int64), b=np.asarray(b, np.int64))


def _sketch_links(least: int):
    """Within sorted (bucket, block) groups: a forest over nodes whose sketches agree enough."""
    def run(batches):
        for table in sorted_groups(batches, 2):
            group = _group_numbers(table, 2)
            node = table.column("node").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, BINS)
            found = []
            for d in range(1, len(group)):
                at = np.flatnonzero(group[d:] == group[:-d])
                if not len(at):
                    break
                for part in np.array_split(at, len(at) // 20_000 + 1):
                    near = part[(sig[part] == sig[part + d]).sum(axis=1) >= least]
                    found.append(np.stack([node[near], node[near + d]], 1))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            kept = np.array(_forest(map(tuple, pairs.tolist())), np.int64).reshape(-1, 2)
            yield _edge_batch(kept[:, 0], kept[:, 1])
    return run


def _confirmed(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Forest of the pairs with 100 * intersection >= percent * union."""
    parent, kept = {}, []
    sizes = np.array([len(s) for s in sets])

    def link(i, j):
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((int(nodes[i]), int(nodes[j])))

    if len(sets) <= PAIRWISE:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                small, large = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                if 100 * small < percent * large or _root(parent, i) == _root(parent, j):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (small + large - both):
                    link(i, j)
        return kept
    # Intersections of all pairs at once: products of 0/1 blocks over shingles held by two or more.
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts, counts = A.grouped(values)
    column = np.repeat(np.arange(len(starts)), counts)
    shared = np.repeat(counts > 1, counts)
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for low in range(0, width, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((len(sets), min(4096, width - low)), np.float32)
        block[owner[i:j], column[i:j] - low] = 1
        both += block @ block.T
    both = both.astype(np.int64)
    linked = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    for i, j in zip(*np.nonzero(linked), strict=True):
        link(int(i), int(j))
    return kept


def _exact_links(percent: int):
    """Within sorted (group, tile) rows: a forest over nodes with confirmed links."""
    def run(batches):
        for table in sorted_groups(batches, 2):
            starts, sizes = A.grouped(_group_numbers(table, 2))
            node, raw = table.column("node").to_numpy(), table.column("shingles").to_pylist()
            a, b = [], []
            for at, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                first = {int(x): i for i, x in reversed(list(enumerate(node[at:at + n], at)))}
                names = np.array(list(first))
                for x, y in _confirmed(names, [np.frombuffer(raw[i], np.uint64) for i in first.values()], percent):
                    a.append(x)
                    b.append(y)
            yield _edge_batch(a, b)
    return run


def _in_groups(rows: DataFrame, function) -> DataFrame:
    """Run an edge function over rows with ``grp, tile, node, ...``, sorted by group and tile."""
    return rows.repartition("grp", "tile").sortWithinPartitions("grp", "tile").mapInArrow(function, "a long, b long")


# ---------------------------------------------------------------- the operator
def _candidate_groups(nodes: DataFrame, percent: int) -> DataFrame:
    """``node, grp``: nodes tied by bands and sketches; every link lies within a group."""
    least = int(np.floor(BINS * max(0.0, percent / 100 - SKETCH_SLACK)))
    banded = cut_lineage(nodes.select("node", F.explode("bands").alias("grp")))
    shared = banded.groupBy("grp").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = cut_lineage(banded.join(shared, "grp"))
    drop_stage(banded)
    small = members.where(F.col("n") <= TILE).select("grp", F.lit(0).alias("tile"), "node")
    signed = small.join(nodes.select("node", "sig"), "node").select("grp", "tile", "node", "sig")
    near = _in_groups(signed, _sketch_links(least))
    whole = members.where((F.col("n") > TILE) & (F.col("node") > F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges = cut_lineage(near.unionByName(whole))
    groups = cut_lineage(components(edges).withColumnRenamed("component", "grp"))
    drop_stage(members, edges)
    return groups


def _blocks(column: str, count) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(17)), count).cast("int")


def _confirmed_links(sets: DataFrame, percent: int) -> DataFrame:
    """Forest of confirmed links within groups; ``sets`` has ``grp, node, shingles``."""
    sized = sets.join(sets.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "grp")
    inside = cut_lineage(_in_groups(
        sized.select("grp", _blocks("node", F.col("blocks")).alias("tile"), "node", "shingles"), _exact_links(percent)))
    large = cut_lineage(sized.where("blocks > 1").select("grp", "node", "blocks"))
    if large.isEmpty():
        return inside
    # Groups of several blocks: all but the largest component so far is compared with all of the group.
    found = components(inside).select("node", "component")
    labelled = cut_lineage(large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = labelled.groupBy("grp", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    rest = labelled.join(main, "grp").where("component <> main")
    rests = rest.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("rests"))
    left = rest.join(rests, "grp").select(
        "grp", "node", _blocks("node", F.col("rests")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    right = labelled.join(rests, "grp").select(
        "grp", "node", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("x"), _blocks("node", F.col("blocks")).alias("y"))
    tiles = left.unionByName(right).select("grp", (F.col("x") * F.lit(1 << 20) + F.col("y")).alias("tile"), "node")
    across = _in_groups(tiles.join(sets.select("node", "shingles"), "node").select("grp", "tile", "node", "shingles"), _exact_links(percent))
    return inside.unionByName(cut_lineage(across))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, one, text_a, text_b`` of every row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    five-word shingles; ``component_id`` is the smallest id that links reach and ``kept``
    marks it. A null or empty text has no shingles and is linked with nothing; rows with
    that id are all kept, since they are the same document; a null id is kept only if no
    linked row has an id. ``one`` marks exactly one row of each component. ``text_a,
    text_b`` name the text. Only ``doc_id`` and ``text`` are read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_marks(F.col("text")))
    signed = cut_lineage(source.mapInArrow(_signatures, SIGNATURE_TYPES))
    # Equal sets are one node, named by its smallest row.
    name = ["n_shingles", "mark_a", "mark_b"]
    nodes = cut_lineage(
        signed.where("n_shingles > 0").groupBy(*name)
        .agg(F.min(F.struct("row_key", "doc_id")).alias("first"), F.min("doc_id").alias("least_doc"))
        .select(*name, F.col("first.row_key").alias("node"), F.col("first.doc_id").alias("node_doc"), "least_doc"))
    drawn = nodes.select("node").join(signed.select(F.col("row_key").alias("node"), "bands", "sig"), "node")
    groups = _candidate_groups(cut_lineage(drawn), percent)
    wanted = cut_lineage(nodes.join(groups, "node").select("node", "grp", "mark_a", "mark_b", F.xxhash64("node_doc").alias("id_hash")))
    bitmap = send_bitmap(wanted.select("id_hash"), "id_hash")
    sets = source.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash")).mapInArrow(_sets_of(bitmap), SET_TYPES)
    sets = cut_lineage(sets.join(wanted.select("node", "grp", "mark_a", "mark_b"), ["mark_a", "mark_b"])
                       .select("grp", "node", "shingles"))
    links = components(_confirmed_links(sets, percent))
    named = nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.groupBy("component").agg(
        F.min(F.struct(F.col("least_doc").isNull(), "least_doc", "node")).alias("best"))
    named = cut_lineage(named.join(best, "component").select(
        *name, F.col("best.least_doc").alias("component_id"), (F.col("best.node") == F.col("node")).alias("holds_one")))
    drop_stage(sets, wanted)
    joined = signed.drop("bands", "sig").join(named, name, "left")
    # The one row of a set is that with its smallest id, and of equal ids the first.
    firsts = signed.where("n_shingles > 0").groupBy(*name).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("first_row"))
    joined = joined.join(firsts, name, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    one = (F.col("n_shingles") == 0) | (F.col("holds_one") & (F.col("row_key") == F.col("first_row")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), one.alias("one"), "text_a", "text_b")


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates.

    Null, empty and blank texts are in no group and stay. Of rows with one id and text but other columns
    that differ, those of smallest row hash stay, so reruns agree. Texts of any length are read
    whole; columns may have any names; an empty table stays empty.
    """
    key = ["_id", "text_a", "text_b"]
    found = near_duplicates(docs, percent).groupBy(F.xxhash64("doc_id").alias("_id"), "text_a", "text_b").agg(
        F.count_if("one").alias("_stay"), F.count("*").alias("_rows")).where("_stay > 0")
    found = cut_lineage(found)
    rows = packed(docs).withColumns(
        {"_id": F.xxhash64(F.col("_row.doc_id").cast("long"))} | dict(zip(key[1:], text_marks(F.col("_row.text")), strict=True)))
    whole = rows.join(found.where("_stay = _rows"), key, "left_semi")
    some = rows.join(found.where("_stay < _rows").drop("_rows"), key)
    turn = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("_row")))
    some = some.withColumn("_turn", turn).where("_turn <= _stay")
    return whole.select("_row").unionByName(some.select("_row")).select("_row.*")
