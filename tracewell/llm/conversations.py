"""Repair of conversation structure with survivor-coalescence Viterbi.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: an optional system
turn, then user and assistant in turns. The cheapest edits that get there are the path of
least cost through the four states of that pattern. For each state one survivor is kept; the
survivors are leaves of a tree of backpointers with reference counts, and as soon as all of
them have one ancestor, the edits up to it are put out and their rows forgotten. A survivor
that another one beats whatever follows is dropped early, so ties and detours end soon.

Among paths of equal cost the one whose edits read least in ASCII wins. Two different
survivors at one row have both used up all rows, so neither's edits begin with the other's
and the first edit in which their unresolved suffixes differ decides between them for good:
each survivor carries its rank among the others, which is exactly that comparison of the
complete suffixes, handed on from row to row.

Rows of a conversation are streamed in order and one at a time; what is held is the
unresolved stretch. The SHA-256 of the repaired conversation is one chain over all its
text, so one task reads a conversation from start to end, however long it is. Which texts
occurred before is settled by an aggregation and a join beforehand, not by a set in that task.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

# States: nothing yet, after s, after u, after a. What comes next in each, and where it leads.
NEEDED = "uuau"
AFTER = (2, 2, 3, 2)
# Inserts that bring an open conversation to an end.
ENDING = ("", "II", "I", "")
# What the future of a state costs at most more than that of another: BEYOND[p][q] >= future(p) - future(q).
# An inserted turn makes up for one that is missing, a deletion for an s that only the first state may keep.
BEYOND = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))


def _steps(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """From, to, cost and edits of one row with the inserts before it."""
    out = []
    for start in range(4):
        state, inserts = start, 0
        while True:
            before = "I" * inserts
            cost = INSERT * inserts
            out.append((start, state, cost + DELETE, before + "D"))
            if fault not in ("blank", "duplicate"):
                cut = CUT if fault == "truncated" else 0
                out.append((start, AFTER[state], cost + REROLE + cut, before + "R"))
                if initial == NEEDED[state]:
                    out.append((start, AFTER[state], cost + KEEP + cut, before + "K"))
                elif initial == "s" and state == 0:
                    out.append((start, 1, cost + KEEP + cut, before + "K"))
            state, inserts = AFTER[state], inserts + 1
            # A third insert, or one that leads back to the start, only adds cost.
            if inserts == 3 or state == start:
                break
    return out


FAULTS = ("none", "blank", "duplicate", "truncated")
STEPS = {(i, f): _steps(i, f) for i in ("u", "a", "s", "") for f in FAULTS}


class _Node:
    """The edits of one row on some survivor's path; ``refs`` counts later nodes and survivors that need it."""

    __slots__ = ("parent", "edits", "refs", "kids")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)

    def release(self) -> None:
        node = self
        node.refs -= 1
        while not node.refs and node.parent is not None:
            node.parent.kids.remove(node)
            node.parent.refs -= 1
            node = node.parent


class Repair:
    """Edits of one conversation, put out row by row as they become certain."""

    def __init__(self, out):
        self.out = out
        self.root = _Node(None, "")
        self.root.refs = 1
        # State: cost, rank, leaf.
        self.survivors: dict[int, tuple[int, int, _Node]] = {0: (0, 0, self.root)}
        self.waiting: deque = deque()
        self.state = 0
        self.most_waiting = 0

    def add(self, fault: str, row: tuple) -> None:
        """The next row; ``row`` begins with its role."""
        best: dict[int, tuple] = {}
        initial = row[0][:1]
        for start, to, cost, edits in STEPS[initial if initial in "uas" else "", fault]:
            if start in self.survivors:
                spent, rank, _ = self.survivors[start]
                found = (spent + cost, rank, edits, start)
                if to not in best or found < best[to]:
                    best[to] = found
        kept = {s: b for s, b in best.items() if all(b[0] <= o[0] + BEYOND[p][s] for p, o in best.items())}
        order = sorted(kept, key=lambda s: kept[s][1:3])
        new = {}
        for rank, state in enumerate(order):
            cost, _, edits, start = kept[state]
            leaf = _Node(self.survivors[start][2], edits)
            leaf.refs = 1
            new[state] = (cost, rank, leaf)
        for _, _, leaf in self.survivors.values():
            leaf.release()
        self.survivors = new
        self.waiting.append(row)
        self.most_waiting = max(self.most_waiting, len(self.waiting))
        self._emit()

    def _emit(self) -> None:
        # The root is a survivor's own node only before the first row; else its one later node is certain.
        while len(self.root.kids) == 1 and self.root.refs == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self._put(self.root.edits, self.waiting.popleft())

    def _put(self, edits: str, row: tuple | None) -> None:
        for edit in edits:
            if edit == "D":
                self.out(edit, None, row)
                continue
            role = ROLES[NEEDED[self.state]]
            if edit == "K":
                role = row[0]
                self.state = 1 if self.state == 0 and role[:1] == "s" else AFTER[self.state]
            else:
                self.state = AFTER[self.state]
            self.out(edit, role, None if edit == "I" else row)

    def end(self) -> int:
        """Put out all that is left; the cost of all edits."""
        cost, _, state = min((c + INSERT * len(ENDING[s]), r, s) for s, (c, r, _) in self.survivors.items())
        for other, (_, _, leaf) in self.survivors.items():
            if other != state:
                leaf.release()
        leaf, path = self.survivors[state][2], []
        while leaf is not self.root:
            path.append(leaf.edits)
            leaf = leaf.parent
        for edits in reversed(path):
            self._put(edits, self.waiting.popleft())
        self._put(ENDING[state], None)
        return cost


class _Digest:
    """What the digest says of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = dict.fromkeys(FAULTS, 0)
        self.turns, self.low, self.high, self.illegal = 0, None, None, 0
        self.last_turn, self.last = None, None
        self.audit, self.joined, self.any = [], hashlib.sha256(), False
        self.repair = Repair(self._out)

    def _out(self, edit: str, role: str | None, row: tuple | None) -> None:
        self.audit.append(edit)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        if role is not None:
            self.joined.update((("\n" if self.any else "") + role + ":" + (row[1] if row else "")).encode("utf-8", "surrogatepass"))
            self.any = True

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        self.faults[fault] += 1
        self.repair.add(fault, (role, text))

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, cost,
                "".join(self.audit), self.joined.hexdigest())


class _Rows:
    """The repaired rows of one conversation, deleted ones included."""

    def __init__(self, conv_id):
        self.conv_id, self.place, self.found = conv_id, 0, []
        self.repair = Repair(self._out)

    def _out(self, edit: str, role: str | None, row: tuple | None) -> None:
        role_was, text, turn = row if row else (None, "", None)
        self.found.append((self.conv_id, self.place, turn, edit, role_was, role, None if edit == "D" else text))
        self.place += 1

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.repair.add(fault, (role, text, turn))

    def take(self) -> list[tuple]:
        found, self.found = self.found, []
        return found


DIGESTS = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
DIGEST_TYPES = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role_was", pa.string()),
                   ("role", pa.string()), ("text", pa.string())])
EDIT_TYPES = "conv_id long, place long, turn long, edit string, role_was string, role string, text string"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _conversations(batches):
    """Faults and rows in order: conv_id, turn, role, text, fault; a conversation without rows has one with fault None."""
    last = None
    for batch in batches:
        for conv_id, turn, role, text, dropped, body, again, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if dropped:
                yield conv_id, None, None, None, None
                continue
            here = (conv_id, turn, role, marks)
            if not body:
                fault = "blank"
            elif again or here == last:
                fault = "duplicate"
            else:
                fault = "none" if body in STOPS else "truncated"
            last = here
            yield conv_id, turn, role, text, fault


def _digest(batches):
    one, rows = None, []
    for conv_id, turn, role, text, fault in _conversations(batches):
        if one is None or conv_id != one.conv_id:
            if one is not None:
                rows.append(one.row())
                if len(rows) == 2000:
                    yield _batch(DIGESTS, rows)
                    rows = []
            one = _Digest(conv_id)
        if fault is not None:
            one.add(turn, role, text, fault)
    if one is not None:
        rows.append(one.row())
    yield _batch(DIGESTS, rows)


def _edits(batches):
    one, rows = None, []
    for conv_id, turn, role, text, fault in _conversations(batches):
        if one is None or conv_id != one.conv_id:
            if one is not None:
                one.repair.end()
                rows += one.take()
            one = _Rows(conv_id)
        if fault is not None:
            one.add(turn, role, text, fault)
            rows += one.take()
        if len(rows) >= 2000:
            yield _batch(EDITS, rows)
            rows = []
    if one is not None:
        one.repair.end()
        rows += one.take()
    yield _batch(EDITS, rows)


# ---------------------------------------------------------------- rows
def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, dropped``: rows of known damage by the checksum of their place.

    Nulls are one space. Dropped rows stay, without role and text, so that no conversation is lost.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    text_or_space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_or_space(conv), F.lit(":"), text_or_space(turn)).cast("binary")) % 20
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), text_or_space(F.col("role")).alias("role"),
                                text_or_space(F.col("text")).alias("text"), kind.alias("kind"))
    is_kind = lambda k: F.col("kind") == k
    return rows.select(
        "conv_id", "turn", F.when(is_kind(0), "").when(is_kind(4), "user").otherwise(F.col("role")).alias("role"),
        F.when(is_kind(0) | is_kind(1), "").when(is_kind(2), F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(is_kind(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), is_kind(0).alias("dropped"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are; nulls are one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, with the last character that is not blank, whether role and text
    occurred in an earlier turn, and a mark of the text."""
    body = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    marks = F.concat(F.xxhash64("text").cast("string"), F.lit(" "), F.xxhash64(F.lit("b"), "text").cast("string"))
    rows = rows.withColumn("body", body).withColumn("marks", marks)
    # Null turns come first, so the first turn of a text is below all others.
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.where(~F.col("dropped")).groupBy("conv_id", "role", "marks").agg(F.min(place).alias("first"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.marks") == F.col("f.marks"))
    joined = rows.alias("r").join(first.alias("f"), same, "left")
    again = F.coalesce(~F.col("r.turn").eqNullSafe(F.col("f.first.turn")), F.lit(False))
    found = joined.select("r.conv_id", "r.turn", "r.role", "r.text", "r.dropped", "r.body", again.alias("again"), "r.marks", "r.copy")
    dealt = found.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return dealt.drop("copy")


def repair_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of
    ``rows``, a table as :func:`damaged` and :func:`undamaged` make it.

    Rows of a conversation go by turn, null first, then by role and text. Null ids are one
    conversation. A conversation whose rows are all dropped has zeros, an empty audit
    and the hash of an empty text; no rows give no rows. Other columns are not read.
    """
    return _ordered(rows).mapInArrow(_digest, DIGEST_TYPES)


def repair_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, place, turn, edit, role_was, role, text``: each edit of the cheapest repair in order.

    ``role`` and ``text`` are what the repaired conversation has, null for a deleted row; an
    inserted row has neither turn nor former role. Input as for :func:`repair_digests`.
    """
    return _ordered(rows).mapInArrow(_edits, EDIT_TYPES)
