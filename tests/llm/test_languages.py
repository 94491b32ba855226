"""Languages, conversations and spelling variants against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import conversations, languages, spelling

LETTERS = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- languages
def test_presence_is_the_set_of_grams():
    texts = ["", "Ab", "ab c", "é", "aaaa" * 5000, "x1y2"]
    raw = [t.encode() for t in texts]
    present, at = languages.presence(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    sets = [set(present[at[i]:at[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [0, 3, 10, 3, 4, 9]
    assert sets[1] < sets[2] and not sets[3] & sets[4]


def grams(text):
    read = re.sub("[^a-z\u0080-\U0010ffff]", " ", text.translate(LOWER)).encode()
    return {(n, read[i:i + n]) for n in languages.SIZES for i in range(len(read) - n + 1)}


def kernel(one, two):
    return len(one & two) / math.sqrt(max(len(one), 1) * max(len(two), 1))


def speech(language, seed, n):
    rng = random.Random(seed)
    words = {"aa": ["kala", "mokali", "lakamo", "ka"], "bb": ["strent", "ment", "trost", "ent"], "cc": ["üben", "zü", "öbe", "nübö"]}[language]
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages_match_a_kernel_ridge_of_all_landmarks(make_docs):
    rows = [(i, speech(("aa", "bb", "cc")[i % 3], i, 3 + i % 40), ("aa", "bb", "cc")[i % 3], "s") for i in range(300)]
    rows += [(i, "kala " * 2000, "aa", "s") for i in range(1000, 1100)]
    found = {r.doc_id: r for r in languages.identify_languages(make_docs(rows), landmarks=30, sample=40, ridge=1e-3).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(found[r[0]].held_out for r in held) and sum(r.held_out for r in found.values()) == len(held)
    assert all(found[r[0]].lang_pred == r[2] for r in held)
    # The same from kernels written out, features without hashing.
    sample = {(r.lang, r.mark): grams(r.text) for r in languages.training_sample(make_docs(rows), 40).collect()}
    order = sorted(sample)
    assert all(sum(k[0] == lang for k in order) == 40 for lang in ("aa", "bb", "cc"))
    spanning = [k for lang in ("aa", "bb", "cc") for k in [o for o in order if o[0] == lang][:10]]
    own = np.array([[kernel(sample[a], sample[b]) for b in spanning] for a in spanning])
    values, vectors = np.linalg.eigh(own)
    used = values > values.max() * 1e-10
    root = vectors[:, used] / np.sqrt(values[used])
    phi = np.array([[kernel(sample[a], sample[b]) for b in spanning] for a in order]) @ root
    target = np.array([[1.0 if a[0] == lang else -1.0 for lang in ("aa", "bb", "cc")] for a in order])
    solved = np.linalg.solve(phi.T @ phi + 1e-3 * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    for doc_id, text, *_ in rows[:60]:
        one = grams(text)
        value = (np.array([kernel(one, sample[b]) for b in spanning]) @ root @ solved).max()
        assert found[doc_id].score == pytest.approx(min(max((value + 1) / 2, 0), 1), abs=5e-3)


def test_languages_of_odd_and_no_rows(odd_docs, make_docs):
    assert languages.identify_languages(make_docs([])).collect() == []
    found = languages.identify_languages(odd_docs.unionByName(make_docs([(8, "12 .. 3", "en", "a"), (9, "ß", None, "a")]))).collect()
    assert len(found) == odd_docs.count() + 2
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found if r.doc_id in (1, 2, 5, 8))
    assert all(r.lang_pred in ("en", "de") for r in found if r.doc_id in (3, 4, 6, 9, None))
    nothing = languages.identify_languages(make_docs([(1, "alpha", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


# ---------------------------------------------------------------- conversations
CONVERSATIONS = "conv_id long, turn long, role string, text string, copy string, dropped string, body string, first string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """The least of (cost, edits) over all edit strings; rows are (role, fault)."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            # An R or I is whatever the pattern needs there.
            said, cost, audit = "", 0, ""
            for i, count in enumerate(inserts):
                for edit in "I" * count + (edits[i] if i < len(rows) else ""):
                    audit += edit
                    if edit in "RI":
                        said += "u" if not said or said[-1] in "sa" else "a"
                    elif edit == "K":
                        said += rows[i][0][:1]
                    cost += {"K": 0, "R": 3, "D": 4, "I": 3}[edit] + (3 if edit in "KR" and rows[i][1] == "truncated" else 0)
            if PATTERN.match(said) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def repaired(rows):
    out = []
    repair = conversations.Repair(lambda edit, role, row: out.append((edit, role, row)))
    for role, fault in rows:
        repair.add(fault, (role,))
    cost = repair.end()
    assert PATTERN.match("".join(role[:1] for _, role, _ in out if role))
    return (cost, "".join(edit for edit, _, _ in out)), repair


def test_repair_is_the_cheapest_of_all_edits():
    faults = ("none", "none", "truncated", "duplicate", "blank")
    for seed in range(150):
        rng = random.Random(seed)
        rows = [(rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(faults)) for _ in range(rng.randrange(5))]
        assert repaired(rows)[0] == cheapest(rows)


def test_repair_holds_only_the_unresolved_stretch():
    rng = random.Random(3)
    rows = [(rng.choice(["user", "assistant", "system"]), "none") for _ in range(20_000)]
    found, repair = repaired(rows)
    assert repair.most_waiting < 60
    # A tie that never ends is held whole and still decided right.
    assert repaired([("user", "none")] * 1000)[0] == (1500, "KR" * 500)


def test_conversations_of_odd_rows(spark):
    rows = [
        (1, None, "user", "Hi."), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (1, 7, "user", "Hi."),
        (2, 1, None, "x"), (2, 2, "", ""), (None, None, None, None), (3, 5, "system", "Be. \t\n"),
        (4, 0, "user", "long " * 400_000 + "end."), (4, 1, "assistant", "ok?\x0b\x0c"),
    ]
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CONVERSATIONS)
    found = {r.conv_id: r for r in conversations.repair_digests(conversations.undamaged(table)).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    one = found[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 0, 2, 0, 1, 8, "KKDD")
    assert one.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (found[2].gaps, found[2].blank, found[2].truncated, found[2].illegal) == (0, 1, 1, 1)
    assert (found[None].gaps, found[None].blank, found[None].audit) == (0, 1, "D")
    assert (found[3].cost, found[3].audit, found[3].repaired_sha256) == (4, "D", hashlib.sha256(b"").hexdigest())
    assert (found[4].cost, found[4].audit) == (0, "KK")
    edits = sorted(conversations.repair_rows(conversations.undamaged(table)).where("conv_id = 1").collect(), key=lambda r: r.place)
    assert [(r.edit, r.role, r.text) for r in edits] == [("K", "user", "Hi."), ("K", "assistant", "Yes."), ("D", None, None), ("D", None, None)]
    assert conversations.repair_digests(conversations.damaged(table.limit(0))).collect() == []


def test_damage_keeps_every_conversation(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"a! b? {t}.") for i in range(60) for t in range(3)] + [(i, 0, "user", "x") for i in range(60, 200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in conversations.repair_digests(conversations.damaged(table)).collect()}
    assert set(found) == set(range(200))
    kind = lambda r: zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20
    gone = [r[0] for r in rows if r[0] >= 60 and kind(r) == 0]
    assert gone and all((found[i].cost, found[i].audit, found[i].gaps, found[i].repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest()) for i in gone)
    kept = conversations.damaged(table).collect()
    assert all(r.text == "" for r in kept if kind(r) == 1) and all(r.role == "user" for r in kept if kind(r) == 4)
    assert all(not set(r.text) & set(".!?") for r in kept if kind(r) == 2)
    assert len(kept) == len(rows) + sum(kind(r) == 3 for r in rows)


# ---------------------------------------------------------------- spelling variants
def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def spelled(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_variants_match_brute_force_at_every_group_size(make_docs):
    rng = random.Random(5)
    base = ["".join(rng.choice("aabé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "÷×àÿÀ"]
    weights = [1 / (1 + i % 20) for i in range(len(base))]
    rows = [(i if i % 9 else None, " ".join(w + rng.choice(["", "1", ". ", "\u0100"]) for w in rng.choices(base, weights, k=30)) if i % 7 else None)
            for i in range(160)]
    rows += [(900, "Aaaaa aaaaA x" * 4)] * 2
    docs = make_docs([(i, t, None, None) for i, t in rows])
    want = variants(counted(rows))
    assert sum(f is not None for _, f, *_ in want) > 3
    for group in (4096, 5, 1):
        assert spelled(spelling.spelling_variants(docs, group=group).collect()) == want


def test_spelling_variants_of_odd_and_no_rows(odd_docs, make_docs):
    assert spelled(spelling.spelling_variants(make_docs([])).collect()) == set()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert spelled(spelling.spelling_variants(odd_docs).collect()) == variants(counted(rows))


def test_acceptor_is_minimal_and_composition_complete():
    words = sorted({"".join(random.Random(i).choices("ab", k=5 + i % 2)) for i in range(200)})
    acceptor = spelling.Acceptor(words)
    ends = {(f, tuple(sorted(m.items()))) for f, m in zip(acceptor.final, acceptor.moves, strict=True)}
    assert len(ends) == len(acceptor.final)  # no two states have one future
    pairs = spelling.Composition(acceptor).pairs()
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
