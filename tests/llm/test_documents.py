"""Document operators against brute force on small tables, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import arrays, fuzzy_lines, licenses, mixing, neardup, perplexity, secrets, suffix_tree, token_files, winnow

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "é", "ß") for b in ("n", "ra", "st", "tion", "ß")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near_copy(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_words_match_the_pattern():
    texts = ["", "a  b\tc\n", "  Über straße  ", "x" * 300_000 + " y", "\x85 \xa0"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.r_[0, np.cumsum([len(r) for r in raw])]
    words = arrays.words_of(data, bounds, arrays.BETWEEN_SPACES, lower=True)
    for i, text in enumerate(texts):
        found = [bytes(data[words.starts[j]:words.ends[j]]).decode() for j in range(words.bounds[i], words.bounds[i + 1])]
        assert found == SPACED.findall(text)
    again = arrays.words_of(np.frombuffer(b"b", np.uint8), np.array([0, 1]), arrays.BETWEEN_SPACES, lower=True)
    assert again.hashes[0] == words.hashes[1]


def test_mix_meets_targets_and_never_passes_twice_the_size(make_docs):
    docs = make_docs([(i, prose(i, 20 + i % 50), "en", f"s{i % 4 if i % 3 else 0}") for i in range(800)])
    rows = mixing.mix_sources(docs).collect()
    assert all(r.copies <= 2 for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own)
    assert sum(r.size * r.copies for r in rows) == mixing.repeat_documents(docs).select(
        mixing.count_matches(mixing.F.col("text"), mixing.WORDS).alias("n")).groupBy().sum("n").first()[0]


def test_smaller_budgets_are_part_of_larger_ones(make_docs):
    docs = make_docs([(i, prose(i, 30), "en", "a") for i in range(300)])
    small, large = ({r.doc_id for r in mixing.mix_sources(docs, share=s).collect() if r.copies} for s in (0.2, 0.6))
    assert small and small < large


def brute_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and label[a] != label[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        low, high = sorted((label[a], label[b]))
                        label = {i: low if x == high else x for i, x in label.items()}
                        changed = True
    return label


@pytest.mark.parametrize("tile", [512, 8])
def test_near_duplicates_match_all_pairs(make_docs, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    base = prose(1, 120)
    texts = {i: near_copy(base, i, i % 6) for i in range(1, 40)} | {i: prose(i, 60) for i in range(40, 60)}
    texts |= {60: texts[45], 61: near_copy(texts[46], 1, 1), 62: None, 63: "", 64: "one two", 65: "One  two"}
    want = brute_components(texts, 80)
    rows = neardup.near_duplicates(make_docs([(i, t) for i, t in texts.items()]), 80).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_one_document_of_each_group_stays(odd_docs):
    left = neardup.one_of_each(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in left) == [
        (False, 1, ""), (False, 2, ""), (False, 3, "alpha"), (False, 4, "w0 w1"), (False, 5, "   \n\t"), (False, 6, "one"), (False, 6, "two")]


def brute_contamination(text, items):
    words, hit, found = PLAIN.findall((text or "").translate(LOWER)), set(), set()
    for name, item in items:
        w = PLAIN.findall((item or "").translate(LOWER))
        k = min(13, len(w))
        for j in range(len(w) - k + 1) if k else ():
            for i in range(len(words) - k + 1):
                if words[i:i + k] == w[j:j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_contamination_matches_brute_force(spark, make_docs):
    items = [(i, prose(100 + i, n)) for i, n in enumerate((40, 25, 13, 12, 7, 1, 30))] + [(9, None), (10, ""), (10, prose(100, 40))]
    rows = [(i, prose(i, 90)) for i in range(12)]
    rows += [(20 + i, f"{prose(i, 30)} {t.upper()} {prose(50 + i, 30)}, {' '.join(t.split()[:12])}") for i, (_, t) in enumerate(items) if t]
    rows += [(50, None), (51, ""), (20, rows[13][1])]
    got = winnow.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = Counter((i, *brute_contamination(t, items)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_statistics_and_bands(make_docs):
    rows = [(i, prose(i, 80 + i % 40) + "\n" + prose(i, 5), "en") for i in range(300)]
    rows += [(900, "zz zz zz " * 40, "en"), (901, " ".join(f"q{i}$$$" for i in range(90)), "en"), (902, None, None), (903, "a\na\n b", "de")]
    found = {r.doc_id: r for r in perplexity.quality(make_docs(rows), word_share=1e-3).collect()}
    for i, text, _ in rows:
        w, r = SPACED.findall(text or ""), found[i]
        lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
        runs = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if runs[tuple(w[j:j + 3])] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert all(found[i].kept for i in range(300))
    assert not any(found[i].kept for i in (900, 901, 902, 903))


def test_copies_do_not_set_the_band(make_docs):
    rows = [(i, prose(i, 80 + i % 40), "en") for i in range(100)] + [(1000 + i, prose(999, 90), "en") for i in range(200)]
    found = perplexity.quality(make_docs(rows), word_share=1e-3).collect()
    assert sum(r.kept for r in found if r.doc_id < 1000) >= 95


def test_model_sums_to_one(make_docs):
    model = perplexity.train(make_docs([(i, prose(i, 50)) for i in range(50)]).select("text"), 1e-3, 1e-4)
    words = np.arange(1, len(model.single))
    for history in (0, perplexity.FIRST_WORD, perplexity.FIRST_WORD + 5):
        pairs = np.exp(model.log_pairs(np.full(len(words) + 1, history), np.arange(len(words) + 1))).sum()
        assert abs(pairs - 1) < 1e-3


def test_model_keeps_all_pairs(make_docs):
    texts = [prose(i, 50) for i in range(50)]
    model = perplexity.train(make_docs(list(enumerate(texts))).select("text"), 1e-3, 1e-2)
    known = {h: i + perplexity.FIRST_WORD for i, h in enumerate(model.vocabulary.hashes.tolist())}
    ids = lambda t: [known.get(int(h), perplexity.OTHER) for h in arrays.words_of(
        np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), arrays.BETWEEN_SPACES, lower=True).hashes]
    pairs = {p for t in texts for p in zip([perplexity.START, *ids(t)], [*ids(t), perplexity.STOP])}
    assert len(model.pairs.grams) == len(pairs)
    assert len(model.pairs.contexts) == len({a for a, _ in pairs})


def test_suffix_tree_scores(make_docs):
    chain = lambda s: " ".join(random.Random(s).choice(("red fish swims", "blue bird sings", "old dog sleeps")) for _ in range(30))
    rows = [(i, chain(i)) for i in range(120)] + [(500, None), (501, "Never seen"), (None, "red fish")]
    got = suffix_tree.score_documents(make_docs(rows), share=1e-4).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), "\0"] for i, t in rows}
    counts = Counter(t for i, ts in tokens.items() if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        ts = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ts), sum(t in counts for t in ts), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    assert sum(r.score for r in got if r.held_out) > 0.7 * sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_round_trip(spark, odd_docs, tmp_path, monkeypatch, vocabulary):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CHUNK", 1000)
    monkeypatch.setattr(token_files, "FILE_BYTES", 100_000)
    path = P.path(vocabulary)
    tokenizer = Tokenizer.from_file(path)
    extra = odd_docs.unionByName(odd_docs.limit(0)).union(spark.createDataFrame(
        [(7, "Don't <|endoftext|> it's ÉTÉ é 100% ’’, 你好!!", "en", "a", 0, "", "")], odd_docs.schema))
    token_files.write_token_files(extra, str(tmp_path / "t"), path)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(ids(r.text)), zlib.crc32(np.array(ids(r.text), "<u4").tobytes()))
                  for r in extra.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(x[0] for x in want)


def test_planes_round_trip():
    for values in ([], [0], [1, 65535, 70000, 0], list(range(5000))):
        ids = np.array(values, np.uint32)
        assert (token_files.unpack_planes(token_files.pack_planes(ids), len(ids)) == ids).all()


def test_license_labels_and_containment(make_docs):
    text = "Licensed under the Apache License, Version 2.0. x (CC BY-NC) under the MIT license; CC BY-NC-SA 4.0 license all rights reserved"
    rows = {r.doc_id: r for r in licenses.scan_licenses(make_docs([(1, text), (2, None), (3, "mit"), (1, text)])).collect()}
    r = rows[1]
    words = PLAIN.findall(text.translate(LOWER))
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), 4, 3, 16)
    assert r.base_labels == "apache-2,cc-by-nc,mit" and r.labels == "apache-2,cc-by-nc,cc-by-nc-sa,mit,proprietary" and r.score == 1.0
    assert (rows[2].n_words, rows[2].labels, rows[2].score, rows[3].labels) == (0, "", 0.0, "")
    assert len(licenses.signatures()) > 300


def test_license_keywords_are_in_every_match(make_docs):
    def sample(parts, rng):
        out = ""
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                out += chr(rng.choice(value)[1])
            elif kind == "MAX_REPEAT":
                out += sample(value[2], rng) if rng.random() < 0.5 else ""
            elif kind == "BRANCH":
                out += sample(rng.choice(value[1]), rng)
            else:
                out += sample(value[3], rng)
        return out
    rng = random.Random(5)
    for rule in licenses.signatures():
        for _ in range(20):
            text = sample(re._parser.parse(rule.pattern), rng)
            assert re.fullmatch(rule.pattern, text) and set(rule.keywords) <= set(text.split()), (rule, text)
    want = {"MPL-2.0": "mpl-2", "MPL-1.1": "mpl-1", "EPL-2.0": "epl", "BSL-1.0": "boost"}
    texts = [(f"SPDX-License-Identifier: {k}", v) for k, v in want.items()] + [
        (f"Licensed under the {k}", v) for k, v in (("GPLv3", "gpl-3"), ("GPL2", "gpl-2"), ("LGPLv3", "lgpl"), ("AGPLv3", "agpl-3"), ("EUPL v1.2", "eupl"))]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(make_docs([(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    assert got == {i: v for i, (_, v) in enumerate(texts)}


def test_fuzzy_lines_keep_one_of_each_group(make_docs):
    lines = [prose(i, 40) for i in range(30)]
    changed = [near_copy(x, i, 1) for i, x in enumerate(lines)]
    rows = [(i, f"{x}\n\n{lines[0]}") for i, x in enumerate(lines)] + [(100 + i, x.replace(" ", ", ") + ".") for i, x in enumerate(lines)]
    rows += [(200 + i, x) for i, x in enumerate(changed)] + [(300, None), (301, "")]
    got = {(r.doc_id, r.line_no): r for r in fuzzy_lines.fuzzy_lines(make_docs(rows)).collect()}
    assert all(got[i, 0].kept and not got[100 + i, 0].kept and got[i, 0].group_id == got[100 + i, 0].group_id for i in range(30))
    assert not any(got[i, 2].kept for i in range(30)) and all(got[i, 1].kept and got[i, 1].group_id is None for i in range(30))
    assert got[300, 0].kept and got[301, 0].kept
    groups = Counter(r.group_id for r in got.values() if r.kept and r.group_id is not None)
    assert max(groups.values()) == 1


def test_fuzzy_lines_count_edits_in_characters(make_docs):
    rows = [(1, "an alpha to bravo by charlie"), (2, "in alpha tu bravo by charlie"), (3, "zzz yyy xxx www vvv alpha bravo charlie")]
    got = {r.doc_id: r for r in fuzzy_lines.fuzzy_lines(make_docs(rows)).collect()}
    assert got[1].group_id == got[2].group_id != got[3].group_id and got[1].kept and not got[2].kept and got[3].kept


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_fuzzy_lines_find_nine_in_ten_similar_pairs_of_each_length(make_docs):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    rows, similar = [], {}
    for length in (5, 10, 20, 40):
        for _ in range(120):
            line = [rng.choice(words) for _ in range(length)]
            other = list(line)
            for place in rng.sample(range(length), length // 5):
                other[place] = rng.choice(words)
            x, y, at = " ".join(line), " ".join(other), len(rows)
            rows += [(at, x), (at + 1, y)]
            if 5 * edit_distance(x, y) <= max(len(x), len(y)):
                similar.setdefault(length, []).append(at)
    groups = {r.doc_id: r.group_id for r in fuzzy_lines.fuzzy_lines(make_docs(rows)).collect()}
    for length, pairs in similar.items():
        assert len(pairs) > 50 and sum(groups[at] == groups[at + 1] for at in pairs) >= 0.9 * len(pairs), length
    # No line meets an unrelated one: a group is a pair or a single line.
    assert max(Counter(groups.values()).values()) == 2


def test_fuzzy_lines_of_large_buckets_equal_brute_force(spark, make_docs):
    # A passage that lines of all lengths share, with near copies, and one very long pair of lines.
    passage = prose(1, 30)
    lines = [f"{prose(100 + i, i % 9 * 10)} {passage} {prose(300 + i, 5 + i % 7)}".strip() for i in range(60)]
    lines += [near_copy(x, i, 2) for i, x in enumerate(lines)]
    long_line = prose(5, 20_000)
    rows = list(enumerate(lines + [long_line, near_copy(long_line, 1, 3)]))
    got = {r.doc_id: r for r in fuzzy_lines.fuzzy_lines(make_docs(rows)).collect()}
    table = spark.createDataFrame(rows[:len(lines)], "i long, x string").repartition(8)
    pairs = table.join(table.toDF("j", "y"), F.col("i") < F.col("j")).where(
        "5 * levenshtein(x, y) <= greatest(length(x), length(y))").select("i", "j").collect()
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        low, high = sorted((find(i), find(j)))
        root[high] = low
    roots = [find(i) for i in range(len(lines))]
    assert len(set(roots)) < len(lines) / 2
    assert [got[i].kept for i in range(len(lines))] == [r == i for i, r in enumerate(roots)]
    assert all(got[i].group_id == got[r].group_id for i, r in enumerate(roots))
    assert got[len(lines)].group_id == got[len(lines) + 1].group_id


def test_fuzzy_lines_link_lines_without_a_common_key(make_docs):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(6, 9))) for _ in range(200)]
    lines = ["chimney", "chimneys", "green apple", "green apples", "abc", "abd", "größen", "grössen", "größem"]
    for length in (1, 2, 3, 6, 15, 60):
        for _ in range(6):
            line = [rng.choice(words) for _ in range(length)]
            # One letter of every word is another one: no word stays, but more than 80 percent of the characters do.
            lines += [" ".join(line), " ".join(w[:k] + "x" + w[k + 1:] for w in line for k in [rng.randrange(len(w))])]
    rows = list(enumerate(lines))
    got = {r.doc_id: r for r in fuzzy_lines.fuzzy_lines(make_docs(rows)).collect()}
    root = list(range(len(lines)))
    for i, x in rows:
        for j in range(i):
            if 5 * edit_distance(x, lines[j]) <= max(len(x), len(lines[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert all(root[i + 1] == root[i] for i in range(9, len(lines), 2))
    assert [got[i].kept for i in range(len(lines))] == [r == i for i, r in enumerate(root)]
    assert all(got[i].group_id == got[r].group_id for i, r in enumerate(root))


def test_secrets_and_false_positives(make_docs):
    rng = random.Random(3)
    code = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    rows = [(i, f"{prose(i, 5)} AKIA{code(16, upper)} {prose(i, 5)}", "en", "app/main") for i in range(60)]
    rows += [(100 + i, f"password={code(18, hexes)}", "en", "app") for i in range(60)]
    rows += [(200 + i, f"{prose(i, 5)} {code(16, '0123456789')} {prose(i, 5)}", "en", "app") for i in range(60)]
    rows += [(300 + i, f"commit {code(40, hexes)} {prose(i, 5)}", "en", "app") for i in range(60)] + [(400, None), (401, "")]
    held = [r for r in rows if r[0] % 5 == 0]
    labelled = secrets.label_findings(secrets.describe(secrets.candidates(make_docs([r for r in rows if r[0] % 5])), make_docs(rows)))
    got = secrets.scan_secrets(make_docs(held + held[:1]), labelled).collect()
    right = [r.is_secret == (r.doc_id < 200) for r in got]
    assert len(got) == 4 * 12 + 1 and sum(right) >= 0.95 * len(right)
    assert all(dict((r[0], r[1]) for r in rows)[r.doc_id][r.start:r.start + len(r.candidate)] == r.candidate for r in got)


def test_secret_candidates_of_all_alphabets(make_docs):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    code = lambda n, more="": "".join(rng.choice(letters + more) for _ in range(n))
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{code(64, '0123456789+/')}\n{code(20, '0123456789+/')}==\n-----END RSA PRIVATE KEY-----"
    values = [code(10, "0123456789+/") + "/" + code(28, "0123456789+/") + "7" for _ in range(50)]
    values += ["glpat-" + code(19) + "3", "sk-proj-" + code(30), "github_pat_" + code(50), "npm_" + code(36), "hf_" + code(34), block]
    rows = [(i, f"see {v} there") for i, v in enumerate(values)]
    assigned = ["hunter2", "correcthorse", "p@ss!w0rd", "x", "a-b"]
    rows += [(100 + i, f"password={v}\nnext") for i, v in enumerate(assigned)] + [(200 + i, f'"secret": "{v}", next') for i, v in enumerate(assigned + ["two words"])]
    found = {r.doc_id: r.candidate for r in secrets.scan_secrets(make_docs(rows)).collect()}
    want = dict(enumerate(values)) | {100 + i: v for i, v in enumerate(assigned)} | {200 + i: v for i, v in enumerate(assigned + ["two words"])}
    assert found == want


OPERATORS = {
    "mix": lambda d: mixing.mix_sources(d), "near": lambda d: neardup.near_duplicates(d), "quality": lambda d: perplexity.quality(d),
    "lines": lambda d: fuzzy_lines.fuzzy_lines(d), "tree": lambda d: suffix_tree.score_documents(d), "licenses": lambda d: licenses.scan_licenses(d),
    "secrets": lambda d: secrets.scan_secrets(d), "winnow": lambda d: winnow.contamination(d, d.selectExpr("doc_id as item_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd_docs, name):
    rows = OPERATORS[name](odd_docs).count()
    assert rows == {"lines": 11, "secrets": 0}.get(name, 9)
    assert OPERATORS[name](odd_docs.limit(0)).count() == 0


def test_encoder_forgets_rare_runs_without_changing_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE", 8)
    monkeypatch.setattr(token_files, "YOUNG", 4)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(path, token_files.direct_words(path))
    whole = Tokenizer.from_file(path)
    texts = [f"The river {n} ÉTÉ river, don't x{n} {'abc' * n}. the\tThe" for n in range(40)] + [""]
    for text in texts:
        raw = [t.encode() for t in (text, "", "the river")]
        ids, sizes = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        wanted = [whole.encode(t, add_special_tokens=False).ids for t in (text, "", "the river")]
        assert sizes.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]
        assert len(encoder.old.keys) < 20 and len(encoder.young.keys) < 20 and len(encoder.ids) < 400


def test_encoder_agrees_with_the_library_on_letters_marks_and_the_rest():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole, rng = token_files.Encoder(path, token_files.direct_words(path)), Tokenizer.from_file(path), random.Random(9)
    parts = ["a", "Z", "é", "É", "×", "÷", "ß", "'", "s", "<|endoftext|>", "|", ".", "!", "~", "9", "\u00a0", "\u0301", "\u0130", "漢", " ", "\n", "\x85", "\x1f"]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        ids, sizes = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        wanted = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]
