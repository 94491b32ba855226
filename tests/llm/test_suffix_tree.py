"""Scores of the suffix tree against one that is written out in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log2, log10

import pytest

from tracewell.llm import suffix_tree

END = object()


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [END]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def written_out(rows, share, depth=suffix_tree.DEPTH):
    """``doc_id -> (n_tokens, n_known, train_tokens, base_score, score)`` and the retained contexts."""
    training = [tokens_of(text) for doc_id, text in rows if not is_held_out(doc_id)]
    counts = Counter(t for tokens in training for t in tokens)
    total, types = sum(counts.values()), len(counts)
    frequent = {t for t, n in counts.items() if n > 1 and n >= share * total}
    least = max(2.0, share * total)

    def root(token):
        return (counts[token] + 1) / (total + types + 1)

    states = {}

    def chance(context, token):
        if not context:
            return root(token)
        lower = chance(context[1:], token)
        if context not in states:
            return lower
        own, rest = states[context]
        return own.get(token, 0.0) + rest * lower

    followed = None
    for d in range(1, depth + 1):
        after = defaultdict(Counter)
        for tokens in training:
            for i in range(d, len(tokens)):
                context = tuple(tokens[i - d:i])
                if all(t in frequent for t in context) and (followed is None or context in followed):
                    after[context][tokens[i]] += 1
        entries = {c: {t: n for t, n in seen.items() if n >= least and t in frequent} for c, seen in after.items()}
        grown = {}
        for context, seen in after.items():
            size, kept = sum(seen.values()), entries[context]
            if size < least:
                continue
            lower = {t: chance(context[1:], t) for t in kept}
            divergence = sum(n / size * log2(n / size / lower[t]) for t, n in kept.items())
            rest, lower_rest = 1 - sum(kept.values()) / size, 1 - sum(lower.values())
            if rest > 1e-12:
                divergence += rest * log2(rest / max(lower_rest, 1e-12))
            if divergence >= suffix_tree.GAIN:
                own = {t: (n - suffix_tree.DISCOUNT) / size for t, n in kept.items()}
                grown[context] = own, 1 - sum(own.values())
        states.update(grown)
        followed = {context + (t,) for context, kept in entries.items() for t in kept}
    scores = {}
    for doc_id, text in rows:
        tokens = tokens_of(text)
        score = sum(log10(chance(tuple(tokens[max(0, i - depth):i]), t)) for i, t in enumerate(tokens))
        scores[doc_id] = len(tokens), sum(counts[t] > 0 for t in tokens), total, sum(log10(root(t)) for t in tokens), score
    return scores, states


@pytest.mark.parametrize("share", [1e-5, 2e-3])
def test_scores_equal_a_tree_written_out(spark, share):
    draw = random.Random(5)
    words = [f"W{i}" if i % 3 else f"w{i}é" for i in range(60)]
    rows = [(None, "w1 w2"), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "never seen words")]
    for doc_id in range(300):
        at, text = draw.randrange(60), []
        for _ in range(draw.randrange(1, 60)):
            # Often the next word but three, so that some contexts tell much of what follows.
            at = (at * 7 + draw.choice([1, 1, 1, 2, 5])) % 60 if draw.random() < 0.8 else draw.randrange(60)
            text.append(words[at] if draw.random() < 0.97 else f"rare{draw.randrange(400)}")
        rows.append((doc_id, draw.choice([" ", "\n", " \t "]).join(text)))
    expected, states = written_out(rows, share)
    assert {len(c) for c in states} == {1, 2}
    got = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), share=share).collect()
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, total, base, score = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held_out(r.doc_id), n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)


@pytest.mark.parametrize("sent", [suffix_tree.SENT, 5e-3])
def test_rare_contexts_of_a_large_corpus_are_learned(spark, monkeypatch, sent):
    monkeypatch.setattr(suffix_tree, "SENT", sent)
    draw = random.Random(8)
    # More than two occurrences in 1e-5 of all tokens: a text that occurs twice must still be known.
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.6)) % 5000}" for _ in range(1200))) for i in range(250)]
    planted = " ".join(f"rare{i}" for i in range(60))
    twice = [i for i in range(1000, 1020) if not is_held_out(i)][:2]
    rows += [(i, planted) for i in twice]
    expected, _ = written_out(rows, 0.0)
    got = {r.doc_id: r for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == expected.keys() and got[0].train_tokens * 1e-5 > 2
    for doc_id, (n_tokens, n_known, total, base, score) in expected.items():
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, abs=1e-7) and r.score == pytest.approx(score, abs=1e-7)
    assert got[twice[0]].score > 0.5 * got[twice[0]].base_score
