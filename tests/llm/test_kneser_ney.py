"""The perplexity model against modified Kneser-Ney written out in plain Python."""

import random
from collections import Counter, defaultdict
from math import log

import pytest

from tracewell.llm import perplexity

START, OTHER, STOP = "<start>", "<other>", "<stop>"


def discounts(counts):
    of = Counter(counts)
    n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def written_out(texts, share):
    """A function from a text to its log perplexity, all n-grams kept."""
    counts = Counter(w for t in texts for w in t.lower().split())
    vocabulary = {w for w, n in counts.items() if n > 1 and n >= share * sum(counts.values())}
    places, others = len(vocabulary) + 3, max(1, len(counts) - len(vocabulary))

    def padded(text):
        return [START, START] + [w if w in vocabulary else OTHER for w in text.lower().split()] + [STOP]

    triples = Counter(g for t in texts for s in [padded(t)] for g in zip(s, s[1:], s[2:]))
    before = defaultdict(list)
    for (a, b, c), n in triples.items():
        before[b, c].append(n)
    pairs = {g: sum(ns) if g[0] == START else len(ns) for g, ns in before.items()}
    singles = Counter(c for _, c in pairs)

    d1 = discounts(singles.values())
    share_of = {w: (n - d1[min(n, 3) - 1]) / len(pairs) for w, n in singles.items()}
    spare = (1 - sum(share_of.values())) / places

    def level(grams, lower):
        d, by_context = discounts(grams.values()), defaultdict(dict)
        for g, n in grams.items():
            by_context[g[:-1]][g[-1]] = n

        def chance(context, word):
            after = by_context.get(context)
            if not after:
                return lower(context[1:], word)
            total = sum(after.values())
            left = 1 - sum(n - d[min(n, 3) - 1] for n in after.values()) / total
            own = (after[word] - d[min(after[word], 3) - 1]) / total if word in after else 0.0
            return own + left * lower(context[1:], word)
        return chance

    chance = level(triples, level(pairs, lambda _, word: share_of.get(word, 0.0) + spare))

    def log_perplexity(text):
        s = padded(text)
        logs = sum(log(chance((a, b), c)) - (log(others) if c == OTHER else 0) for a, b, c in zip(s, s[1:], s[2:]))
        return -logs / (len(s) - 2)
    return log_perplexity


@pytest.mark.parametrize("share", [1e-6, 5e-3])
def test_log_perplexity_equals_the_model_written_out(spark, share):
    draw = random.Random(11)
    texts = ["", "one", "two words", "never seen before"]
    for _ in range(150):
        at, text = draw.randrange(80), []
        for _ in range(draw.randrange(1, 90)):
            at = (at * 3 + draw.choice([1, 1, 2])) % 80 if draw.random() < 0.7 else draw.randrange(80)
            text.append(f"W{at}" if draw.random() < 0.95 else f"rare{draw.randrange(300)}")
        texts.append(" ".join(text))
    expected = written_out(texts, share)
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = perplexity.quality(docs, word_share=share, entry_share=1e-9).select("doc_id", "log_perplexity").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.log_perplexity == pytest.approx(expected(texts[r.doc_id]), abs=1e-4)
