"""The perplexity model in tables against modified Kneser-Ney written out in plain Python."""

import random
from collections import Counter, defaultdict
from math import log

import pytest

from test_kneser_ney import discounts
from tracewell.llm import perplexity, runs

START, STOP = "<start>", "<stop>"


def written_out(texts, least):
    """A function from a text to its log perplexity: all words, and the pairs and triples that occur often enough."""
    padded = lambda text: [START, START] + text.lower().split() + [STOP]
    triples = Counter(g for t in texts for s in [padded(t)] for g in zip(s, s[1:], s[2:]))
    pairs_n, before = Counter(), defaultdict(list)
    for (a, b, c), n in triples.items():
        before[b, c].append(n)
        pairs_n[b, c] += n
    pairs = {g: sum(ns) if g[0] == START else len(ns) for g, ns in before.items()}
    singles = Counter(c for _, c in pairs)
    d1 = discounts(singles.values())
    share_of = {w: (n - d1[min(n, 3) - 1]) / len(pairs) for w, n in singles.items()}
    spare = (1 - sum(share_of.values())) / len(singles)

    def level(grams, kept, lower):
        d, totals, by_context = discounts(grams.values()), Counter(), defaultdict(dict)
        for g, n in grams.items():
            totals[g[:-1]] += n
            if kept[g] >= least:
                by_context[g[:-1]][g[-1]] = n

        def chance(context, word):
            after = by_context.get(context, {})
            own = {w: (n - d[min(n, 3) - 1]) / totals[context] for w, n in after.items()}
            return own.get(word, 0.0) + (1 - sum(own.values())) * lower(context[1:], word)
        return chance

    chance = level(triples, triples, level(pairs, pairs_n, lambda _, word: share_of[word] + spare))
    return lambda text: -sum(log(chance((a, b), c)) for s in [padded(text)] for a, b, c in zip(s, s[1:], s[2:])) / (len(padded(text)) - 2)


@pytest.mark.parametrize("passes, least", [(1, perplexity.LEAST), (3, 2)])
def test_rare_words_and_triples_are_in_the_model(spark, monkeypatch, passes, least):
    monkeypatch.setattr(perplexity, "LEAST", least)
    if passes > 1:
        monkeypatch.setattr(runs, "TOKENS_A_PASS", 1000)
        monkeypatch.setattr(perplexity, "SENT", 1e-2)
    draw = random.Random(12)
    # Words far below 1e-4 and triples far below 1e-6 of what a large corpus has: shares must not matter.
    texts = [" ".join(f"W{int(draw.paretovariate(0.7)) % 900}" for _ in range(draw.randrange(1, 90))) for _ in range(160)]
    planted = " ".join(f"rare{i}" for i in range(60))
    texts += ["", "one", "Two words", "never seen before", planted, planted + " and more", texts[0]]
    docs = spark.createDataFrame([(i // 2, "en", t) for i, t in enumerate(texts)] + [(0, "en", texts[0]), (None, "en", None)],
                                 "doc_id long, lang string, text string")
    expected = written_out([*texts, texts[0], ""], least)
    got = perplexity.quality(docs).select("doc_id", "n_words", "text_a", "log_perplexity")
    hashes = {r.a: r.text for r in docs.selectExpr("xxhash64(text) as a", "coalesce(text, '') as text").collect()}
    got = got.collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.log_perplexity == pytest.approx(expected(hashes[r.text_a]), abs=1e-9)


def test_sums_of_texts_come_back_by_slices(spark, monkeypatch, tmp_path):
    # A row for each text and bucket would grow with the product of both.
    looked_up = runs._looked_up

    def counting(*args):
        run = looked_up(*args)

        def counted(rows, table):
            found = run(rows, table)
            with open(tmp_path / "rows", "a") as log:
                log.write(f"{found.num_rows}\n")
            return found
        return counted

    monkeypatch.setattr(runs, "_looked_up", counting)
    monkeypatch.setattr(perplexity, "LEAST", 2)
    monkeypatch.setattr(perplexity, "SENT", 1e-2)
    draw = random.Random(4)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 900}" for _ in range(40)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(2)
    got = {r.key: r.logs for r in perplexity.text_logs(rows).collect()}
    expected = written_out(texts, 2)
    assert all(got[i] == pytest.approx(-41 * expected(t), abs=1e-6) for i, t in enumerate(texts))
    assert sum(map(int, (tmp_path / "rows").read_text().split())) < len(texts) / 4


def test_runs_that_occur_once_are_in_the_model(spark):
    # Pairs and triples below any least count, in texts with and without copies, at the start and at the end.
    texts = ["a b c d", "a b c e", "b c d a b", "once only", "x", "", "a b c d", "c d a b x y", "b b b b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    expected = written_out(texts, 1)
    got = {r.key: r.logs for r in perplexity.text_logs(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(-(len(t.split()) + 1) * expected(t), abs=1e-9)
