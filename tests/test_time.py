import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.correlation import service_correlation
from tracewell.operators.spikes import detect_spikes, error_rate
from tracewell.operators.timeline import timeline, timeline_pivot


def burst_rows(seed, n=1500):
    rng, rows, now = random.Random(seed), [], 0.0
    for i in range(n):
        dense = (i // 150) % 2
        now += round(rng.choice([0.0, 0.001, 0.01, 0.2]) if dense else rng.choice([0.3, 1.0, 5.0, 90.0]), 3)
        rows.append((i, now, rng.choice(["error", "fatal", "unknown", "error", "info"]), rng.choice(["a", "b", None]), "m"))
    return rows


def detector_model(rows):
    """Sequential detector; the first error is sampled."""
    window, average, last, rates, spikes = [], 0.0, None, [], []
    for seq, secs, level, service, _ in rows:
        if level == "info":
            continue
        now = round(secs * 1_000_000)
        window = [t for t in window if t >= now - 60_000_000] + [now]
        rates.append((seq, len(window)))
        if last is None or now - last >= 1_000_000:
            rate = float(len(window))
            average = rate if average == 0.0 else 0.3 * rate + 0.7 * average
            last = now
            if average > 1.0 and rate >= 3.0 * average:
                spikes.append((now, rate, round(average, 6), service))
    return rates, spikes


@pytest.mark.parametrize("seed", [1, 2])
def test_spikes_and_rates_agree_with_sequential_model(make_entries, seed):
    rows = burst_rows(seed)
    # A sudden burst after a quiet time.
    rows += [(2000 + i, rows[-1][1] + 4000 + i * 30, "error", "q", "m") for i in range(20)]
    start = rows[-1][1] + 40
    rows += [(3000 + i, start + i * 0.004, "error", "z", "m") for i in range(400)]
    rates, spikes = detector_model(rows)
    entries = make_entries(rows)
    assert sorted((r["seq"], r["rate"]) for r in error_rate(entries).collect()) == rates
    got = detect_spikes(entries).select(F.unix_micros(F.col("detected_at").cast("timestamp")).alias("us"), "rate", "baseline", "service").collect()
    assert spikes and sorted((r["us"] - 1704067200 * 1_000_000, r["rate"], round(r["baseline"], 6), r["service"]) for r in got) == spikes


def test_spikes_per_key(make_entries):
    rows, seq = [], 0
    for service, shift in (("a", 0.0), ("b", 0.37)):
        for i in range(20):
            rows.append((seq, i * 30 + shift, "error", service, "m")); seq += 1
        for i in range(300):
            rows.append((seq, 640 + shift + i * 0.004, "error", service, "m")); seq += 1
    got = detect_spikes(make_entries(rows), key="service").collect()
    for service in ("a", "b"):
        _, spikes = detector_model(sorted((r for r in rows if r[3] == service), key=lambda r: (r[1], r[0])))
        assert [(r["rate"], round(r["baseline"], 6)) for r in sorted((r for r in got if r["key"] == service), key=lambda r: r["detected_at"])] == [s[1:3] for s in spikes]
        assert spikes


@pytest.mark.parametrize("window", [0, 1, 7, 60])
def test_correlation_agrees_with_brute_force(make_entries, window):
    rng = random.Random(window)
    rows = [(i, rng.random() * 900, "error", rng.choice("aabcde"), "m") for i in range(300)] + [(900, 5, "error", None, "m")]
    by_service = {}
    for r in rows:
        if r[3]:
            by_service.setdefault(r[3], []).append(int(r[1]))
    expected = {}
    for a in by_service:
        for b in by_service:
            if a < b:
                co = sum(any(abs(t - u) <= window for u in by_service[b]) for t in by_service[a])
                score = co / min(len(by_service[a]), len(by_service[b]))
                if score > 0.3:
                    expected[a, b] = round(score, 5)
    got = service_correlation(make_entries(rows), window).collect()
    assert {(r["service_a"], r["service_b"]): round(r["correlation_score"], 5) for r in got} == pytest.approx(expected, abs=1e-5)
    assert [r["correlation_score"] for r in got] == sorted((r["correlation_score"] for r in got), reverse=True)


def test_timeline(make_entries):
    entries = make_entries([(0, 0, "error", "s", "m"), (1, 299.999, "info", "s", "m"), (2, 300, "info", "s", "m"), (3, 601, "fatal", "s", "m")])
    buckets = timeline(entries, to_time="2024-01-01 00:05:00").collect()
    assert [(b["bucket"].minute, b["total"], b["by_level"]) for b in buckets] == [(0, 2, {"error": 1, "info": 1}), (5, 1, {"info": 1})]
    pivoted = timeline_pivot(entries).collect()
    assert [(p["error"], p["warn"], p["info"], p["total"]) for p in pivoted] == [(1, 0, 1, 2), (0, 0, 1, 1), (0, 0, 0, 1)]
