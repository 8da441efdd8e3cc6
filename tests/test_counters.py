"""Rates of counters and bucket quantiles against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from panelspark.operators.counters import bucket_quantile, increases

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def plain_rates(samples, window=300, step=60):
    """samples: (series, seconds, value) -> {(series, eval seconds): (n, increase, rate)}"""
    out = {}
    for name in {s[0] for s in samples}:
        own = sorted((t, v) for s, t, v in samples if s == name)
        for e in range(0, 4000, step):
            inside = [(t, v) for t, v in own if e - window < t <= e]
            if len(inside) < 2 or inside[0][0] == inside[-1][0]:
                continue
            inc = sum(b - a if b >= a else b for (_, a), (_, b) in zip(inside, inside[1:], strict=False))
            covered = inside[-1][0] - inside[0][0]
            mean = covered / (len(inside) - 1)
            before, after = inside[0][0] - (e - window), e - inside[-1][0]
            before = mean / 2 if before >= 1.1 * mean else before
            after = mean / 2 if after >= 1.1 * mean else after
            if inc > 0:
                before = min(before, covered * inside[0][1] / inc)
            out[name, e] = (len(inside), inc, inc * (covered + before + after) / covered / window)
    return out


def test_rates_with_resets_gaps_and_hot_series(spark):
    rng = random.Random(4)
    samples = []
    for name, gap in (("hot", 3), ("slow", 140), (None, 70), ("once", 5000)):
        t, v = rng.random() * 50, 5.0
        while t < 3000:
            samples.append((name, round(t, 3), v))
            t, v = t + rng.random() * 2 * gap, (v + rng.randint(0, 4)) if rng.random() > 0.05 else float(rng.randint(0, 2))
    rows = [(s, START + dt.timedelta(seconds=t), v) for s, t, v in samples] + [("hot", None, 1.0), ("hot", START, None), ("hot", START, float("nan"))]
    got = {
        (r["k"], (r["eval_us"] - int(START.timestamp()) * 1_000_000) // 1_000_000): (r["n_samples"], r["increase"], r["rate"])
        for r in increases(spark.createDataFrame(rows, "k string, ts timestamp, value double"), ["k"]).collect()
    }
    expected = plain_rates([(s, t, v) for s, t, v in samples])
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value), key


def test_empty_table_and_single_samples_have_no_rate(spark):
    schema = "k string, ts timestamp, value double"
    assert increases(spark.createDataFrame([], schema), ["k"]).collect() == []
    assert increases(spark.createDataFrame([("a", START, 1.0), ("b", START, 1.0), ("b", START, 2.0)], schema), ["k"]).collect() == []


def test_bucket_quantile(spark):
    inf = math.inf
    rows = [
        ("mid", 1.0, 10.0), ("mid", 2.0, 10.0), ("mid", 2.0, 20.0), ("mid", 4.0, 40.0), ("mid", inf, 40.0),  # two instances of one bound
        ("first", 1.0, 10.0), ("first", inf, 10.0), ("above", 1.0, 1.0), ("above", 3.0, 2.0), ("above", inf, 10.0),
        ("none", 1.0, 0.0), ("none", inf, 0.0), ("open", 1.0, 5.0), ("dip", 1.0, 8.0), ("dip", 2.0, 7.0), ("dip", inf, 9.0),
    ]
    got = {r["t"]: r["quantile"] for r in bucket_quantile(spark.createDataFrame(rows, "t string, le double, rate double"), ["t"], 0.9).collect()}
    # mid: rank 36 of (1: 10, 2: 30, 4: 40)
    assert got["mid"] == pytest.approx(2 + 2 * (36 - 30) / 10)
    assert got["first"] == pytest.approx(0.9)
    assert got["above"] == 3.0
    assert got["none"] is None and got["open"] is None
    assert got["dip"] == pytest.approx(2.0)


def test_counters_of_one_sample_are_measured_together(spark):
    rng = random.Random(12)
    rows, a, b = [], 0, 0
    for t in range(0, 2000, 9):
        a, b = (0 if rng.random() < 0.02 else a) + rng.randrange(3), (0 if rng.random() < 0.02 else b) + rng.randrange(5)
        rows.append((rng.choice(["x", None]), START + dt.timedelta(seconds=t), float(a), float(b)))
    df = spark.createDataFrame(rows, "s string, ts timestamp, a double, b double")
    both = increases(df, ["s"], "ts", ["a", "b"])
    assert "SortAggregate" not in both._jdf.queryExecution().executedPlan().toString()
    got = both.collect()
    for c in ("a", "b"):
        want = sorted(map(str, increases(df, ["s"], "ts", c).collect()))
        assert want and sorted(str(r) for r in both.selectExpr("s", "eval_us", "n_samples", f"increase_{c} as increase", f"rate_{c} as rate").collect()) == want
    assert len(got) == len(want)
