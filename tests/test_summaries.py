from __future__ import annotations

import math
import random
from collections import Counter

from panelspark.operators.summaries import BINS, RANK_ERROR, coarsened, daily, merged_quantile, sketched, window_psi

SCHEMA = "day int, x double, y double"


def _rows(rng, n=3000):
    scale = [1e-6, 1.0, 3.0, 1e5, 0.0]
    return [(d := rng.randrange(10), rng.gauss(d, 1) * scale[d % 5], rng.choice([7.0, 7.0, -2.5, None, math.nan])) for _ in range(n)]


def test_merged_days_have_the_bins_of_the_raw_rows(spark):
    rows = _rows(random.Random(3))
    stored = daily(spark.createDataFrame(rows, SCHEMA), "day", ["x", "y"])
    assert all(n <= BINS + 2 for n in Counter((r.day, r.feature) for r in stored.collect()).values())
    for bins in (16, 128):
        out = coarsened(stored.drop("day"), bins=bins).collect()
        for feature, at in (("x", 1), ("y", 2)):
            mine = [r for r in out if r.feature == feature]
            (e,) = {r.e for r in mine}
            raw = Counter(math.floor(r[at] / 2.0**e) for r in rows if r[at] is not None and not math.isnan(r[at]))
            assert {r.bin: r.n for r in mine} == raw and max(raw) - min(raw) < bins


def test_order_of_merging_does_not_matter(spark):
    stored = daily(spark.createDataFrame(_rows(random.Random(4)), SCHEMA), "day", ["x"])
    half = coarsened(stored.filter("day < 5").drop("day"), bins=128).unionByName(stored.filter("day >= 5").drop("day"))
    told = lambda df: {(r.e, r.bin, r.n) for r in coarsened(df, bins=16).collect()}
    assert told(half) == told(stored.drop("day"))


def test_infinite_null_and_empty_days(spark):
    inf = math.inf
    rows = [(1, inf, 1.0), (1, 4.0, None), (1, -inf, None), (1, 2.0, None), (2, inf, None), (None, 3.0, -0.0), (3, math.nan, 1e308), (3, None, -1e308)]
    out = {(r.day, r.feature): 0 for r in daily(spark.createDataFrame(rows, SCHEMA), "day", ["x", "y"]).collect()}
    assert set(out) == {(1, "x"), (1, "y"), (None, "x"), (None, "y"), (3, "y")}
    per = {}
    for r in daily(spark.createDataFrame(rows, SCHEMA), "day", ["x", "y"]).collect():
        per.setdefault((r.day, r.feature), []).append((r.bin * 2.0**r.e, r.n))
    assert sorted(n for _, n in per[1, "x"]) == [2, 2] and per[None, "y"] == [(0.0, 1)] and len(per[3, "y"]) == 2
    empty = daily(spark.createDataFrame([], SCHEMA), "day", ["x"])
    assert empty.collect() == [] and window_psi(empty, empty).collect() == []


def test_psi_of_windows(spark):
    rng = random.Random(5)
    rows = [(d, rng.gauss(0 if d < 4 else 2, 1), 1.0) for d in range(8) for _ in range(500)]
    stored = daily(spark.createDataFrame(rows, SCHEMA), "day", ["x", "y"])
    same = {r.feature: r for r in window_psi(stored.filter("day < 2"), stored.filter("day in (2, 3)")).collect()}
    moved = {r.feature: r for r in window_psi(stored.filter("day < 4"), stored.filter("day >= 4")).collect()}
    assert not same["x"].drifted and moved["x"].drifted and moved["x"].n_current == 2000 and moved["y"].psi == 0.0


def test_sketches_are_exact_when_small_and_near_when_large(spark):
    rng = random.Random(6)
    rows = [("big" if i % 20 else None, i % 7, rng.random() if i % 50 else math.nan) for i in range(40_000)] + [("small", i % 7, float(i)) for i in range(51)]
    stored = sketched(spark.createDataFrame(rows, "k string, part int, x double"), ["k", "part"], ["x"])
    out = {r.k: r for r in merged_quantile(stored, ["k"]).collect()}
    assert out["small"].value == 25.0 and out["small"].n == 51
    big = [x for k, _, x in rows if k == "big" and not math.isnan(x)]
    assert out["big"].n == len(big)
    assert abs(sum(x <= out["big"].value for x in big) / len(big) - 0.5) <= 2 * RANK_ERROR
