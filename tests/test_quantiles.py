"""Radix refinement gives what the built-in aggregate gives."""

from __future__ import annotations

import math
import random

import pytest

from panelspark.operators import quantiles as Q


def _rows():
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 1e-3)) for _ in range(700)] + [("ties", float(rng.randint(0, 3))) for _ in range(90)]
    rows += [(None, rng.uniform(-5, 5)) for _ in range(41)] + [("one", 2.5), ("none", None), ("none", float("nan"))]
    rows += [("ends", v) for v in (math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1.0, math.nextafter(1, 2), math.nextafter(1, 0))]
    return rows


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_refinement_equals_the_aggregate(spark, monkeypatch, p):
    df = spark.createDataFrame(_rows(), "g string, v double").repartition(5)
    direct = {r["g"]: r["q"] for r in Q.grouped_percentile(df, ["g"], "v", p, "q").collect()}
    monkeypatch.setattr(Q, "DIRECT", 5)
    refined = {r["g"]: r["q"] for r in Q.grouped_percentile(df, ["g"], "v", p, "q").collect()}
    assert refined == direct and refined["none"] is None
    monkeypatch.setattr(Q, "DIRECT", -1)
    assert {r["g"]: r["q"] for r in Q.grouped_percentile(df, ["g"], "v", p, "q").collect()} == direct


def test_global_quantiles_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i * 0.25, float(i % 7)) for i in range(333)], "a double, b double")
    direct = Q.exact_quantiles(df, ["a", "b"], 0.9)
    monkeypatch.setattr(Q, "DIRECT_COLUMNS", 0)
    assert Q.exact_quantiles(df, ["a", "b"], 0.9) == direct
    assert Q.exact_medians(df.limit(0), ["a"]) == {"a": None}


def test_order_key_keeps_the_order(spark):
    values = sorted({v for _, v in _rows() if v is not None and not math.isnan(v)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    keys = {r["v"]: r["k"] for r in df.select("v", Q.order_key(df.v).alias("k")).collect()}
    assert [keys[v] for v in values] == sorted(keys.values()) and len(set(keys.values())) == len(values)
