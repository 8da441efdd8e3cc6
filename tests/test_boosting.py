"""Boosted trees against a plain numpy version."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from panelspark.operators import boosting as B

EDGES = [[0.2, 0.4, 0.6, 0.8], [1.0, 2.0], [5.0]]


def plain(x, y, classes, rounds, depth, rate, penalty):
    """Margins (rows x classes) after ``rounds``; x holds bins."""
    n, k = len(y), classes or 1
    m = np.zeros((n, k)) if classes else np.full((n, 1), y.mean())
    for _ in range(rounds):
        if classes:
            p = np.exp(m - m.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(k)), np.maximum(2 * p * (1 - p), 1e-16)
        else:
            g, h = m - y[:, None], np.ones((n, 1))
        step = np.zeros_like(m)
        for c in range(k):
            node = np.zeros(n, int)
            for _level in range(depth):
                moved = node.copy()
                for one in np.unique(node):
                    rows = node == one
                    G, H = g[rows, c].sum(), h[rows, c].sum()
                    best, split = 1e-9, None
                    for f in range(x.shape[1]):
                        for b in np.unique(x[rows, f])[:-1]:
                            left = rows & (x[:, f] <= b)
                            gl, hl = g[left, c].sum(), h[left, c].sum()
                            if hl < 1 or H - hl < 1:
                                continue
                            gain = gl**2 / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G**2 / (H + penalty)
                            if gain > best + 1e-9 * abs(best):
                                best, split = gain, (f, b)
                    if split:
                        moved[rows] = 2 * one + 1 + (x[rows, split[0]] > split[1])
                node = moved
            for one in np.unique(node):
                rows = node == one
                step[rows, c] = -rate * g[rows, c].sum() / (h[rows, c].sum() + penalty)
        m = m + step
    return m


def _data(n=300):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.choice([0.5, 1.5, 2.5, None, float("nan")]), rng.uniform(0, 10)
        target = 3 * (a > 0.4) + (2 if b is not None and b > 1 else 0) + rng.gauss(0, 0.3)
        rows.append((i, a, b, c, target, "xyz"[min(2, int(max(0.0, target) / 2))]))
    return rows


def _bins(rows):
    return np.array([[0 if v is None or math.isnan(v) else sum(v > e for e in own) for v, own in zip(r[1:4], EDGES, strict=True)] for r in rows])


SCHEMA = "id int, a double, b double, `c d` double, target double, kind string"
FEATURES = ["a", "b", "c d"]
PARAMS = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "reg_lambda": 1.5}


def test_regression_equals_plain(spark):
    rows = _data()
    df = spark.createDataFrame(rows, SCHEMA)
    model = B.fit(df, FEATURES, "target", PARAMS, EDGES)
    expected = plain(_bins(rows), np.array([r[4] for r in rows]), 0, 3, 3, 0.3, 1.5)
    got = {r["id"]: r["prediction"] for r in B.predict(model, df).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(expected[:, 0].tolist())


def test_classes_equal_plain_and_sum_to_one(spark):
    rows = _data()
    df = spark.createDataFrame([*rows, (999, 0.1, 0.2, 0.3, 1.0, None)], SCHEMA)
    model = B.fit(df, FEATURES, "kind", PARAMS, EDGES, classify=True)
    assert model.classes == ["x", "y", "z"]
    y = np.array(["xyz".index(r[5]) for r in rows])
    m = plain(_bins(rows), y, 3, 3, 3, 0.3, 1.5)
    p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
    got = {r["id"]: r for r in B.predict(model, df).collect()}
    assert len(got) == len(rows) + 1  # a row without a label is scored, not learnt from
    for i in range(len(rows)):
        assert list(got[i]["probabilities"].values()) == pytest.approx(p[i].tolist())
        assert got[i]["prediction"] == "xyz"[int(m[i].argmax())]
        assert sum(got[i]["probabilities"].values()) == pytest.approx(1)
    assert np.mean([got[i]["prediction"] == rows[i][5] for i in range(len(rows))]) > 0.9


def test_penalty_shrinks_leaves_and_sampling_repeats(spark):
    df = spark.createDataFrame(_data(120), SCHEMA)
    one = {**PARAMS, "n_estimators": 1, "max_depth": 1}
    loose = B.fit(df, FEATURES, "target", {**one, "reg_lambda": 0.0}, EDGES)
    tight = B.fit(df, FEATURES, "target", {**one, "reg_lambda": 1000.0}, EDGES)
    assert max(map(abs, tight.rounds[0][0].weight)) < 0.2 * max(map(abs, loose.rounds[0][0].weight))
    drawn = {**one, "subsample": 0.5, "colsample_bytree": 0.67, "n_estimators": 2}
    first, again = (B.fit(df.repartition(n), FEATURES, "target", drawn, EDGES) for n in (1, 5))
    assert [t.feature for r in first.rounds for t in r] == [t.feature for r in again.rounds for t in r]
    assert first.rounds[0][0].weight == pytest.approx(again.rounds[0][0].weight)
    assert first.rounds[0][0].weight != pytest.approx(loose.rounds[0][0].weight)


def test_quantile_edges_empty_table_and_saved_model(spark, tmpdir_path):
    df = spark.createDataFrame(_data(200), SCHEMA)
    model = B.fit(df, FEATURES, "target", {**PARAMS, "n_estimators": 1})
    assert all(e == sorted(set(e)) for e in model.edges) and len(model.edges[0]) > 20
    B.save_boosted(spark, model, f"{tmpdir_path}/m")
    again = B.load_boosted(spark, f"{tmpdir_path}/m")
    assert again == model
    table = B.as_table(spark, model)
    assert table.filter("feature is not null and edge is null").count() == 0
    empty = B.fit(df.limit(0), FEATURES, "target", PARAMS, EDGES)
    assert {r["prediction"] for r in B.predict(empty, df).collect()} == {0.0}
    assert B.fit(df.limit(0), FEATURES, "kind", PARAMS, EDGES, classify=True).classes == []


@pytest.mark.parametrize("classify", [False, True])
def test_rows_of_equal_bins_are_one(spark, monkeypatch, classify):
    rng = random.Random(8)
    values = [(rng.choice([0.1, 0.5, None]), rng.choice([0.5, 3.0]), rng.choice("uvw"), rng.random()) for _ in range(600)]
    df = spark.createDataFrame(values, "a double, b double, flag string, price double")
    sizes, write = [], B._written

    def written(rows, name):
        out = write(rows, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "_written", written)
    params = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "reg_lambda": 1.0}
    model = B.fit(df, ["a", "b"], "flag" if classify else "price", params, [[0.2], [1.0, 2.0]], classify=classify)
    assert max(sizes) <= (12 if classify else 4)
    assert len(model.rounds) == 2 and any(t.feature[0] >= 0 for t in model.rounds[0])
