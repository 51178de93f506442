"""The recurrent model: gradients against finite differences, steps against a plain loop, training, and global row numbers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model, recurrent
from tidemark.storage import numbered

T0 = dt.datetime(2024, 1, 1)
SEQ = "ticker string, ts timestamp, seq array<array<double>>, target int"


def _rows(n, seed=0, steps=5, features=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, steps, features))
    return x, (x[:, -2:, 0].sum(axis=1) > 0).astype(int)


def _frame(spark, x, y):
    return spark.createDataFrame([(f"t{i % 3}", T0 + dt.timedelta(hours=i), a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], SEQ)


@pytest.mark.parametrize("key", [None, [1, 2, 3]])
def test_gradient_is_that_of_finite_differences(key):
    shape = recurrent.Shape(3, 5, 4, 6)
    x, y = _rows(7)
    w = recurrent.begin(shape, 1)
    _, g, _ = recurrent.loss_and_gradient(w, shape, x, y, 0.3, key)
    r = np.random.default_rng(2)
    for i in r.choice(len(w), 80, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        want = (recurrent.loss_and_gradient(up, shape, x, y, 0.3, key)[0] - recurrent.loss_and_gradient(down, shape, x, y, 0.3, key)[0]) / 2e-5
        assert g[i] == pytest.approx(want, rel=1e-4, abs=1e-7)


def test_forward_is_a_plain_loop():
    shape = recurrent.Shape(2, 4, 3, 5)
    x, y = _rows(3, steps=4, features=2)
    w = recurrent.begin(shape, 3)
    p = recurrent.unpacked(w, shape)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def layer(seq, wx, wh, b):
        h, c, out = np.zeros(3), np.zeros(3), []
        for v in seq:
            z = v @ wx + h @ wh + b
            c = sig(z[3:6]) * c + sig(z[:3]) * np.tanh(z[6:9])
            h = sig(z[9:]) * np.tanh(c)
            out.append(h)
        return out

    got = recurrent.loss_and_gradient(w, shape, x, y, gradient=False)[2]
    for k in range(3):
        last = layer(layer(x[k], p["x1"], p["h1"], p["b1"]), p["x2"], p["h2"], p["b2"])[-1]
        z = np.maximum(last @ p["w3"] + p["b3"], 0) @ p["w4"] + p["b4"]
        assert got[k] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-12)


@pytest.mark.parametrize("tasks", [1, 5, 40])
def test_sums_of_tasks_are_the_whole_gradient(spark, tasks):
    x, y = _rows(90)
    shape = recurrent.Shape(3, 5, 4)
    w = recurrent.begin(shape)
    df = _frame(spark, x, y).withColumn("row", F.lit(0).cast("long")).repartition(tasks)
    n, loss, g = recurrent.summed(df, tasks, w, shape, 0.0)
    want_loss, want, _ = recurrent.loss_and_gradient(w, shape, x, y, 0.0)
    assert n == 90 and loss == pytest.approx(want_loss) and np.allclose(g, want, atol=1e-10)


def test_training_learns_and_is_a_plain_loop(spark):
    x, y = _rows(700)
    vx, vy = _rows(150, seed=1)
    how = {"hidden": 8, "epochs": 3, "batch": 200, "drop": 0.0, "rate": 0.02}
    net = recurrent.train(_frame(spark, x, y), _frame(spark, vx, vy), **how)
    w, adam, best = recurrent.begin(net.shape), None, (np.inf, None)
    adam = recurrent.Adam(len(w), 0.02, recurrent.DECAY, recurrent.CLIP)
    history = []
    for _ in range(3):
        for i in range(0, 700, 200):
            b = slice(i, i + 200)
            w = adam.step(w, recurrent.loss_and_gradient(w, net.shape, x[b], y[b], 0.0)[1] / len(x[b]))
        history.append(recurrent.loss_and_gradient(w, net.shape, vx, vy, gradient=False)[0] / 150)
        best = min(best, (history[-1], w), key=lambda z: z[0])
    assert net.history == pytest.approx(history) and np.allclose(net.weights, best[1], atol=1e-8)
    again = recurrent.from_json(recurrent.to_json(net))
    test = recurrent.probability(_frame(spark, vx, vy), again, "p").collect()
    assert np.mean([(r.p > 0.5) == r.target for r in test]) > 0.6


def test_training_stops_and_keeps_the_best(spark, monkeypatch):
    losses = iter([0.9, 0.8, 0.85, 0.81, 0.82, 0.83, 0.84, 0.86, 0.87, 0.1])
    steps = []

    def fake(rows, tasks, w, shape, drop=0.3, key=None, gradient=True):
        if not gradient:
            return 1, next(losses), np.zeros(0)
        steps.append(key)
        return 1, 0.0, np.ones(len(w))

    monkeypatch.setattr(recurrent, "summed", fake)
    x, y = _rows(30)
    net = recurrent.train(_frame(spark, x, y), _frame(spark, x, y), hidden=2, batch=10)
    assert len(net.history) == 9 and min(net.history) == 0.8 and len(steps) == 27 and steps[:4] == [[42, 0, 0], [42, 0, 1], [42, 0, 2], [42, 1, 0]]


def test_no_rows_and_no_validation(spark):
    x, y = _rows(20)
    df = _frame(spark, x, y)
    with pytest.raises(ValueError):
        recurrent.train(df.limit(0), df)
    assert recurrent.train(df, df.limit(0), hidden=2, epochs=2).history == []


def test_row_numbers(spark):
    rows = [(i * 37 % 1000 // 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(9)
    got, n = numbered(df, "k", "id", out="at")
    assert n == 1000 and [(r.k, r.id, r["at"]) for r in got.orderBy("at").collect()] == [(k, i, p) for p, (k, i) in enumerate(sorted(rows))]
    none, n = numbered(df.limit(0), "k", out="at")
    assert n == 0 and none.count() == 0


def test_stage_uses_the_recurrent_model(spark):
    r = np.random.default_rng(0)
    rows = [("A", T0 + dt.timedelta(hours=i), ("train", "val", "test")[(i > 60) + (i > 90)], float(r.normal()), i % 2) for i in range(130)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, split string, x double, target int")
    got = model.recurrent_probability(d, ["x"], "p", steps=4, hidden=3, epochs=2)
    assert got.count() == 39 - 4 and got.where("p > 0 AND p < 1").count() == 35 and got.columns == [*d.columns, "p"]
