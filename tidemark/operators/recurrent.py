"""A recurrent direction model: two LSTM layers over a sequence of bars, trained by back-propagation through time.

The driver keeps the weights and Adam's moments (some 60,000 numbers). Sequences are stored once, numbered in time order and dealt into
mini-batches. A step sends the weights to the tasks that hold its batch, and ``descent`` adds their gradients up in levels. A task that
is repeated gives the same gradient: what is dropped out depends on the seed, the step and the row's number.

A step has ``batch`` sequences, or as many more as let an epoch have at most ``STEPS`` steps: each is a Spark job, so a larger
table has larger batches, not more jobs. The learning rate falls tenfold when the validation loss has not fallen for more than three
epochs; after seven training ends, and the weights of the best epoch are kept.

Defined cases: rows without a target or a whole sequence must be left out before; without validation rows all epochs run and the
last weights stay; without training rows there is no model and ``train`` raises ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, numbered, store
from . import descent
from .descent import ROWS, Adam, tasks_of

#: Hidden units, units between them and the two classes, share dropped out, epochs, sequences of a step, learning rate,
#: weight decay, largest norm of a gradient, epochs without a better loss before the rate falls and before training ends.
HIDDEN, DENSE, DROP, EPOCHS, BATCH, RATE, DECAY, CLIP, FALL, PATIENCE = 64, 32, 0.3, 30, 256, 1e-3, 1e-4, 1.0, 3, 7
#: Steps of an epoch at most.
STEPS = 8


class Shape(NamedTuple):
    features: int
    steps: int
    hidden: int = HIDDEN
    dense: int = DENSE

    def parts(self) -> dict[str, tuple[int, ...]]:
        f, h, d = self.features, self.hidden, self.dense
        return {"x1": (f, 4 * h), "h1": (h, 4 * h), "b1": (4 * h,), "x2": (h, 4 * h), "h2": (h, 4 * h), "b2": (4 * h,), "w3": (h, d), "b3": (d,), "w4": (d, 2), "b4": (2,)}


def unpacked(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.parts().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def packed(parts: dict[str, np.ndarray], shape: Shape) -> np.ndarray:
    return np.concatenate([parts[k].ravel() for k in shape.parts()])


def begin(shape: Shape, seed: int = 42) -> np.ndarray:
    """Uniform weights, of layers by the root of their units, of dense ones by the root of what comes in."""
    r, bound = np.random.default_rng(seed), {"w3": shape.hidden, "b3": shape.hidden, "w4": shape.dense, "b4": shape.dense}
    return np.concatenate([r.uniform(-1, 1, int(np.prod(s))) / np.sqrt(bound.get(k, shape.hidden)) for k, s in shape.parts().items()])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class _Layer:
    """One layer over (rows, steps, inputs), remembering what the way back needs."""

    def __init__(self, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
        self.wx, self.wh, self.b, self.h = wx, wh, b, wh.shape[0]

    def forward(self, x: np.ndarray) -> np.ndarray:
        n, steps, h = len(x), x.shape[1], self.h
        self.x, self.gates, self.cells = x, np.empty((steps, n, 4 * h)), np.zeros((steps + 1, n, h))
        self.out = np.zeros((steps + 1, n, h))
        into = x @ self.wx + self.b
        for t in range(steps):
            z = into[:, t] + self.out[t] @ self.wh
            z[:, : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :] = _sigmoid(z[:, : 2 * h]), np.tanh(z[:, 2 * h : 3 * h]), _sigmoid(z[:, 3 * h :])
            i, f, g, o = np.split(z, 4, axis=1)
            self.gates[t] = z
            self.cells[t + 1] = f * self.cells[t] + i * g
            self.out[t + 1] = o * np.tanh(self.cells[t + 1])
        return self.out[1:].transpose(1, 0, 2)

    def backward(self, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the inputs and of the three weights, from that of every output (rows, steps, units)."""
        n, steps, h = len(self.x), self.x.shape[1], self.h
        dz = np.empty((steps, n, 4 * h))
        dh, dc = np.zeros((n, h)), np.zeros((n, h))
        for t in range(steps - 1, -1, -1):
            i, f, g, o = np.split(self.gates[t], 4, axis=1)
            tanh = np.tanh(self.cells[t + 1])
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tanh**2)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * self.cells[t] * f * (1 - f), dc * i * (1 - g**2), dh * tanh * o * (1 - o)], axis=1)
            dh, dc = dz[t] @ self.wh.T, dc * f
        flat = dz.reshape(-1, 4 * h)
        dx = (flat @ self.wx.T).reshape(steps, n, -1).transpose(1, 0, 2)
        return dx, self.x.transpose(1, 0, 2).reshape(steps * n, -1).T @ flat, self.out[:-1].reshape(-1, h).T @ flat, flat.sum(axis=0)


def _masks(n: int, shape: Shape, drop: float, key: list[int] | None) -> tuple[np.ndarray | float, np.ndarray | float]:
    if key is None or not drop:
        return 1.0, 1.0
    r = np.random.default_rng(key)
    return (r.random((n, shape.steps, shape.hidden)) >= drop) / (1 - drop), (r.random((n, shape.hidden)) >= drop) / (1 - drop)


def loss_and_gradient(flat: np.ndarray, shape: Shape, x: np.ndarray, y: np.ndarray, drop: float = DROP, key: list[int] | None = None, gradient: bool = True) -> tuple[float, np.ndarray | None, np.ndarray]:
    """(sum of the rows' losses, its gradient, probabilities of up). ``key`` seeds what is dropped out; None drops nothing."""
    p = unpacked(flat, shape)
    one, two = _Layer(p["x1"], p["h1"], p["b1"]), _Layer(p["x2"], p["h2"], p["b2"])
    m1, m2 = _masks(len(x), shape, drop, key)
    last = two.forward(one.forward(x) * m1)[:, -1] * m2
    pre = last @ p["w3"] + p["b3"]
    hidden = np.maximum(pre, 0)
    z = hidden @ p["w4"] + p["b4"]
    z = z - z.max(axis=1, keepdims=True)
    q = np.exp(z)
    q /= q.sum(axis=1, keepdims=True)
    loss = -float(np.log(np.maximum(q[np.arange(len(y)), y], 1e-300)).sum())
    if not gradient:
        return loss, None, q[:, 1]
    dz = q.copy()
    dz[np.arange(len(y)), y] -= 1
    d_pre = dz @ p["w4"].T * (pre > 0)
    d_out = np.zeros((len(x), shape.steps, shape.hidden))
    d_out[:, -1] = d_pre @ p["w3"].T * m2
    d_in, x2, h2, b2 = two.backward(d_out)
    _, x1, h1, b1 = one.backward(d_in * m1)
    g = {"x1": x1, "h1": h1, "b1": b1, "x2": x2, "h2": h2, "b2": b2, "w3": last.T @ d_pre, "b3": d_pre.sum(0), "w4": hidden.T @ dz, "b4": dz.sum(0)}
    return loss, packed(g, shape), q[:, 1]


def _matrix(col: pa.Array, shape: Shape) -> np.ndarray:
    return np.asarray(col.flatten().flatten().cast(pa.float64())).reshape(len(col), shape.steps, shape.features)


def summed(rows: DataFrame, tasks: int, weights: np.ndarray, shape: Shape, drop: float = DROP, key: list[int] | None = None, gradient: bool = True) -> tuple[float, float, np.ndarray]:
    """(rows, loss, gradient) of (seq, target, row): sums, however many tasks they come from."""

    def loss(w: np.ndarray, b: pa.RecordBatch) -> tuple[float, float, np.ndarray | None]:
        own = None if key is None else [*key, b.column(2)[0].as_py()]
        total, g, _ = loss_and_gradient(w, shape, _matrix(b.column(0), shape), np.asarray(b.column(1), np.int64), drop, own, gradient)
        return b.num_rows, total, g

    return descent.summed(rows.select("seq", "target", "row"), tasks, weights, loss)


class Recurrent(NamedTuple):
    shape: Shape
    weights: np.ndarray
    history: list[float]  # validation loss of each epoch


def train(rows: DataFrame, val: DataFrame, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, drop: float = DROP, seed: int = 42, order: tuple[str, ...] = ("ts", "ticker"), steps: int = STEPS) -> Recurrent:
    """A model of ``target`` (0 or 1) from ``seq`` (arrays of steps of features), in time order."""
    # Ties of the order are broken by the sequence, so a repeated run deals the same batches.
    keyed = rows.withColumn("_tie", F.xxhash64("seq", "target"))
    placed, n = numbered(keyed, *order, "_tie")
    if not n:
        raise ValueError("no rows to train on")
    size = max(batch, -(-n // steps))
    count = -(-n // size)
    data = store(placed.select("seq", "target", "row", F.floor(F.col("row") / size).cast("int").alias("batch")).repartition(F.col("batch"), F.col("row") % max(1, size // 4096)).sortWithinPartitions("row"), "sequences", ("batch",))
    one = data.select("seq").first()["seq"]
    shape = Shape(len(one[0]), len(one), hidden)
    checked = store(val.select("seq", "target", F.lit(0).cast("long").alias("row")), "validation")
    parts = [data.where(F.col("batch") == k) for k in range(count)]
    tasks, val_tasks = max(tasks_of(p) for p in parts[:1]), tasks_of(checked)
    w = begin(shape, seed)
    adam, best, kept, waited, since, history = Adam(len(w), rate, DECAY, CLIP), np.inf, w, 0, 0, []
    for epoch in range(epochs):
        for k, part in enumerate(parts):
            m, _, g = summed(part, tasks, w, shape, drop, [seed, epoch, k])
            w = adam.step(w, g / m)
        m, loss, _ = summed(checked, val_tasks, w, shape, gradient=False)
        if not m:
            kept = w
            continue
        history.append(loss / m)
        if history[-1] < best:
            best, kept, waited, since = history[-1], w, 0, 0
            continue
        waited, since = waited + 1, since + 1
        if since > FALL:
            adam.rate, since = adam.rate * 0.1, 0
        if waited >= PATIENCE:
            break
    forget(data, checked)
    return Recurrent(shape, kept, history)


def probability(rows: DataFrame, model: Recurrent, out: str) -> DataFrame:
    """``rows`` (with ``seq``) and the probability of up."""
    shape, sent = model.shape, rows.sparkSession.sparkContext.broadcast(model.weights)
    names = rows.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                c = b.slice(i, ROWS)
                x = _matrix(c.column(c.schema.get_field_index("seq")), shape)
                p = loss_and_gradient(sent.value, shape, x, np.zeros(len(x), np.int64), gradient=False)[2]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(p)], [*names, out])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(put, f"{kinds}, {out} double")


def to_json(model: Recurrent) -> str:
    return json.dumps({"shape": list(model.shape), "weights": model.weights.tolist(), "history": model.history})


def from_json(text: str) -> Recurrent:
    d = json.loads(text)
    return Recurrent(Shape(*d["shape"]), np.array(d["weights"]), d["history"])
