"""Sums of gradients over tasks, for models whose weights fit the driver.

Each task adds up the gradients of its rows into one row; the rows of many tasks are added ``FAN`` at a time, level by level, so
no task ever gets more than ``FAN`` of them and the driver gets one. A repeated task gives the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

#: Rows of a task at once, and tasks whose sums are added at once.
ROWS, FAN = 256, 16
SUMS = "part long, n double, loss double, gradient array<double>"
_SUMS = pa.schema([("part", pa.int64()), ("n", pa.float64()), ("loss", pa.float64()), ("gradient", pa.list_(pa.float64()))])
#: (weights, rows) -> (rows or their weight, sum of losses, sum of gradients or None).
Loss = Callable[[np.ndarray, pa.RecordBatch], tuple[float, float, np.ndarray | None]]


class Adam:
    """The update with decay added to the gradient, which may be cut to a largest norm before."""

    def __init__(self, n: int, rate: float, decay: float = 0.0, clip: float = np.inf):
        self.rate, self.decay, self.clip, self.m, self.v, self.t = rate, decay, clip, np.zeros(n), np.zeros(n), 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g * min(1.0, self.clip / (np.linalg.norm(g) + 1e-6)) + self.decay * w
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _sums(batches: Iterator[pa.RecordBatch], weights, loss: Loss, rows: int) -> Iterator[pa.RecordBatch]:
    n, total, gradient, seen = 0.0, 0.0, None, False
    for b in batches:
        for i in range(0, b.num_rows, rows):
            m, one, g = loss(weights.value, b.slice(i, rows))
            n, total, seen = n + m, total + one, True
            gradient = g if gradient is None else gradient + g if g is not None else gradient
    if seen:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": n, "loss": total, "gradient": [] if gradient is None else gradient}], _SUMS)


def _added(t: pa.Table) -> pa.Table:
    t = t.sort_by("part")  # always in one order, so sums come out the same
    g = t["gradient"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(axis=0)
    return pa.Table.from_pydict({"part": [t["part"][0].as_py() // FAN], "n": [sum(t["n"].to_pylist())], "loss": [sum(t["loss"].to_pylist())], "gradient": [g]}, _SUMS)


def tasks_of(df: DataFrame) -> int:
    """Tasks that read a stored table."""
    return (df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1


def summed(rows: DataFrame, tasks: int, weights: np.ndarray, loss: Loss, at_once: int = ROWS) -> tuple[float, float, np.ndarray]:
    """(rows or their weight, loss, gradient) of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    level = rows.mapInArrow(lambda it: _sums(it, sent, loss, at_once), SUMS)
    while tasks > 1:
        level = level.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(_added, SUMS)
        tasks = -(-tasks // FAN)
    got = sorted(level.collect(), key=lambda r: r["part"])
    sent.unpersist()
    g = np.sum([r["gradient"] for r in got], axis=0) if got else np.zeros(len(weights))
    return sum(r["n"] for r in got), sum(r["loss"] for r in got), np.asarray(g)
