"""A trained text classifier for sentiment: multinomial regression over hashed words and pairs of words.

Features are expressions: words of the lower-cased text, and pairs of neighbours, hashed into ``SIZE`` places, each once. The driver
keeps three weights a place (some 200,000 numbers); mini-batches are stored and dealt by a hash of the text, their gradients are added
up in levels (``descent``). Classes weigh the inverse of their share. A part of every class (``HELD``) is held out: of each class the
texts with the smallest hashes, counted, so the shares are exact. Training ends when the held-out loss has not fallen for ``PATIENCE``
epochs; the weights of the best one are kept.

Defined cases: labels that the training map does not know, null texts, texts of ten characters or fewer and repeated texts are left
out (of a repeated text the label that comes first by name stays); a text without words is scored by the bias alone; a class
without rows has no weight in the loss; without any labelled row ``train`` raises ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import label_train
from ..storage import forget, store
from .descent import Adam, summed, tasks_of
from .score import LABELS, UNCERTAIN

#: Places, share held out, characters that a text must exceed, epochs, rows of a step and steps of an epoch at most, rate, decay, patience.
SIZE, HELD, LEAST, EPOCHS, BATCH, STEPS, RATE, DECAY, PATIENCE = 1 << 16, 0.15, 10, 20, 256, 8, 0.005, 1e-5, 2
#: Values of the hash by which a class is cut; the counts of all of them are what is looked at.
CUTS = 1 << 14


def features(text: Column, size: int = SIZE) -> Column:
    """The places of a text's words and pairs of words, each once and in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "(?U)[^\\w$%'-]+"), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    # The words are bound once: what stands in a lambda is computed anew for every item.
    both = F.get(F.transform(F.array(words), lambda w: F.concat(w, pairs(w))), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(both, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))))


def prepared(labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(text, y): usable rows, each text once; y is the place of the label in ``LABELS``."""
    d = labelled.select(F.trim(F.col(text)).alias("text"), label_train(F.col(label).cast("string")).alias("label")).where((F.length("text") > LEAST) & F.col("label").isNotNull())
    y = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")).cast("int") - 1
    return d.groupBy("text").agg(F.min("label").alias("label")).select("text", y.alias("y"))


def held_out(rows: DataFrame, share: float = HELD) -> DataFrame:
    """``rows`` (text, y) and whether each is held out: of every class the smallest hashes, until ``share`` of the class is reached."""
    h = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(CUTS))
    counts = rows.groupBy("y", h.alias("h")).agg(F.count("*").alias("n"))  # at most CUTS rows a class
    w = Window.partitionBy("y").orderBy("h")
    c = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("y"))})
    cut = c.where(F.col("upto") <= F.round(F.col("all") * share)).groupBy("y").agg(F.max("h").alias("cut"))
    return rows.join(F.broadcast(cut), "y", "left").withColumn("held_out", F.coalesce(h <= F.col("cut"), F.lit(False))).drop("cut")


class Classifier(NamedTuple):
    weights: np.ndarray  # (SIZE + 1, 3), the last row is the bias
    history: list[float]  # held-out loss of each epoch


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature."""
    size = np.asarray(col.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(len(size)), size), np.asarray(col.flatten(), np.int64)


def probabilities(weights: np.ndarray, col: pa.Array) -> np.ndarray:
    row, at = _rows(col)
    z = np.tile(weights[-1], (len(col), 1))
    # A text's features share its weight, so long texts do not drown short ones.
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(col)), 1))
    for k in range(z.shape[1]):
        z[:, k] += np.bincount(row, weights[at, k], len(col)) * scale
    q = np.exp(z - z.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def loss_and_gradient(flat: np.ndarray, at: pa.Array, y: np.ndarray, weigh: np.ndarray, gradient: bool = True) -> tuple[float, float, np.ndarray | None]:
    """(sum of the rows' weights, sum of the weighted losses, its gradient)."""
    w = flat.reshape(-1, len(LABELS))
    q, own = probabilities(w, at), weigh[y]
    loss = -float((own * np.log(np.maximum(q[np.arange(len(y)), y], 1e-300))).sum())
    if not gradient:
        return float(own.sum()), loss, None
    d = q * own[:, None]
    d[np.arange(len(y)), y] -= own
    row, place = _rows(at)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    g = np.zeros_like(w)
    for k in range(w.shape[1]):
        g[:-1, k] = np.bincount(place, (d[:, k] * scale)[row], len(w) - 1)
    g[-1] = d.sum(axis=0)
    return float(own.sum()), loss, g.ravel()


def train(labelled: DataFrame, text: str = "text", label: str = "label", epochs: int = EPOCHS, batch: int = BATCH, steps: int = STEPS, rate: float = RATE, share: float = HELD, size: int = SIZE) -> Classifier:
    """A model of the labels of ``labelled``, stopped by its held-out rows."""
    d = held_out(prepared(labelled, text, label), share)
    d = store(d.select(features(F.col("text"), size).alias("at"), "y", "held_out", F.xxhash64("text").alias("key")), "labelled")
    counts = {r["y"]: r["n"] for r in d.where("NOT held_out").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        forget(d)
        raise ValueError("no labelled texts to train on")
    weigh = np.array([n / (len(counts) * counts[k]) if k in counts else 0.0 for k in range(len(LABELS))])
    each = max(batch, -(-n // steps))
    count = -(-n // each)
    data = d.withColumn("batch", F.when(F.col("held_out"), -1).otherwise(F.pmod("key", F.lit(count))).cast("int"))
    data = store(data.select("at", "y", "key", "batch").repartition("batch", F.pmod("key", F.lit(max(1, each // 4096)))).sortWithinPartitions("key"), "batches", ("batch",))
    parts = [data.where(F.col("batch") == k).select("at", "y") for k in range(-1, count)]
    tasks = [tasks_of(p) for p in parts]

    def loss(gradient: bool):
        return lambda w, b: loss_and_gradient(w, b.column(0), np.asarray(b.column(1), np.int64), weigh, gradient)

    w, history, best, kept, waited = np.zeros((size + 1) * len(LABELS)), [], np.inf, None, 0
    adam = Adam(len(w), rate, DECAY)
    for _ in range(epochs):
        for part, m in zip(parts[1:], tasks[1:]):
            own, _, g = summed(part, m, w, loss(True), at_once=4096)
            if own:
                w = adam.step(w, g / own)
        own, held, _ = summed(parts[0], tasks[0], w, loss(False), at_once=4096)
        history.append(held / own if own else 0.0)
        if not own or history[-1] < best:
            best, kept, waited = history[-1], w, 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    forget(d, data)
    return Classifier(kept.reshape(-1, len(LABELS)), history)


def save(spark: SparkSession, model: Classifier, path: str) -> None:
    """The places with any weight, one row each, and the bias and the losses in one more."""
    some = np.flatnonzero(model.weights[:-1].any(axis=1))
    rows = [(int(i), model.weights[i].tolist()) for i in some] + [(-1, model.weights[-1].tolist()), (-2, [float(len(model.weights) - 1), *model.history])]
    spark.createDataFrame(rows, "place int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Classifier:
    rows = {r["place"]: r["weights"] for r in spark.read.parquet(path).collect()}  # a model's places, at most its size
    size, *history = rows.pop(-2)
    w = np.zeros((int(size) + 1, len(LABELS)))
    for i, x in rows.items():
        w[i] = x
    return Classifier(w, history)


def scorer(spark: SparkSession, model: Classifier) -> Callable[[Column], dict[str, Column]]:
    """A scorer for ``score.score_posts``. The weights go to every task once."""
    sent, size = spark.sparkContext.broadcast(model.weights), len(model.weights) - 1

    @F.pandas_udf("array<double>")
    def chances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            q = probabilities(sent.value, pa.array(s.tolist(), pa.list_(pa.int32())))
            yield pd.Series(list(q))

    def of(text: Column) -> dict[str, Column]:
        p = chances(features(text, size))
        top = F.array_max(p)
        k = F.array_position(p, top).cast("int") - 1  # of equal chances the first label
        label = F.get(F.array(*[F.lit(x) for x in LABELS]), k)
        return {"sentiment_label": label, "sentiment_numeric": k - 1, "sentiment_confidence": top, "is_uncertain": top < UNCERTAIN}

    return of
