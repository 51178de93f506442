"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text, hashed into ``DIMS`` weights: its words (A-Z lower-cased), pairs of neighbouring words, and runs of one, two and
three word shapes (letters, capitals, digits and signs, repeats squeezed), and one for all pairs of equal words, each with its share of the
text. A score is the
logistic function of a sparse dot product.

Training reads at most ``ROWS`` labelled documents, those with the smallest hash of their id, whole; their features are made in
parallel, sorted by pass and hash outside Python, and one task runs the updates over them as they stream by, holding the weights and
one batch. The weights (fixed size) go to every task.

Defined cases: null and empty texts have no features and get the score of the intercept; null or missing labels are not learned
from; several labels of one document count as their mean; an id given with several texts is learned from once, by the smallest
text; without any label every score is 0.5; repeated rows are scored each; null ids are scored and are held out as the empty id
would be; a very long text is a row of its own; an empty table gives an empty result; extra columns, whatever their names, are
kept by ``score`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, store, table
from .kernel import LOWER, U, mix, slices, span_hash, strings, trim, words

#: Labelled documents learned from at most; weights; passes.
ROWS, DIMS, EPOCHS = 8000, 1 << 18, 3
#: Step size, its smoothing, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-2
#: Score from which a document is kept.
KEEP = 0.3
#: Feature values are shares times this.
SCALE = 10.0

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = ord("A")
SHAPE[97:123] = ord("a")
SHAPE[48:58] = ord("0")
SHAPE[128:] = ord("a")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight index, text) of every n-gram, and the words of each text."""
    s, e, first = words(data, offsets)
    n = len(s)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if not n:
        return np.zeros(0, np.int64), doc, count
    h = span_hash(LOWER[data], s, e)
    shape = SHAPE[data]
    keep = np.append(True, shape[1:] != shape[:-1])
    keep[s] = True
    at = np.append(0, np.cumsum(keep))
    g = span_hash(shape[keep], at[s], at[e])
    same2 = doc[1:] == doc[:-1]
    same3 = doc[2:] == doc[:-2]
    twice = same2 & (h[1:] == h[:-1])
    with np.errstate(over="ignore"):
        g2 = g[:-1] * U(3) + g[1:]
        parts = [
            (h + U(1), doc),
            ((h[:-1] * U(3) + h[1:] + U(2))[same2], doc[1:][same2]),
            (g + U(3), doc),
            ((g2 + U(4))[same2], doc[1:][same2]),
            ((g2[:-1] * U(5) + g[2:] + U(5))[same3], doc[2:][same3]),
            (np.full(int(twice.sum()), 6, U), doc[1:][twice]),
        ]
        idx = np.concatenate([mix(x) for x, _ in parts]) % U(DIMS)
    return idx.astype(np.int64), np.concatenate([d for _, d in parts]), count


_SPARSE = "at long, y double, idx binary, val binary"


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = strings(b.column(2))
        idx, val = [], []
        for i, j in slices(off):
            k, doc, count = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            order = np.argsort(doc, kind="stable")
            k, cut = k[order], np.searchsorted(doc[order], np.arange(j - i + 1))
            for r in range(j - i):
                u, c = np.unique(k[cut[r] : cut[r + 1]], return_counts=True)
                idx.append(u.astype(np.int32).tobytes())
                val.append((c * (SCALE / max(count[r], 1))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["at", "y", "idx", "val"])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the intercept."""

    def __init__(self, dims: int = DIMS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n, self.set = np.zeros(dims + 1), np.zeros(dims + 1), (alpha, beta, l1, l2)

    def weights(self, i) -> np.ndarray:
        alpha, beta, l1, l2 = self.set
        z = self.z[i]
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(self.n[i])) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        more = n + g * g
        self.z[i] += g - (np.sqrt(more) - np.sqrt(n)) / self.set[0] * w
        self.n[i] = more


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f, any_ = Ftrl(), False
    for b in batches:
        for y, i, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            i, v = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((i, np.int32), (v, np.float32)))
            f.learn(np.append(i, DIMS), np.append(v, 1.0), y)
            any_ = True
    if any_:
        yield pa.RecordBatch.from_arrays([pa.array([f.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], ["w"])
    trim()


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> np.ndarray:
    """The weights, learned from at most ``rows`` labelled documents that are not held out."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).withColumn("at", F.xxhash64("doc_id"))
    y = y.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of other documents use up no place
    y = store(y.orderBy("at", "doc_id").limit(rows), "sample")
    d = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    d = d.groupBy("doc_id", "at", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("at", "y", "text")
    sparse = store(d.mapInArrow(_sparse, _SPARSE), "sparse")
    passes = sparse.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(1).sortWithinPartitions("epoch", "at", "y", "idx")
    got = passes.select("y", "idx", "val").mapInArrow(_train, "w binary").collect()  # one row of fixed size
    forget(y, sparse)
    return np.frombuffer(bytes(got[0]["w"]), np.float32) if got else np.zeros(DIMS + 1, np.float32)


def _score(batches: Iterator[pa.RecordBatch], weights, col: int) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for b in batches:
        data, off = strings(b.column(col))
        z = np.full(len(off) - 1, float(w[DIMS]))
        for i, j in slices(off):
            k, doc, count = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            z[i:j] += np.bincount(doc, weights=w[k], minlength=j - i) * (SCALE / np.maximum(count, 1))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], [*b.schema.names, "score"])
    trim()


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(lambda it: _score(it, sent, at), f"{kinds}, score double").toDF(*docs.columns, out)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
