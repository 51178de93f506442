"""Embedding whitening by hierarchical merging of singular value decompositions.

Each task cuts its rows into blocks and keeps of a block its number of rows, its mean, and all singular values and right singular
vectors of the centred rows. Two such summaries merge without loss: the scaled singular vectors of both stand above each other,
one row more corrects for the distance of the means, and the stack (twice the dimensions and one row) is decomposed anew. Nothing is
cut off, so the last summary has the singular values of the whole centred table. Tasks merge their blocks, and summaries of tasks
merge ``FAN`` at a time, level by level, so that no task ever holds more than ``FAN`` of them. Only the last one, a square of
the dimensions, comes to the driver. The covariance is never formed, so nothing is lost by squaring.

With a ``Grid`` every entry first becomes an integer; sums and squared deviations are then exact whatever their size. What comes
out is audited: the whitened vectors are summarised the same way, and ``identity_error`` is read from that summary.

Defined cases: vectors that are null, empty, or hold null or non-finite entries have no rows in the result; vectors of several
lengths have no common space, the commonest length is taken (the longest of equally common ones) and the others are left out like
null; repeated rows count each; entries beyond ``MOST`` grid steps are taken as ``MOST``; a component without variance (equal
rows, fewer rows than components) has null ``whitened`` and takes no part in the audit, and where no component has any,
``explained`` and ``identity_error`` are 0; a squared deviation beyond a long is null; an empty table gives an empty result;
null ids stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .base import forget, store, table

#: Rows decomposed at once, summaries merged by a task, components returned, grid steps of an entry at most.
BLOCK, FAN, COMPONENTS, MOST = 4096, 16, 8, 1 << 50
#: A singular value below this share of the largest is rounding.
NOTHING = 1e-10
SUMMARY = "dim int, part long, n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"


class Grid(NamedTuple):
    """Entries become floor(``steps`` * entry) + ``shift``."""

    steps: int = 1024
    shift: int = 100_000


class Summary(NamedTuple):
    """Of some rows: their number, exact sums on a grid (else none), mean, singular values and right singular vectors."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def _decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, "r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def summary_of(x: np.ndarray, exact: bool) -> Summary:
    """Of a block of rows: integers if ``exact``."""
    sums = tuple(int(v) for v in x.sum(axis=0)) if exact else ()
    mean = np.array([v / len(x) for v in sums]) if exact else x.mean(axis=0)
    return Summary(len(x), sums, mean, *_decompose(x - mean))


def merge(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    sums = tuple(x + y for x, y in zip(a.sums, b.sums))
    mean = np.array([v / n for v in sums]) if sums else a.mean + (b.mean - a.mean) * (b.n / n)
    apart = (a.mean - b.mean) * np.sqrt(a.n * (b.n / n))
    return Summary(n, sums, mean, *_decompose(np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, apart])))


def rows_of(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length among the vectors of a column that are whole and finite."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().fill_null(0), np.int64)
    end = np.cumsum(size)
    flat = col.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan), np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    ok = (size > 0) & (bad[end] == bad[end - size])
    for d in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == d))
        yield at, values[(end - size)[at][:, None] + np.arange(d)]


def on_grid(c: np.ndarray, grid: Grid | None) -> np.ndarray:
    if grid is None:
        return c
    with np.errstate(over="ignore"):
        return np.clip(np.floor(grid.steps * c), -MOST, MOST).astype(np.int64) + grid.shift


def _row(d: int, part: int, s: Summary) -> dict:
    return {"dim": d, "part": part, "n": s.n, "sums": [str(v) for v in s.sums], "mean": s.mean.tolist(), "values": s.values.tolist(), "vectors": s.vectors.ravel().tolist()}


def _read(r: dict) -> Summary:
    v = np.array(r["values"])
    return Summary(r["n"], tuple(int(x) for x in r["sums"]), np.array(r["mean"]), v, np.array(r["vectors"]).reshape(len(v), r["dim"]))


_SCHEMA = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
Blocks = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def _blocks(grid: Grid | None) -> Blocks:
    return lambda batches: (on_grid(c, grid) for b in batches for _, c in rows_of(b.column(0)))


def _summarise(batches: Iterator[pa.RecordBatch], blocks: Blocks, exact: bool, block: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, Summary] = {}
    for x in blocks(batches):
        for i in range(0, len(x), block):
            s = summary_of(x[i : i + block], exact)
            held[x.shape[1]] = merge(held[x.shape[1]], s) if x.shape[1] in held else s
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_pylist([_row(d, part, s) for d, s in held.items()], _SCHEMA)


def _merged(t: pa.Table, fan: int) -> pa.Table:
    """Summaries of up to ``fan`` tasks, in the order of the tasks, so a repeated task gives the same."""
    rows = sorted(t.to_pylist(), key=lambda r: r["part"])
    out = _read(rows[0])
    for r in rows[1:]:
        out = merge(out, _read(r))
    return pa.Table.from_pylist([_row(rows[0]["dim"], rows[0]["part"] // fan, out)], _SCHEMA)


def summarise(vectors: DataFrame, blocks: Blocks, exact: bool, block: int = BLOCK, fan: int = FAN) -> Summary | None:
    """The summary of all rows of the commonest length; None where there are none. ``vectors`` has one column."""
    level = store(vectors.mapInArrow(lambda it: _summarise(it, blocks, exact, block), SUMMARY), "summaries")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        above = store(level.groupBy("dim", F.floor(F.col("part") / fan).alias("at")).applyInArrow(lambda t: _merged(t, fan), SUMMARY), "summaries")
        forget(level)
        level = above
    longest = level.groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    row = None if longest is None else level.where(F.col("dim") == longest["dim"]).first()  # one summary for each length
    forget(level)
    return None if row is None else _read(row.asDict())


class Whitening(NamedTuple):
    """A fitted transform: the summary, unit components with their eigenvalues, and the sum of all eigenvalues."""

    fit: Summary
    grid: Grid | None
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.fit.mean) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - sums)^2; None beyond a long."""
        n, top = self.fit.n, 1 << 62
        if n * int(np.abs(x).max(initial=0)) < top and max(map(abs, self.fit.sums)) < top:
            d = n * x - np.array(self.fit.sums, np.int64)
            if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < top:
                return (d * d).sum(axis=1).tolist()
        else:
            d = n * x.astype(object) - np.array(self.fit.sums, object)
        out = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]


def fit(vectors: DataFrame, col: str = "embedding", grid: Grid | None = None, components: int = COMPONENTS, **how: int) -> Whitening | None:
    """The whitening of all usable vectors; None where there are none. ``how``: ``block`` and ``fan``."""
    s = summarise(vectors.selectExpr(f"`{col}` AS v"), _blocks(grid), grid is not None, **how)
    if s is None:
        return None
    k = min(components, len(s.mean))
    d, r = len(s.mean), len(s.values)
    v = np.vstack([s.vectors, np.zeros((max(0, k - r), d))])[:k]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    sv = np.append(s.values, np.zeros(max(0, k - r)))[:k]
    sv = np.where(sv > NOTHING * s.values.max(initial=0), sv, 0.0)
    return Whitening(s, grid, v, sv**2 / s.n, float((s.values**2).sum() / s.n))


def identity_error(vectors: DataFrame, w: Whitening, col: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over components with variance."""
    has, d = w.values > 0, len(w.fit.mean)
    if not has.any():
        return 0.0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for _, c in rows_of(b.column(0)):
                if c.shape[1] == d:
                    yield w.whitened(on_grid(c, w.grid))[:, has]

    s = summarise(vectors.selectExpr(f"`{col}` AS v"), blocks, False)
    cov = (s.vectors.T * (s.values**2 / s.n)) @ s.vectors
    return float(np.abs(cov - np.eye(len(cov))).max())


def transform(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, deviation, component, whitened): for every usable vector a row for each component. The deviation needs a grid."""
    kind = dict(vectors.dtypes)[id_col]
    names = ["id", "deviation", "component", "whitened"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            for at, c in rows_of(b.column(1)):
                if c.shape[1] != len(w.fit.mean):
                    continue
                x = on_grid(c, w.grid)
                far = pa.array(w.deviation(x) if w.grid else [None] * len(at), pa.int64())
                y = w.whitened(x).ravel()
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at[each])), far.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(y, mask=~np.isfinite(y))], names
                )

    d = vectors.selectExpr(f"`{id_col}` AS id", f"`{col}` AS v")
    return d.mapInArrow(put, f"id {kind}, deviation long, component int, whitened double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    w = fit(vectors, grid=Grid())
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = [float(e / w.trace) if w.trace else 0.0 for e in w.values]
    explained = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("component"))
    error = identity_error(vectors, w)
    out = transform(vectors, w).withColumnRenamed("id", "vec_id")
    return out.select("vec_id", "component", F.lit(w.fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
