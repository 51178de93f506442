"""Granger tests from lagged cross moments: no task ever holds a series.

Rows get global numbers (``storage.numbered``) in the order of ticker and time, and are cut into segments of ``SEGMENT`` numbers; the last
``lags`` rows of a segment are sent to the next one as well, so every row finds its own lags inside a segment. Sums of products of
(y, its lags, x's lags, 1) are aggregates with map-side combine; one small matrix for each ticker and lag order is left, from which
both regressions are solved. Series are taken relative to their ticker's mean first, as sums of products of raw prices lose
digits.

Defined cases: rows without a price or a sentiment are left out before lags are taken; rows of one ticker and time are in the order of
their values; a lag order with fewer rows than the larger regression has coefficients, or whose larger regression leaves nothing, has
F 0 and p 1; a ticker without such rows has no row in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import numbered
from .causality import LAGS, f_tail

#: Rows of a segment.
SEGMENT = 1 << 16
RESULT = "ticker string, lag int, n long, f_stat double, p_value double"


def lagged(series: DataFrame, lags: int = LAGS, segment: int = SEGMENT) -> DataFrame:
    """(ticker, at, y0.., x1..): every row of (ticker, ts, price, sentiment) with its ticker's rows up to ``lags`` before it; ``at`` counts
    from 0 inside the ticker. Values are relative to the ticker's mean."""
    s = series.select("ticker", "ts", F.col("price").cast("double").alias("y"), F.col("sentiment").cast("double").alias("x")).where("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(y) AND NOT isnan(x)")
    n, _ = numbered(s, "ticker", "ts", "y", "x")
    of = n.groupBy("ticker").agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"), F.min("row").alias("_first"))
    n = n.join(of, "ticker").select("ticker", (F.col("y") - F.col("_y")).alias("y"), (F.col("x") - F.col("_x")).alias("x"), "row", (F.col("row") - F.col("_first")).alias("at"))
    own = F.floor(F.col("row") / segment)
    here = F.struct(own.alias("seg"), F.lit(True).alias("own"))
    e = n.withColumn("to", F.explode(F.when(F.col("row") % segment >= segment - lags, F.array(here, F.struct((own + 1).alias("seg"), F.lit(False).alias("own")))).otherwise(F.array(here))))
    w = Window.partitionBy("ticker", "to.seg").orderBy("row")
    e = e.withColumns({f"{c}{k}": F.lag(c, k).over(w) for c in ("y", "x") for k in range(1, lags + 1)})
    return e.where("to.own").withColumnRenamed("y", "y0").drop("x", "row", "to")


def moments(rows: DataFrame, lag: int) -> DataFrame:
    """(ticker, n, m): of the rows that have ``lag`` rows before them the sums of products of y0, y1.., x1.., 1: the upper triangle."""
    names = [f"y{k}" for k in range(lag + 1)] + [f"x{k}" for k in range(1, lag + 1)]
    cols = [*[F.col(c) for c in names], F.lit(1.0)]
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    return rows.where(F.col("at") >= lag).groupBy("ticker").agg(F.count("*").alias("n"), F.array(*sums).alias("m"))


def _rss(m: np.ndarray, use: list[int]) -> float:
    """What a regression of the first variable on those of ``use`` leaves."""
    a, b = m[np.ix_(use, use)], m[use, 0]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale
    return float(max(m[0, 0] - 2 * beta @ b + beta @ a @ beta, 0.0))


def f_of(m: list[float], n: int, lag: int) -> tuple[float, float]:
    """(F, p) of x's lags from the triangle of moments."""
    k = 2 * lag + 2
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = m
    full = full + np.triu(full, 1).T
    less, more = _rss(full, [*range(1, lag + 1), k - 1]), _rss(full, [*range(1, 2 * lag + 1), k - 1])
    dof = n - 2 * lag - 1
    if dof <= 0 or more <= 0:
        return 0.0, 1.0
    f = ((less - more) / lag) / (more / dof)
    return f, f_tail(f, lag, dof)


def granger(series: DataFrame, lags: int = LAGS, segment: int = SEGMENT) -> DataFrame:
    """(ticker, lag, n, f_stat, p_value) of every lag order up to ``lags``."""
    rows = lagged(series, lags, segment)
    parts = [moments(rows, k).select("ticker", F.lit(k).alias("lag"), "n", "m") for k in range(1, lags + 1)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)

    def solve(batches):
        for b in batches:
            got = [f_of(m, n, k) for m, n, k in zip(b["m"], b["n"], b["lag"])]
            yield pd.DataFrame({"ticker": b["ticker"], "lag": b["lag"], "n": b["n"], "f_stat": [f for f, _ in got], "p_value": [p for _, p in got]})

    return all_.mapInPandas(solve, RESULT)
