"""Stationarity and Granger causality per ticker, in grouped numpy; verdicts as a table and as a JSON registry.

The published tests: augmented Dickey-Fuller with a constant, lags by the information criterion on a common sample, and the
residual-sum F-test. The F distribution comes from the incomplete beta function's continued fraction.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Level of significance, lags tested, fewest rows for the unit root test.
ALPHA, LAGS, FEWEST = 0.05, 4, 8
#: Range of the statistic in which the response surface for a constant holds, and its coefficients.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL = (2.1659, 1.4412, 0.038269)
LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def tau_p(tau: float) -> float:
    """p-value of the unit root statistic with a constant."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = SMALL if tau <= TAU_STAR else LARGE
    return normal_cdf(sum(c * tau**i for i, c in enumerate(coef)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, residual sum of squares)."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum())


def _error(x: np.ndarray, rss: float, k: int = 0) -> float:
    """The standard error of the ``k``-th coefficient."""
    return math.sqrt(max(float(np.linalg.pinv(x.T @ x)[k, k]) * rss / max(x.shape[0] - x.shape[1], 1), 0.0))


def _df_design(x: np.ndarray, lags: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    y = d[top:]
    cols = [x[top:-1], *[d[top - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(y))]
    return y, np.column_stack(cols)


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags)."""
    n = len(x)
    top = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    best, lags = math.inf, 0
    for k in range(top + 1):
        y, z = _df_design(x, k, top)
        _, rss = _ols(y, z)
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]
        if aic < best - 1e-12:
            best, lags = aic, k
    y, z = _df_design(x, lags, lags)
    beta, rss = _ols(y, z)
    se = _error(z, rss)
    tau = float(beta[0] / se) if se > 0 else 0.0
    return tau, tau_p(tau), lags


def is_constant(x: np.ndarray) -> bool:
    return len(np.unique(x[~np.isnan(x)])) <= 1


def is_stationary(x: np.ndarray) -> bool:
    x = x[~np.isnan(x)]
    if len(x) < FEWEST:
        return False
    return True if is_constant(x) else adf(x)[1] < ALPHA


def make_stationary(x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, int]:
    """Differences until stationary; the gaps in front stay so that series can be aligned."""
    for k in range(rounds):
        if is_stationary(x):
            return x, k
        x = np.diff(x, prepend=np.nan)
    return x, rounds


def granger(y: np.ndarray, x: np.ndarray, lag: int) -> tuple[float, float]:
    """(F, p) of x's lags in a regression of y on both histories."""
    n = len(y) - lag
    own = [y[lag - k : len(y) - k] for k in range(1, lag + 1)]
    other = [x[lag - k : len(x) - k] for k in range(1, lag + 1)]
    one = np.ones(n)
    _, less = _ols(y[lag:], np.column_stack([*own, one]))
    _, more = _ols(y[lag:], np.column_stack([*own, *other, one]))
    dof = n - 2 * lag - 1
    f = ((less - more) / lag) / (more / dof) if more > 0 and dof > 0 else 0.0
    return f, f_tail(f, lag, dof)


def verdict(price: np.ndarray, sentiment: np.ndarray, lags: int = LAGS, alpha: float = ALPHA, jitter: bool = True) -> dict:
    """Lag results, the smallest p, and whether sentiment is worth including. Decisions use rounded p-values."""
    p, _ = make_stationary(price)
    s, _ = make_stationary(sentiment)
    ok = ~(np.isnan(p) | np.isnan(s))
    p, s = p[ok], s[ok]
    out = {"sentiment_is_valid": False, "min_p_value": None, "best_lag": None, "recommendation": "EXCLUDE", "lag_results": {}}
    if len(p) < 5 * lags:
        return out
    for name, v in (("p", p), ("s", s)):
        if is_constant(v):
            if not jitter:
                return out
            v = v + np.linspace(0, 1e-8, len(v))
            p, s = (v, s) if name == "p" else (p, v)
    for lag in range(1, lags + 1):
        f, q = granger(p, s, lag)
        out["lag_results"][lag] = {"f_stat": round(f, 4), "p_value": round(q, 4), "significant": round(q, 4) < alpha}
    best = min(out["lag_results"], key=lambda k: (out["lag_results"][k]["p_value"], k))
    low = out["lag_results"][best]["p_value"]
    out |= {"min_p_value": low, "best_lag": best, "sentiment_is_valid": low < alpha, "recommendation": "INCLUDE" if low < alpha else "EXCLUDE"}
    return out


SUMMARY = "ticker string, n long, sentiment_is_valid boolean, min_p_value double, best_lag int, p_lag1 double, p_lag2 double, p_lag3 double, p_lag4 double, recommendation string, lag_results string"


def run_granger(series: DataFrame, ts="ts", price="price", sentiment="sentiment", **options) -> DataFrame:
    """One row per ticker; a ticker whose test fails is excluded, the others are not affected."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts").dropna(subset=["price", "sentiment"])
        try:
            v = verdict(g["price"].to_numpy(float), g["sentiment"].to_numpy(float), **options)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            v = {"sentiment_is_valid": False, "min_p_value": None, "best_lag": None, "recommendation": "EXCLUDE", "lag_results": {}}
        p = {f"p_lag{k}": [v["lag_results"].get(k, {}).get("p_value")] for k in range(1, 5)}
        return pd.DataFrame({"ticker": [g.name if not len(g) else g["ticker"].iloc[0]], "n": [len(g)], **{k: [v[k]] for k in ("sentiment_is_valid", "min_p_value", "best_lag", "recommendation")}, **p, "lag_results": [json.dumps(v["lag_results"])]})[[c.split()[0] for c in SUMMARY.split(", ")]]

    s = series.select("ticker", F.col(ts).alias("ts"), F.col(price).cast("double").alias("price"), F.col(sentiment).cast("double").alias("sentiment"))
    return s.groupBy("ticker").applyInPandas(one, SUMMARY)


def stationarity(series: DataFrame, value: str, ts="ts") -> DataFrame:
    """(ticker, n, stationary, rounds): whether a series is stationary, and after how many differences."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("ts")["v"].to_numpy(float)
        y, k = make_stationary(x)
        return pd.DataFrame({"ticker": [g["ticker"].iloc[0]], "n": [len(x)], "stationary": [is_stationary(x)], "rounds": [k], "ends_stationary": [is_stationary(y)]})

    s = series.select("ticker", F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))
    return s.groupBy("ticker").applyInPandas(one, "ticker string, n long, stationary boolean, rounds int, ends_stationary boolean")


def align(price: DataFrame, sentiment: DataFrame, least_hourly: int = 24, least_daily: int = 10, fill: str = "ffill", backfill: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, grain, ts, price, sentiment): hourly where enough hours meet, else daily, else daily with prices of ``backfill``
    (ticker, ts, price) from thirty days before the first sentiment to two days after the last, else nothing. ``fill`` is ffill
    (what is left in front becomes 0), zero, or strict for the hours that both have. Tickers that one side lacks are in none.
    A time's price is its last, by ``ts`` and then ``order`` (columns of ``price``). Only hours and days are joined, never rows."""
    from pyspark.sql.window import Window

    from ..functions.scalars import fill_forward

    def at(unit: str, last, price: DataFrame = price) -> DataFrame:
        p = price.groupBy("ticker", F.date_trunc(unit, "ts").alias("ts")).agg(last.alias("price"))
        s = sentiment.groupBy("ticker", F.date_trunc(unit, "ts").alias("ts")).agg(F.avg("sentiment").alias("sentiment"))
        j = p.join(s.select("ticker").distinct(), "ticker", "left_semi").join(s, ["ticker", "ts"], "left")
        w = Window.partitionBy("ticker").orderBy("ts")
        filled = fill_forward(F.col("sentiment"), w) if fill == "ffill" else F.col("sentiment")
        j = j.withColumn("sentiment", F.coalesce(filled, F.lit(0.0)) if fill in ("ffill", "zero") else F.col("sentiment"))
        return j.where("price IS NOT NULL AND sentiment IS NOT NULL").select("ticker", F.lit(unit).alias("grain"), "ts", "price", "sentiment")

    last = lambda *by: F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("ts", *by)))
    hourly, daily = at("hour", last(*order)), at("day", last(*order))
    enough = lambda d, n: d.groupBy("ticker").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("ticker")
    h = enough(hourly, least_hourly)
    d = enough(daily, least_daily).join(h, "ticker", "left_anti")
    out = hourly.join(h, "ticker", "left_semi").union(daily.join(d, "ticker", "left_semi"))
    if backfill is None:
        return out
    span = sentiment.groupBy("ticker").agg(
        F.date_sub(F.min("ts").cast("date"), 30).alias("_a"), F.date_add((F.max("ts") + F.expr("INTERVAL 2 DAYS")).cast("date"), 0).alias("_z")
    )
    span = span.join(price.select("ticker").distinct(), "ticker", "left_semi").join(h.union(d), "ticker", "left_anti")
    old = backfill.join(span, "ticker").where((F.to_date("ts") >= F.col("_a")) & (F.to_date("ts") < F.col("_z"))).drop("_a", "_z")
    more = at("day", last(), old).withColumn("grain", F.lit("backfill"))
    return out.union(more.join(enough(more, least_daily), "ticker", "left_semi"))


def upsert_registry(old: DataFrame | None, new: DataFrame, key: str = "ticker") -> DataFrame:
    """New rows replace old ones of their key."""
    return new if old is None else old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def valid_for(tickers: DataFrame, registry: DataFrame) -> DataFrame:
    """Unknown tickers are not valid."""
    r = registry.select("ticker", F.col("sentiment_is_valid").alias("_v"))
    return tickers.join(r, "ticker", "left").withColumn("sentiment_is_valid", F.coalesce("_v", F.lit(False))).drop("_v")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry written as one JSON object, ticker to verdict."""
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<sentiment_is_valid:boolean,min_p_value:double,best_lag:int,recommendation:string>>"
    return raw.select(F.explode(F.from_json("value", kind)).alias("ticker", "v")).select("ticker", "v.*")
