"""Bars, technical indicators, volatility, indices, earnings, target and split.

All indicators of a ticker share one (ticker, time) ordering, so the rows are shuffled and sorted once. Exponential means are
recursions: one grouped function computes all of them for a ticker. Bars of one ticker are as many as its hours, which bounds a
group: thirty years of hourly bars are 263,000 rows, some 20 MB.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import change, clip, fill_both, ordered, ratio, rolling

#: Columns that get 0 where undefined, and columns filled from their neighbours.
ZERO_FILLED = ("volume_change", "volume_ma_ratio", "bb_width", "bb_position")
NEIGHBOUR_FILLED = ("rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "atr_14", "volatility_24h")


def resample(ticks: DataFrame, ts="ts", price: dict[str, str] | None = None, order: Iterable[str] = (), unit: str = "hour") -> DataFrame:
    """OHLCV bars: first, max, min, last, sum. ``price`` maps Open, High, Low, Close, Volume to columns."""
    p = price or {c: c for c in ("Open", "High", "Low", "Close", "Volume")}
    at = F.struct(ts, *order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    bars = ticks.groupBy("ticker", F.date_trunc(unit, ts).alias("ts")).agg(
        first(p["Open"]).alias("Open"), F.max(p["High"]).alias("High"), F.min(p["Low"]).alias("Low"), last(p["Close"]).alias("Close"), F.sum(p["Volume"]).alias("Volume")
    )
    return bars.where(F.col("Close").isNotNull())


def returns(c: Column, w) -> dict[str, Column]:
    return {"return_1h": change(c, w, 1), "return_3h": change(c, w, 3), "return_24h": change(c, w, 24)}


def bollinger(c: Column, w, n: int = 20, sd=F.stddev_samp) -> dict[str, Column]:
    mid, s = rolling(c, w, n, F.avg), rolling(c, w, n, sd)
    up, low = mid + 2 * s, mid - 2 * s
    return {"bb_mid": mid, "bb_upper": up, "bb_lower": low, "bb_width": ratio(up - low, mid), "bb_position": (c - low) / (up - low + 1e-9)}


def true_range(h: Column, l: Column, c: Column, w) -> Column:  # noqa: E741
    before = F.lag(c).over(w)
    return F.greatest(h - l, F.abs(h - before), F.abs(l - before))


def obv(c: Column, v: Column, w) -> Column:
    step = F.coalesce(F.signum(c - F.lag(c).over(w)) * v, F.lit(0.0))
    return step


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """The recursive exponential mean, seeded by the first value that is there; gaps keep the last mean."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def exponential(bars: DataFrame, keys: str = "ticker", ts: str = "ts", close: str = "Close", tr: str | None = None) -> DataFrame:
    """rsi_14, macd, macd_signal, macd_hist, and with ``tr`` its exponential mean, for every row."""
    add = ["rsi_14", "macd", "macd_signal", "macd_hist", *(["atr_ewm"] if tr else [])]
    schema = T.StructType([*bars.schema.fields, *[T.StructField(c, T.DoubleType()) for c in add]])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ts)
        c = g[close].to_numpy(float)
        d = np.diff(c, prepend=np.nan)
        up, down = np.where(np.isnan(d), np.nan, np.clip(d, 0, None)), np.where(np.isnan(d), np.nan, np.clip(-d, 0, None))
        gain, loss = ewm(up, 1 / 14), ewm(down, 1 / 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            rs = np.where(loss == 0, np.nan, gain / loss)
            rsi = 100 - 100 / (1 + rs)
        macd = ewm(c, 2 / 13) - ewm(c, 2 / 27)
        signal = ewm(macd, 2 / 10)
        new = {"rsi_14": rsi, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal}
        if tr:
            new["atr_ewm"] = ewm(g[tr].to_numpy(float), 1 / 14)
        return g.assign(**{k: [None if np.isnan(x) else x for x in v] for k, v in new.items()})

    return bars.groupBy(keys).applyInPandas(one, schema)


def ewm_native(c: Column, order: Column, alpha: float) -> Column:
    """The same mean as an aggregate of a short series without gaps, without Python: the last value only."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), c.alias("v"))))
    return F.aggregate(rows, F.lit(None).cast("double"), lambda y, r: F.when(y.isNull(), r["v"]).otherwise(y * (1 - alpha) + r["v"] * alpha))


def winsorise(df: DataFrame, cols: Iterable[str], keys: str = "ticker", n: float = 5.0) -> DataFrame:
    """Clip to mean +- n deviations of the whole partition. Means and deviations are one window over the key by which the rows
    are dealt already, so nothing is shuffled or computed a second time."""
    cols = list(cols)
    w = Window.partitionBy(keys)
    j = df.withColumns({f"_{k}_{c}": f(c).over(w) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    out = {}
    for c in cols:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        out[c] = F.when(F.coalesce(s > 0, F.lit(False)), clip(F.col(c).cast("double"), m - n * s, m + n * s)).otherwise(F.col(c))
    return j.withColumns(out).select(*df.columns)


def technicals(bars: DataFrame, fill: bool = True, clip_at: float | None = 5.0) -> DataFrame:
    """Every hourly indicator; ``fill`` and ``clip_at`` reproduce the clean-up that follows."""
    b = exponential(bars)
    w = ordered("ticker", "ts")
    c, h, l, v = (F.col(x) for x in ("Close", "High", "Low", "Volume"))  # noqa: E741
    b = b.withColumns({**returns(c, w), **{k: x for k, x in bollinger(c, w).items() if k != "bb_mid"}, "_tr": true_range(h, l, c, w), "volume_change": change(v, w), "_step": obv(c, v, w)})
    b = b.withColumns({
        "atr_14": rolling(F.col("_tr"), w, 14, F.avg), "volume_ma_ratio": ratio(v, rolling(v, w, 24, F.avg)),
        "obv": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "volatility_24h": rolling(F.col("return_1h"), w, 24, F.stddev_samp),
    }).drop("_tr", "_step")
    if fill:
        b = b.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ZERO_FILLED} | {x: fill_both(F.col(x), w) for x in NEIGHBOUR_FILLED})
    if clip_at is not None:
        doubles = [f.name for f in b.schema if isinstance(f.dataType, T.DoubleType)]
        b = winsorise(b, doubles, n=clip_at)
    return b


def technicals_daily(bars: DataFrame) -> DataFrame:
    """The daily variant: ATR by exponential mean, population deviation in the bands, means of 20 and 50, z-scores."""
    w = ordered("ticker", "ts")
    c, h, l, v = (F.col(x) for x in ("Close", "High", "Low", "Volume"))  # noqa: E741
    b = exponential(bars.withColumn("_tr", true_range(h, l, c, w)), tr="_tr").withColumnRenamed("atr_ewm", "atr_14").drop("_tr")
    z = lambda x: ratio(x - rolling(x, w, 20, F.avg), rolling(x, w, 20, F.stddev_samp))
    return b.withColumns({
        "ma20": rolling(c, w, 20, F.avg), "ma50": rolling(c, w, 50, F.avg), "bb_width": bollinger(c, w, sd=F.stddev_pop)["bb_width"],
        "volume_zscore": z(v.cast("double")), "price_zscore": z(c), "log_return": F.log(ratio(c, F.lag(c).over(w))), "intraday_range": ratio(h - l, c),
    })


# Volatility, indices, earnings -------------------------------------------------------------------------------------


def vix_wide(vix: DataFrame, names: list[str], ts="timestamp_utc") -> DataFrame:
    """One column per index, the last row of a time by ``seq`` where it is there."""
    seq = "seq" if "seq" in vix.columns else "vix_close"
    wide = vix.where(F.col("index").isNotNull()).groupBy(ts).pivot("index", names).agg(F.max_by("vix_close", seq))
    return wide.toDF(ts, *[f"vix_{n.lower().replace(' ', '_')}" for n in names])


def join_time(bars: DataFrame, dim: DataFrame, ts: str = "ts", dim_ts: str = "timestamp_utc", how: str = "exact") -> DataFrame:
    """A left join on time: ``exact`` equality, ``hour`` of the other side, or ``asof`` the last value before."""
    dim = dim.withColumnRenamed(dim_ts, "_at")
    cols = [c for c in dim.columns if c != "_at"]
    if how == "asof":
        return _asof(bars, dim, ts, cols)
    if how == "hour":
        dim = dim.groupBy(F.date_trunc("hour", "_at").alias("_at")).agg(*[F.max_by(c, F.struct("_at", c)).alias(c) for c in cols])
    return bars.join(dim, bars[ts] == dim["_at"], "left").drop("_at")


def _asof(bars: DataFrame, dim: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """As-of by union and a last-value window inside each hour. An hour opens with the last value before it: of an earlier hour of
    its day, else of an earlier day, found over one row for each hour and each day."""
    hour = lambda c: F.date_trunc("hour", c)
    hours = bars.select(hour(ts).alias("_h")).distinct()
    ends = dim.groupBy(hour("_at").alias("_h")).agg(*[F.max_by(c, "_at").alias(c) for c in cols])
    h = ends.join(hours, "_h", "full").withColumn("_d", F.to_date("_h"))
    days = h.groupBy("_d").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_h"))).alias(f"_d_{c}") for c in cols])
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # one row a day, whatever the tables' size
    days = days.select("_d", *[F.last(f"_d_{c}", ignorenulls=True).over(w).alias(f"_d_{c}") for c in cols])
    w = Window.partitionBy("_d").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    opens = h.join(days, "_d").select("_h", *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_d_{c}")).alias(f"_o_{c}") for c in cols])
    right = dim.select(hour("_at").alias("_h"), F.col("_at").alias("_t"), F.lit(0).alias("_side"), *cols, F.lit(None).cast(bars.schema.simpleString()).alias("_row"))
    left = bars.select(hour(ts).alias("_h"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in cols], F.struct(*bars.columns).alias("_row"))
    w = Window.partitionBy("_h").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = right.union(left).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).where("_side = 1")
    u = u.join(opens, "_h", "left")
    return u.select("_row.*", *[F.coalesce(c, f"_o_{c}").alias(c) for c in cols])


def index_returns(quotes: DataFrame, names: list[str], ts="ts") -> DataFrame:
    """Hourly last close of each index on a grid without gaps, and its change from the hour before."""
    last = quotes.groupBy(F.date_trunc("hour", ts).alias("ts"), "name").agg(F.max_by("close", F.struct(ts, "seq")).alias("close"))
    ends = last.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    wide = last.groupBy("ts").pivot("name", names).agg(F.first("close"))
    g = grid.join(wide, "ts", "left")
    # Months are partitions, and each hour also brings the hour before it, so no window spans the whole series.
    before = g.select((F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), *[F.col(n).alias(f"_b_{n}") for n in names])
    j = g.join(before, "ts", "left")
    return j.select("ts", *[(ratio(F.col(n), F.col(f"_b_{n}")) - 1).alias(f"idx_{n.lower()}") for n in names])


def regime(vix: Column) -> Column:
    return F.when(vix < 15, 0).when(vix <= 25, 1).when(vix > 25, 2)


def earnings_flags(bars: DataFrame, earnings: DataFrame, ts: str = "ts") -> DataFrame:
    """Whether the bar's day, or the day after, is an earnings day of its ticker."""
    e = earnings.select(F.col("ticker").alias("_t"), F.col("earnings_date").cast("date").alias("_d")).where("_d IS NOT NULL").distinct()
    out = bars
    for name, day in (("earnings_today", F.to_date(ts)), ("earnings_tomorrow", F.date_add(F.to_date(ts), 1))):
        hit = e.withColumn("_hit", F.lit(1))
        out = out.withColumn("_day", day).join(hit, (F.col("ticker") == F.col("_t")) & (F.col("_day") == F.col("_d")), "left")
        out = out.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit", "_t", "_d", "_day")
    return out


def near_dates(df: DataFrame, dates: DataFrame, ts: str, name: str, days: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """1 within ``days`` of a date, both ends included. Each date becomes its days, so the range join is an equi-join."""
    around = F.sequence(F.date_sub("date", days), F.date_add("date", days))
    d = dates.select(*keys, F.explode(around).alias("_d")).distinct().withColumn("_hit", F.lit(1))
    j = df.withColumn("_d", F.to_date(ts)).join(d, [*keys, "_d"], "left")
    return j.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit", "_d").select(*df.columns, name)


# Target and split --------------------------------------------------------------------------------------------------


def add_target(bars: DataFrame, threshold: float = 0.005, drop_neutral: bool = True) -> DataFrame:
    """1 up, 0 down, null between; the next bar's return decides."""
    w = ordered("ticker", "ts")
    b = bars.withColumn("next_return", ratio(F.lead("Close").over(w), F.col("Close")) - 1)
    b = b.withColumn("target", F.when(F.col("next_return") > threshold, 1).when(F.col("next_return") < -threshold, 0))
    return b.where(F.col("target").isNotNull()) if drop_neutral else b


def time_split(df: DataFrame, train: float = 0.70, val: float = 0.15, ts: str = "ts") -> DataFrame:
    """train, val, test in time order inside each ticker; sizes are cut to whole rows."""
    w = Window.partitionBy("ticker")
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(ts))
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    return df.withColumn("split", F.when(r <= a, "train").when(r <= b, "val").otherwise("test"))


def walk_forward(df: DataFrame, folds: int = 6, ts: str = "ts", tie: str = "ticker") -> DataFrame:
    """(row, fold, part): expanding training windows over all rows in time order, each followed by its validation part; parts are
    n // (folds + 1) rows and what is left over at the end is in none. Rows of one time are ordered by ``tie``.

    Places are global row numbers: rows are dealt by ranges of time, and the counts of the ranges say what precedes each."""
    from ..storage import numbered

    j, n = numbered(df, ts, tie, out="_place")
    size, place = n // (folds + 1), F.col("_place") + 1
    j = j.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    part = F.when(place <= size * F.col("fold"), "train").when(place <= size * (F.col("fold") + 1), "val")
    return j.withColumn("part", part).where("part IS NOT NULL").drop("_place")
