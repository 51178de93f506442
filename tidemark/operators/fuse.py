"""Fusing lagged sentiment with bars: one left join, four ways to fill, interactions and the quality filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fill_forward, ordered
from .features import FEATURES


def fuse(bars: DataFrame, features: DataFrame, fill: str = "zero", limit: int | None = 24, ts: str = "ts") -> DataFrame:
    """``fill``: zero, ffill (at most ``limit`` rows of the ticker), drop, keep. Availability is told before filling."""
    f = features.select("ticker", F.col("window_start").alias(ts), *[c for c in FEATURES if c in features.columns])
    cols = [c for c in FEATURES if c in f.columns]
    j = bars.join(f, ["ticker", ts], "left").withColumn("sentiment_available", F.col("avg_sentiment").isNotNull().cast("int"))
    gone = F.col("avg_sentiment").isNull()
    if fill == "zero":
        return j.withColumns({"sentiment_imputed": gone.cast("int"), **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols}})
    if fill == "ffill":
        w = ordered("ticker", ts)
        j = j.withColumns({c: fill_forward(F.col(c), w, limit) for c in cols})
        return j.withColumn("sentiment_imputed", ((F.col("sentiment_available") == 0) & F.col("avg_sentiment").isNotNull()).cast("int"))
    if fill == "drop":
        j = j.where(~gone)
    return j.withColumn("sentiment_imputed", F.lit(0))


def interactions(df: DataFrame) -> DataFrame:
    if not {"rsi_14", "avg_sentiment"} <= set(df.columns):
        return df
    s = F.col("avg_sentiment")
    has = lambda c: F.col(c) if c in df.columns else F.lit(0)
    return df.withColumns({
        "rsi_x_sentiment": F.col("rsi_14") * s, "macd_x_sentiment": has("macd") * s, "vol_x_sentiment": has("volume_change") * s,
        "sentiment_x_earnings_tomorrow": s * has("earnings_tomorrow"),
    })


def quality_mask(mode: str = "available_only") -> Column:
    there = F.coalesce("sentiment_available", F.lit(0)) == 1
    return there | (F.coalesce("sentiment_imputed", F.lit(0)) == 0) if mode == "available_or_not_imputed" else there


def quality_filter(df: DataFrame, mode: str = "available_only", least: int = 200) -> DataFrame:
    """Rows with own sentiment, if every split keeps ``least`` of them; else all rows. ``df`` has a column split."""
    if mode == "off" or "sentiment_available" not in df.columns:
        return df
    ok = quality_mask(mode)
    n = df.agg(*[F.count_if(ok & (F.col("split") == s)).alias(s) for s in ("train", "val", "test")])
    gate = n.select((F.least("train", "val", "test") >= least).alias("_gate"))
    return df.join(F.broadcast(gate)).where(~F.col("_gate") | ok).drop("_gate")
