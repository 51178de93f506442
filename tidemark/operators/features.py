"""Windowed sentiment features per ticker, momentum, and the lag that keeps the future out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ratio
from ..schemas import require

#: The aggregates of a window, then momentum and acceleration.
AGGREGATES = ("avg_sentiment", "sentiment_std", "pos_count", "neg_count", "neu_count", "bull_bear_ratio", "mention_volume", "weighted_volume", "high_confidence_ratio")
FEATURES = (*AGGREGATES, "sentiment_momentum", "sentiment_acceleration")


def weighted_mean(x: Column, w: Column) -> Column:
    return F.when(F.sum(w) > 0, ratio(F.sum(x * w), F.sum(w))).otherwise(0.0)


def bull_bear(pos: Column, neg: Column, empty: float = 0.5) -> Column:
    return F.when(pos + neg == 0, empty).otherwise(ratio(pos, pos + neg))


def floor_time(ts: Column, freq: str = "1 hour") -> Column:
    return F.date_trunc("hour", ts) if freq == "1 hour" else F.window(ts, freq)["start"]


def aggregate_windows(posts: DataFrame, ts="timestamp_utc", ticker="ticker", freq: str = "1 hour") -> DataFrame:
    """One row per ticker and window. One shuffle on (ticker, window), partial aggregates before it."""
    require(posts, ts, ticker, "weighted_sentiment_score")
    cred = F.coalesce(F.col("user_credibility"), F.lit(1.0)) if "user_credibility" in posts.columns else F.lit(1.0)
    p = posts.na.drop(subset=[ts, ticker, "weighted_sentiment_score"]).withColumn("_c", cred)
    s, c = F.col("weighted_sentiment_score"), F.col("_c")
    g = p.groupBy(F.col(ticker).alias("ticker"), floor_time(F.col(ts), freq).alias("window_start"))
    count = lambda label: F.count_if(F.col("sentiment_label") == label)
    return g.agg(
        weighted_mean(s, c).alias("avg_sentiment"),
        F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_pop(s)).alias("sentiment_std"),
        count("positive").alias("pos_count"), count("negative").alias("neg_count"), count("neutral").alias("neu_count"),
        bull_bear(count("positive"), count("negative")).alias("bull_bear_ratio"),
        F.count("*").alias("mention_volume"), F.sum(c).alias("weighted_volume"),
        F.avg(F.coalesce(F.col("sentiment_confidence") > 0.80, F.lit(False)).cast("double")).alias("high_confidence_ratio"),
    )


def add_momentum(f: DataFrame) -> DataFrame:
    """Differences between a ticker's windows that exist, not between calendar hours; one sort serves both."""
    w = Window.partitionBy("ticker").orderBy("window_start")
    a = F.col("avg_sentiment")
    f = f.withColumn("sentiment_momentum", a - F.lag(a).over(w))
    m = F.col("sentiment_momentum")
    return f.withColumn("sentiment_acceleration", m - F.lag(m).over(w))


def lag_windows(f: DataFrame, lags: int = 1, freq: str = "1 hour") -> DataFrame:
    """The window that a feature may be used in: it knows only posts of earlier windows."""
    n, unit = freq.split()
    return f.withColumn("feature_source_window", F.col("window_start")).withColumn(
        "window_start", F.col("window_start") + F.expr(f"INTERVAL {int(n) * lags} {unit}")
    )


def sentiment_features(posts: DataFrame, ts="timestamp_utc", ticker="ticker", freq: str = "1 hour", lags: int = 1) -> DataFrame:
    return lag_windows(add_momentum(aggregate_windows(posts, ts, ticker, freq)), lags, freq)


def ticker_summary(f: DataFrame) -> DataFrame:
    a = "avg_sentiment"
    return f.groupBy("ticker").agg(F.count(a).alias("windows"), F.avg(a).alias("mean_sentiment"), F.stddev_samp(a).alias("std_sentiment"), F.sum("mention_volume").alias("mentions"))


def company_aggregate(posts: DataFrame, *keys: str) -> DataFrame:
    """All posts of a company at once: unweighted mean and population deviation."""
    s, n = F.col("weighted_sentiment_score"), F.col("sentiment_numeric")
    return posts.groupBy(*keys).agg(
        F.avg(s).alias("avg_sentiment"), F.stddev_pop(s).alias("sentiment_std"),
        F.count_if(n > 0).alias("pos_count"), F.count_if(n < 0).alias("neg_count"), F.count_if(n == 0).alias("neu_count"),
        bull_bear(F.count_if(n > 0), F.count_if(n < 0)).alias("bull_bear_ratio"), F.count("*").alias("mention_volume"),
        F.sum(F.coalesce("user_credibility", F.lit(1.0))).alias("weighted_volume"),
        F.avg(F.coalesce(F.col("sentiment_confidence") > 0.80, F.lit(False)).cast("double")).alias("high_confidence_ratio"),
    )
