"""Structured Streaming forms of the batch operators: event time, watermarks, bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clean import COPIES, SPAN
from ..operators.features import bull_bear, weighted_mean


def hourly_sentiment(posts: DataFrame, ts: str = "timestamp_utc", late: str = "1 hour", freq: str = "1 hour") -> DataFrame:
    """The hourly aggregate; a window is emitted once the watermark has passed it."""
    s, c = F.col("weighted_sentiment_score"), F.coalesce("user_credibility", F.lit(1.0))
    count = lambda label: F.count_if(F.col("sentiment_label") == label)
    g = posts.withWatermark(ts, late).groupBy(F.window(ts, freq), "ticker").agg(
        weighted_mean(s, c).alias("avg_sentiment"), F.stddev_pop(s).alias("sentiment_std"),
        count("positive").alias("pos_count"), count("negative").alias("neg_count"), count("neutral").alias("neu_count"),
        bull_bear(count("positive"), count("negative")).alias("bull_bear_ratio"), F.count("*").alias("mention_volume"),
        F.sum(c).alias("weighted_volume"), F.avg(F.coalesce(F.col("sentiment_confidence") > 0.80, F.lit(False)).cast("double")).alias("high_confidence_ratio"),
    )
    return g.select("ticker", F.col("window.start").alias("window_start"), *[x for x in g.columns if x not in ("window", "ticker")])


def distinct_ids(posts: DataFrame, ts: str = "timestamp_utc", late: str = "1 hour") -> DataFrame:
    return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])


def author_rate(posts: DataFrame, ts: str = "timestamp_utc", late: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Posts of an author in sliding hours: an upper approximation of the exact rate in steps of ``slide``."""
    g = posts.withWatermark(ts, late).groupBy(F.window(ts, "1 hour", slide), "author").agg(F.count("*").alias("posts"))
    return g.select("author", F.col("window.start").alias("window_start"), "posts")


_RATE = "id long, author string, timestamp_utc timestamp, posts long"


def author_rate_exact(posts: DataFrame, ts: str = "timestamp_utc", late: str = "1 hour") -> DataFrame:
    """Each post with the posts of its author in (t - 1 hour, t], itself included, of all that had come by then. The state of an
    author is the times of the last two hours, so a post that is up to an hour late is counted right; later ones are dropped, and
    the state goes when the watermark is two hours after the author's last post."""
    hour = 3_600_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        rows = rows[rows["t"] >= state.getCurrentWatermarkMs() * 1000]
        known = np.array(state.get[0] if state.exists else [], np.int64)
        new = rows["t"].to_numpy(np.int64)
        times = np.sort(np.concatenate([known, new]))
        if not len(times):
            return
        rows["posts"] = np.searchsorted(times, new, "right") - np.searchsorted(times, new - hour, "right")
        state.update((times[times > times[-1] - 2 * hour].tolist(),))
        _expire(state, times[-1] + 2 * hour)
        yield rows.assign(author=key[0])[["id", "author", "timestamp_utc", "posts"]]

    p = posts.withWatermark(ts, late).select("id", "author", F.col(ts).alias("timestamp_utc"), F.unix_micros(ts).alias("t"))
    return p.groupBy("author").applyInPandasWithState(step, _RATE, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _expire(state: GroupState, micros: int) -> None:
    """The key is called once more, and may go, when the watermark has passed this time."""
    state.setTimeoutTimestamp(max(int(micros // 1000), state.getCurrentWatermarkMs() + 1))


_BURST = "source string, author string, text_hash string, start timestamp, end timestamp, copies long"


def bursts(posts: DataFrame, ts: str = "timestamp_utc", late: str = "1 hour", least: int = COPIES, span: int = SPAN, keep: int | None = None) -> DataFrame:
    """Bursts of one author's repeated text: ``least`` copies or more whose whole span is at most ``span`` seconds. Copies belong
    together as long as none comes more than ``keep`` seconds (``span`` if not given) after the one before; a burst is told once, when
    the watermark has passed that, whatever the order in which copies came. The state of a text is one row for each group of copies
    that is still open, and goes with the last of them."""
    hold = (span if keep is None else keep) * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        first, last, n = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [], [])))
        if not state.hasTimedOut:
            new = pd.concat(list(batches))["t"].to_numpy(np.int64)
            new = new[new >= mark * 1000]
            first, last, n = np.concatenate([first, new]), np.concatenate([last, new]), np.concatenate([n, np.ones(len(new), np.int64)])
        if not len(first):
            return
        order = np.argsort(first, kind="stable")
        first, last, n = first[order], np.maximum.accumulate(last[order]), n[order]
        heads = np.flatnonzero(np.append(True, first[1:] - last[:-1] > hold))
        first, last, n = first[heads], np.maximum.reduceat(last, heads), np.add.reduceat(n, heads)
        open_ = (last + hold) // 1000 >= mark
        done = ~open_ & (n >= least) & (last - first <= span * 1_000_000)
        if open_.any():
            state.update((first[open_].tolist(), last[open_].tolist(), n[open_].tolist()))
            _expire(state, last[open_].min() + hold)
        elif state.exists:
            state.remove()
        if done.any():
            times = [pd.to_datetime(x[done], unit="us") for x in (first, last)]
            yield pd.DataFrame({"source": key[0], "author": key[1], "text_hash": key[2], "start": times[0], "end": times[1], "copies": n[done]})

    p = posts.withWatermark(ts, late).select("source", "author", "text_hash", F.col(ts).alias("timestamp_utc"), F.unix_micros(ts).alias("t"))
    kind = "first array<long>, last array<long>, n array<long>"
    return p.groupBy("source", "author", "text_hash").applyInPandasWithState(step, _BURST, kind, "append", GroupStateTimeout.EventTimeTimeout)


_MOMENTUM = "ticker string, window_start timestamp, avg_sentiment double, sentiment_momentum double, sentiment_acceleration double"


def momentum(windows: DataFrame, late: str = "1 hour", keep_days: int = 7) -> DataFrame:
    """Momentum and acceleration of closed windows; the state of a ticker is its last average and momentum, and goes when the
    watermark is ``keep_days`` after its last window: what comes after that begins anew."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, mom = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("window_start")
        out = []
        for r in rows.itertuples(index=False):
            m = None if last is None else r.avg_sentiment - last
            out.append((key[0], r.window_start, r.avg_sentiment, m, None if m is None or mom is None else m - mom))
            last, mom = r.avg_sentiment, m
        state.update((last, mom))
        _expire(state, int(rows["t"].max()) + keep_days * 86_400_000_000)
        yield pd.DataFrame(out, columns=["ticker", "window_start", "avg_sentiment", "sentiment_momentum", "sentiment_acceleration"]).astype({"sentiment_momentum": "float64", "sentiment_acceleration": "float64"})

    w = windows.withWatermark("window_start", late).withColumn("t", F.unix_micros("window_start"))
    return w.groupBy("ticker").applyInPandasWithState(step, _MOMENTUM, "last double, mom double", "append", GroupStateTimeout.EventTimeTimeout)


def join_lagged(bars: DataFrame, windows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars with the sentiment of the hour before them; both sides bounded by event time."""
    b = bars.withWatermark("ts", late)
    s = windows.withColumn("usable_at", F.col("window_start") + F.expr("INTERVAL 1 HOUR")).withWatermark("usable_at", late)
    s = s.withColumnRenamed("ticker", "_t")
    on = (F.col("ticker") == F.col("_t")) & (F.col("ts") >= F.col("usable_at")) & (F.col("ts") < F.col("usable_at") + F.expr("INTERVAL 1 HOUR"))
    return b.join(s, on, "leftOuter").drop("_t")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into Parquet, then stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_hourly(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="1 hour").start()
