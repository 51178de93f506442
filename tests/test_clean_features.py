import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import clean, entity, features, fuse, ingest, market, model, score, weight
from tidemark.schemas import coalesce_aliases, nan_to_null, require

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_hourly_rate_is_open_on_the_left(spark):
    df = spark.createDataFrame([("a", at(m), "x") for m in (0, 30, 60, 120)], "author string, ts timestamp, text string")
    got = df.select("ts", clean.posts_last_hour("author", "ts", "text").alias("n")).orderBy("ts").collect()
    assert [r.n for r in got] == [1, 2, 2, 1]


def test_names(spark):
    names = ["ab1234", "a1234", "abcdefghijklmnop", "abcdefghijklmno", "12345678", "1234567", "[unknown]", None, "a_b12345"]
    df = spark.createDataFrame([(n,) for n in names], "u string")
    assert [r[0] for r in df.select(clean.suspicious_name(F.col("u"))).collect()] == [True, False, True, False, True, False, False, False, False]


@pytest.mark.parametrize(("span", "want"), [(2700, True), (2701, False)])
def test_bursts(spark, span, want):
    rows = [(str(i), "reddit", "joe", "same text", T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, span])]
    rows.append(("9", "reddit", None, "same text", T0))
    f = clean.flag_bots(spark.createDataFrame(rows, "id string, source string, author string, text string, timestamp_utc timestamp"))
    got = {r["id"]: r.duplicate_bot for r in f.collect()}
    assert all(got[str(i)] is want for i in range(4)) and got["9"] is False


def test_vote_gate_both_ways(spark):
    kind = "source string, upvotes double"
    closed = spark.createDataFrame([("reddit", None)] * 8 + [("reddit", 9.0)] * 2, kind)
    assert clean.vote_filter(closed).count() == 10
    opened = spark.createDataFrame([("reddit", 1.0), ("reddit", 9.0), ("news", None), ("Reddit", 6.0)], kind)
    assert sorted(r.upvotes or 0 for r in clean.vote_filter(opened).collect()) == [0, 6.0, 9.0]


def test_linking_uses_names_last(spark):
    df = spark.createDataFrame([(1, "buy $TSLA, apple"), (2, "like apple"), (3, "nothing")], "id int, text string")
    assert sorted((r.id, r.ticker) for r in entity.link(df).collect()) == [(1, "TSLA"), (2, "AAPL")]


def test_weights_of_missing_votes(spark):
    df = spark.createDataFrame([("reddit", None, None), ("reddit", 3.0, None), ("reddit", 3.0, 0.9), ("news", None, None), ("x", 1.0, None), ("stocktwits", 100.0, None)], "s string, u double, r double")
    got = [r[0] for r in df.select(weight.engagement(F.col("s"), F.col("u"), F.col("r"))).collect()]
    assert got == [None, 0.75, 0.9, 1.0, 0.5, 1.0]


def test_flags_at_the_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.66, 0.65, 0.40, 0.39)], "x double")
    assert [r[0] for r in df.select(weight.sarcasm_flag(F.col("x"))).collect()] == ["flip", "uncertain", "uncertain", "normal"]


def test_features_know_only_earlier_posts(spark):
    rows = [("A", at(5), 1.0, 1.0, "positive", 0.9), ("A", at(70), -1.0, 0.0, "negative", 0.5), ("A", at(200), 0.5, None, "neutral", None)]
    p = spark.createDataFrame(rows, "ticker string, timestamp_utc timestamp, weighted_sentiment_score double, user_credibility double, sentiment_label string, sentiment_confidence double")
    got = features.sentiment_features(p).orderBy("window_start").collect()
    assert [r.window_start for r in got] == [at(60), at(120), at(240)]
    assert [r.avg_sentiment for r in got] == [1.0, 0.0, 0.5]  # no weight: 0
    assert [r.bull_bear_ratio for r in got] == [1.0, 0.0, 0.5]
    assert [r.sentiment_momentum for r in got] == [None, -1.0, 0.5] and [r.sentiment_acceleration for r in got] == [None, None, 1.5]
    assert got[2].high_confidence_ratio == 0.0 and got[0].sentiment_std == 0.0


def _bars(n, seed=0, ticker="A"):
    r = np.random.default_rng(seed)
    c = 100 + r.normal(size=n).cumsum()
    return pd.DataFrame({"ticker": ticker, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "Open": c, "High": c + r.random(n), "Low": c - r.random(n), "Close": c, "Volume": r.integers(1, 99, n)})


def test_indicators_match_pandas(spark):
    b = _bars(60)
    got = market.technicals(spark.createDataFrame(b), fill=False, clip_at=None).orderBy("ts").toPandas()
    c, v = b["Close"], b["Volume"]
    d = c.diff()
    rsi = 100 - 100 / (1 + d.clip(lower=0).ewm(com=13, adjust=False).mean() / (-d).clip(lower=0).ewm(com=13, adjust=False).mean())
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want = {
        "rsi_14": rsi, "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean(), "return_24h": c.pct_change(24), "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(),
        "volume_ma_ratio": v / v.rolling(24).mean(), "obv": (np.sign(d) * v).fillna(0).cumsum(), "volatility_24h": c.pct_change().rolling(24).std(),
    }
    for k, x in want.items():
        np.testing.assert_allclose(got[k].astype(float), x.astype(float), rtol=1e-9, atol=1e-9, err_msg=k)


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 13, 2 / 27, 2 / 10])
def test_exponential_mean_with_gaps(alpha):
    x = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, 4.0])
    np.testing.assert_allclose(market.ewm(x, alpha), pd.Series(x).ewm(alpha=alpha, adjust=False).mean())


def test_native_exponential_mean(spark):
    b = _bars(30)
    got = spark.createDataFrame(b).groupBy("ticker").agg(market.ewm_native(F.col("Close"), F.col("ts"), 2 / 13).alias("y")).first().y
    assert got == pytest.approx(b["Close"].ewm(span=12, adjust=False).mean().iloc[-1])


def test_clip_leaves_constants_and_nulls(spark):
    df = spark.createDataFrame([("A", 1.0, 5.0), ("A", 1.0, None), ("A", 1.0, 6.0)], "ticker string, x double, y double")
    assert sorted(map(tuple, market.winsorise(df, ["x", "y"]).select("x", "y").collect()), key=repr) == sorted([(1.0, 5.0), (1.0, None), (1.0, 6.0)], key=repr)


@pytest.mark.parametrize("n", [1, 3, 7, 10])
def test_split_sizes_are_cut(spark, n):
    s = market.time_split(spark.createDataFrame(_bars(n)), 0.7, 0.15).orderBy("ts").collect()
    a, b = int(n * 0.7), int(n * (0.7 + 0.15))
    assert [r.split for r in s] == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_fill_limit_counts_rows(spark):
    rows = [("A", at(60 * i), 1.0 if i == 0 else None) for i in range(27)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, x double")
    w = sc.ordered("ticker", "ts")
    got = [r.y for r in df.withColumn("y", sc.fill_forward(F.col("x"), w, 24)).orderBy("ts").collect()]
    assert got == [1.0] * 25 + [None] * 2


def test_fusion_tells_availability_before_filling(spark):
    b = spark.createDataFrame(_bars(4))
    f = spark.createDataFrame([("A", at(60), 0.5)], "ticker string, window_start timestamp, avg_sentiment double")
    z = fuse.fuse(b, f, "zero").orderBy("ts").collect()
    assert [(r.sentiment_available, r.sentiment_imputed, r.avg_sentiment) for r in z] == [(0, 1, 0.0), (1, 0, 0.5), (0, 1, 0.0), (0, 1, 0.0)]
    k = fuse.fuse(b, f, "ffill").orderBy("ts").collect()
    assert [(r.sentiment_available, r.sentiment_imputed, r.avg_sentiment) for r in k] == [(0, 0, None), (1, 0, 0.5), (0, 1, 0.5), (0, 1, 0.5)]
    assert fuse.fuse(b, f, "drop").count() == 1


def test_resampling_skips_null_prices(spark):
    rows = [("A", at(0), None, 1), ("A", at(1), 5.0, 2), ("A", at(2), None, 3), ("A", at(61), None, 4)]
    t = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, volume long")
    got = market.resample(t, price={"Open": "price", "High": "price", "Low": "price", "Close": "price", "Volume": "volume"}).collect()
    assert [(r.Open, r.Close, r.Volume) for r in got] == [(5.0, 5.0, 6)]


def test_asof_goes_back_over_days(spark):
    b = spark.createDataFrame([("A", T0 + dt.timedelta(days=d)) for d in (0, 2, 3)], "ticker string, ts timestamp")
    dim = spark.createDataFrame([(T0 + dt.timedelta(days=1, hours=3), 7.0), (T0 + dt.timedelta(days=3, hours=1), 8.0)], "timestamp_utc timestamp, vix double")
    assert [r.vix for r in market.join_time(b, dim, how="asof").orderBy("ts").collect()] == [None, 7.0, 7.0]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(float("nan"), "x")], "a double, tweet string")
    assert nan_to_null(df).first().a is None
    assert coalesce_aliases(df).first().text == "x"
    with pytest.raises(ValueError, match="missing columns: b"):
        require(df, "a", "b")


def test_times(spark):
    raw = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "Tue Jan 02 03:04:05 +0000 2024", "01/02/2024 03:04", "2024-01-02", "junk", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r.t for r in df.select("i", sc.parse_time(F.col("r"), F.lit(T0)).alias("t")).orderBy("i").collect()]
    d = dt.datetime(2024, 1, 2)
    assert got == [d.replace(hour=3, minute=4, second=5)] * 3 + [d.replace(hour=3, minute=4), d, T0, T0]
    df = spark.createDataFrame([("Tue, 02 Jan 2024 03:04:05 GMT",), ("Tue, 2 Jan 2024 03:04:05 +0100",), ("x",)], "r string")
    assert [r[0].hour for r in df.select(sc.parse_rfc2822(F.col("r"), F.lit(T0))).collect()] == [3, 2, 0]


def test_model_parts(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 1), (0.4, 0), (0.1, 0)], "prob_up double, target int")
    best = model.best_threshold(df).first()
    assert best.accuracy == 1.0 and 0.4 < best.t <= 0.6
    e = model.ensemble(F.col("prob_up"), F.col("prob_up"))
    assert [r[0] for r in df.select(e["prediction"]).collect()] == [1, 1, 0, 0]
    s = model.sequences(spark.createDataFrame(_bars(30)), ["Close"], steps=24)
    assert s.count() == 6 and len(s.first().seq) == 24


def test_passthrough_and_model_scorer(spark):
    df = spark.createDataFrame([("good gains", "Bearish"), ("bad", None)], "text string, sentiment_label string")
    got = score.score_posts(df, only_unlabelled=True).collect()
    assert [(r.sentiment_label, r.sentiment_confidence) for r in got] == [("negative", 1.0), ("negative", 1.0)]
    udf = score.model_scorer(lambda: lambda texts: [{"positive": 0.25, "negative": 0.75} for _ in texts])
    b = score.best_class(F.col("m"))
    assert df.select(udf("text").alias("m")).select(b["sentiment_label"]).first()[0] == "negative"


def test_keep_first_and_report(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "x")], "k string, o int, label string")
    assert sorted(map(tuple, ingest.keep_first(df, ["k"], "o").collect())) == [("a", 1, "y"), ("b", 3, "x")]
    assert {r.pct for r in ingest.label_distribution(df, "k").collect()} == {50.0, 100.0}
