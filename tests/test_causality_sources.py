import datetime as dt
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import causality as g
from tidemark.operators import model
from tidemark.plans import catalogue, pipeline
from tidemark.sources import readers, sinks
from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("f", "d1", "d2", "p"), [(4.9646, 1, 10, 0.05), (2.8661, 4, 20, 0.05), (0, 1, 5, 1.0)])
def test_f_tail(f, d1, d2, p):
    assert g.f_tail(f, d1, d2) == pytest.approx(p, abs=1e-4)


def test_unit_root_table_points():
    assert g.tau_p(-2.86) == pytest.approx(0.05, abs=1e-3) and g.tau_p(-3.43) == pytest.approx(0.01, abs=1e-3) and g.tau_p(-0.44) == pytest.approx(0.90, abs=0.01)


def test_stationarity():
    r = np.random.default_rng(3)
    noise, walk = r.normal(size=400), r.normal(size=400).cumsum()
    assert g.is_stationary(noise) and not g.is_stationary(walk)
    assert g.make_stationary(walk)[1] == 1
    assert not g.is_stationary(noise[:7]) and g.is_stationary(np.ones(20))


def test_lead_is_included_and_short_is_not(spark):
    r = np.random.default_rng(1)
    s = r.normal(size=600)
    p = 0.4 * np.roll(s, 1) + r.normal(scale=0.5, size=600)
    rows = [("L", T0 + dt.timedelta(hours=i), float(p[i]), float(s[i])) for i in range(1, 600)] + [("S", T0, 1.0, 1.0)]
    got = {x.ticker: x for x in g.run_granger(spark.createDataFrame(rows, "ticker string, ts timestamp, price double, sentiment double")).collect()}
    assert got["L"].recommendation == "INCLUDE" and got["L"].best_lag == 1 and got["S"].recommendation == "EXCLUDE"
    assert json.loads(got["L"].lag_results)["1"]["significant"] is True


def test_registry(spark, tmp_path):
    kind = "ticker string, sentiment_is_valid boolean"
    path = str(tmp_path / "reg")
    sinks.upsert_json(spark, spark.createDataFrame([("A", True), ("B", True)], kind), path)
    got = sinks.upsert_json(spark, spark.createDataFrame([("B", False), ("C", True)], kind), path)
    assert sorted(map(tuple, got.select("ticker", "sentiment_is_valid").collect())) == [("A", True), ("B", False), ("C", True)]
    (tmp_path / "one.json").write_text(json.dumps({"A": {"sentiment_is_valid": True, "best_lag": 2}}))
    assert g.read_registry(spark, str(tmp_path / "one.json")).first().best_lag == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a_vix_1.csv").write_text("timestamp_utc,vix_close\n2024-01-01 00:30:00,12.5\n")
    (tmp_path / "b_vix_2.csv").write_text("timestamp_utc,vix_close,index\n2024-01-01 00:30:00,12.5,US_VIX\n2024-01-01 00:30:00,12.5,US_VIX\n")
    assert sorted((r["index"] or "") for r in readers.read_vix(spark, str(tmp_path)).collect()) == ["", "US_VIX"]
    prices = tmp_path / "prices"
    prices.mkdir()
    head = "timestamp_utc,Open,High,Low,Close,Volume,ticker\n"
    for name in ("x.csv", "y.csv", "call_all.csv"):
        (prices / name).write_text(head + "2024-01-01 00:00:00,1,1,1,1,5,TSLA\n")
    assert readers.read_prices(spark, str(prices), ["tsla"]).count() == 1
    (tmp_path / "at.txt").write_text("me@home is up@positive\nnone\n")
    assert tuple(readers.read_at_lines(spark, str(tmp_path / "at.txt")).first()) == ("me@home is up", "positive")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("other.csv", "a,b\n1,x\n")
        z.writestr("best.csv", "a,b\n2,y\n")
    assert tuple(readers.read_zipped_csv(spark, str(tmp_path / "z.zip"), "a int, b string", "best.csv").first()) == (2, "y")
    assert readers.latest_file(spark, str(tmp_path), "*.csv", by="name").endswith("b_vix_2.csv")


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><description>B.</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>")
    r = readers.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert (r.text, r.timestamp_utc) == ("A. B", dt.datetime(2024, 1, 2, 3, 4, 5))


def test_stages(spark):
    rows = [(str(i), "reddit", f"joe{i % 7}", f"good gains for $TSLA and apple number {i}", 9.0, T0 + dt.timedelta(minutes=7 * i)) for i in range(40)]
    posts = spark.createDataFrame(rows, "id string, source string, author string, text string, upvotes double, timestamp_utc timestamp")
    got = pipeline.run_stages(spark, ("1C",), posts=posts)
    assert set(got) == {"1A", "1B", "1C"}
    f = got["1C"].collect()
    assert {r.ticker for r in f} == {"AAPL"} or {r.ticker for r in f} == {"TSLA"} or {r.ticker for r in f} == {"AAPL", "TSLA"}
    assert all(r.avg_sentiment > 0 for r in f)
    one = pipeline.score_text(spark, "good gains", "TSLA", 0.8)
    assert one["sentiment_label"] == "positive" and one["weighted_sentiment_score"] == pytest.approx(0.8)
    companies = spark.createDataFrame([("Tesla", "TSLA")], "company string, ticker string")
    with pytest.raises(LookupError):
        pipeline.score_company(posts, "no such company name", companies)


def test_stream_momentum(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(hours=i), float(x)) for i, x in enumerate((1, 3, 2))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ticker string, window_start timestamp, avg_sentiment double").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("ticker string, window_start timestamp, avg_sentiment double").parquet(src)
    streams.run_available(streams.momentum(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.sentiment_momentum for r in got] == [None, 2.0, -1.0] and got[2].sentiment_acceleration == -3.0


def test_stage_3_averages_two_models(spark):
    r = np.random.default_rng(2)
    rows = [(k, T0 + dt.timedelta(hours=i), float(c), float(r.normal()), int(r.random() < 0.5)) for k in "AB" for i, c in enumerate(r.normal(size=200))]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, Close double, Volume double, target int")
    got = pipeline.train_stage(d, Config(boost_rounds=3, boost_depth=2)).collect()
    assert len(got) == 2 * (40 - 24) and any(abs(x.p1 - x.p2) > 1e-6 for x in got)
    assert all(x.prob_up == pytest.approx((x.p1 + x.p2) / 2) for x in got)


def test_ablation_is_the_whole_job(spark, sf_dir, monkeypatch):
    asked = []
    rows = [("A", T0 + dt.timedelta(hours=i), "train" if i < 12 else "val" if i < 16 else "test", i % 2, float(i), 1) for i in range(20)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, split string, target int, Close double, sentiment_available int")

    def trees(train, cols, rounds=400, depth=6, rate=0.05, val=None):
        asked.append((rounds, depth, rate, train.count(), 0 if val is None else train.where(val).count()))

    monkeypatch.setattr(catalogue, "model_matrix", lambda v: d)
    monkeypatch.setattr(model, "boosted_trees", trees)
    monkeypatch.setattr(model, "probability_up", lambda m, x, name: x.withColumn(name, F.lit(0.5)))
    got = catalogue.QUERIES["gbt_ablation"](spark, sf_dir).collect()
    assert len(got) == 4 and asked == [(400, 6, 0.05, 16, 4)] * 4
