"""The sentiment classifier against a plain loop, and company names against a naive scan."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classifier, entity, score
from tidemark.operators import descent
from tidemark.operators.descent import Adam

GOOD, BAD = ("gains", "rally", "profit", "strong beat"), ("losses", "fraud", "weak miss", "slump")


def _labelled(spark, n=900, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice(["bullish", "sell", "hold", "2"])
        words = {"bullish": GOOD, "2": GOOD, "sell": BAD}.get(k, ("flat", "unchanged"))
        rows.append((f"{r.choice(words)} for share {i} of {r.choice(['acme', 'globex'])} today", k))
    return spark.createDataFrame(rows, "text string, label string")


def _arrays(spark, df):
    return [(r["at"], r["y"]) for r in df.select(classifier.features(F.col("text")).alias("at"), "y").collect()]


def test_features(spark):
    df = spark.createDataFrame([("Up, up  AND up!",), ("",), (None,), ("one",), ("é 日本 5%",)], "text string")
    got = [r[0] for r in df.select(classifier.features(F.col("text"))).collect()]
    assert [len(x) for x in got] == [2 + 3, 0, 0, 1, 5] and all(x == sorted(set(x)) and all(0 <= i < classifier.SIZE for i in x) for x in got)


def test_gradient_is_that_of_finite_differences():
    r = np.random.default_rng(0)
    at = pa.array([[0, 2, 5], [], [1, 2], [7]], pa.list_(pa.int32()))
    y, weigh = np.array([0, 2, 1, 1]), np.array([1.0, 0.5, 2.0])
    w = r.standard_normal(9 * 3)
    _, _, g = classifier.loss_and_gradient(w, at, y, weigh)
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((classifier.loss_and_gradient(up, at, y, weigh, False)[1] - classifier.loss_and_gradient(down, at, y, weigh, False)[1]) / 2e-6, abs=1e-6)


def test_held_out_is_an_exact_share_of_every_class(spark):
    rows = classifier.held_out(classifier.prepared(_labelled(spark, 3000)))
    by = {r.y: (r.n, r.h) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.count_if("held_out").alias("h")).collect()}
    assert len(by) == 3 and all(abs(h - 0.15 * n) <= 2 for n, h in by.values())


def test_an_epoch_is_a_plain_loop(spark):
    df = _labelled(spark, 400)
    net = classifier.train(df, epochs=1, batch=100, steps=8, size=512)
    rows = classifier.held_out(classifier.prepared(df)).select(classifier.features(F.col("text"), 512).alias("at"), "y", "held_out", F.xxhash64("text").alias("key")).collect()
    own = [r for r in rows if not r.held_out]
    counts = np.bincount([r.y for r in own], minlength=3)
    weigh = len(own) / (3 * counts)
    size = max(100, -(-len(own) // 8))
    m = -(-len(own) // size)
    w, adam = np.zeros(513 * 3), Adam(513 * 3, classifier.RATE, classifier.DECAY)
    for k in range(m):
        part, g, total = [r for r in own if r.key % m == k], np.zeros((513, 3)), 0.0
        for r in part:
            v = w.reshape(-1, 3)
            z = v[-1] + v[r["at"]].sum(axis=0) / np.sqrt(max(len(r["at"]), 1))
            q = np.exp(z - z.max())
            d = (q / q.sum() - np.eye(3)[r.y]) * weigh[r.y]
            g[-1] += d
            for i in r["at"]:
                g[i] += d / np.sqrt(len(r["at"]))
            total += weigh[r.y]
        w = adam.step(w, g.ravel() / total)
    assert np.allclose(net.weights.ravel(), w, atol=1e-9) and len(net.history) == 1


def test_it_learns_is_stored_and_scores(spark, tmp_path):
    df = _labelled(spark)
    net = classifier.train(df)
    classifier.save(spark, net, f"{tmp_path}/m")
    again = classifier.load(spark, f"{tmp_path}/m")
    assert np.array_equal(again.weights, net.weights) and again.history == net.history
    posts = spark.createDataFrame([(1, "a rally and profit for acme"), (2, "fraud and slump at globex"), (3, "share unchanged today"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r for r in score.score_posts(posts, scorer=classifier.scorer(spark, again)).collect()}
    assert [got[i].sentiment_numeric for i in (1, 2, 3)] == [1, -1, 0] and [got[i].sentiment_label for i in (1, 2, 3)] == ["positive", "negative", "neutral"]
    assert got[4].sentiment_confidence == got[5].sentiment_confidence and all(1 / 3 <= r.sentiment_confidence <= 1 and r.is_uncertain == (r.sentiment_confidence < 0.7) for r in got.values())
    held = classifier.held_out(classifier.prepared(df)).where("held_out")
    said = held.withColumn("said", classifier.scorer(spark, net)(F.col("text"))["sentiment_numeric"] + 1)
    assert said.where("said = y").count() >= 0.9 * held.count()


def test_odd_labelled_rows(spark):
    rows = [("too short", "buy"), (None, "buy"), ("a text without a known label", "maybe"), ("a text with no label at all", None), ("the same text twice over", "sell"), ("the same text twice over", "buy"), ("  the same text twice over ", "buy")]
    df = spark.createDataFrame(rows, "text string, label string")
    assert [(r.text, r.y) for r in classifier.prepared(df).collect()] == [("the same text twice over", 0)]  # negative comes first by name
    with pytest.raises(ValueError):
        classifier.train(df.limit(0))


def _naive(text, names):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(6, len(words) - i), 0, -1) if tuple(words[i : i + n]) in names), 0)
        if n:
            out.append(names[tuple(words[i : i + n])])
        i += n or 1
    return out


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_mentions_are_those_of_a_naive_scan(spark, monkeypatch, broadcast):
    monkeypatch.setattr(entity, "BROADCAST_COMPANIES", broadcast)
    r = random.Random(4)
    word = lambda: r.choice(["acme", "Corp", "north", "star", "é", "日本", "one", "two", "x1"])
    companies = [(" ".join(word() for _ in range(r.randrange(1, 4))), f"T{i}") for i in range(40)] + [("Acme-Corp, Inc.", "AC"), ("  ", "NO"), ("???", "NO"), (None, "NO"), ("no ticker", None)]
    names = {}
    for c, t in companies:
        w = tuple(re.findall(r"[^\W_]+", (c or "").lower()))
        if w and t:
            names[w] = min(t, names.get(w, t))
    texts = [r.choice([" ", ", ", "_", "\n"]).join(word() for _ in range(r.randrange(40))) for _ in range(60)] + ["acme corp inc! acme-corp", None, "", "no ticker", "ACME corps"]
    rows = [(i % 60, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    got = entity.mentions(spark.createDataFrame(rows, "id int, text string, ticker string"), spark.createDataFrame(companies, "company string, ticker string"))
    want = sorted({(i, tuple(_naive(t, names))) for i, t, _ in rows if _naive(t, names)})
    assert sorted((x.id, tuple(x.organisations)) for x in got.collect()) == want


def test_a_hundred_thousand_names(spark):
    c = spark.range(100_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" ltd")).alias("company"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("ticker"))
    posts = spark.createDataFrame([(i, f"shares of Name {i * 7} Ltd. fell, name {i} rose") for i in range(2000)], "id int, text string")
    got = {r.id: r.organisations for r in entity.mentions(posts, c).collect()}
    assert got == {i: [f"N{i * 7}"] for i in range(2000)}


def test_links_come_from_the_company_table(spark):
    posts = spark.createDataFrame([(1, "Acme corp fell", None), (2, "$TSLA and acme corp", None), (3, "globex and apple", None), (4, "nothing", None), (None, "Globex rose", None)], "id int, text string, ticker string")
    companies = spark.createDataFrame([("ACME Corp", "GME"), ("Globex", "NVDA"), ("apple", "XX")], "company string, ticker string")
    got = sorted((str(r.id), r.ticker) for r in entity.link(posts, companies=companies).select("id", "ticker").collect())
    assert got == [("1", "GME"), ("2", "TSLA"), ("3", "AAPL"), ("3", "NVDA"), ("None", "NVDA")]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_the_driver_gets_one_sum_of_many_tasks(spark, monkeypatch, parts):
    rows = spark.range(0, 400, 1, parts)
    loss = lambda w, b: (float(b.num_rows), float(sum(b.column(0).to_pylist())), w * b.num_rows)
    got, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: (got.append(collect(df)), got[-1])[1])
    n, total, g = descent.summed(rows, parts, np.array([1.0, 2.0, 3.0]), loss)
    assert (n, total, g.tolist()) == (400, 79_800, [400, 800, 1200]) and [len(x) for x in got] == [1]
    assert descent.summed(rows, parts, np.ones(3), lambda w, b: (1.0, 0.0, None))[2].tolist() == []
