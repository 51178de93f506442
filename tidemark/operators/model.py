"""Direction models: population scaling, boosted trees, sequences, ensemble with abstention, threshold search, ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds of the ensemble, its weights, steps of a sequence.
UP, DOWN, WEIGHTS, STEPS = 0.52, 0.48, (0.5, 0.5), 24
#: Feature groups, each holding the one before.
PRICE = ("Close", "return_1h", "return_3h", "return_24h", "Volume")
TECHNICAL = (*PRICE, "rsi_14", "macd", "macd_signal", "macd_hist", "bb_width", "bb_position", "atr_14", "volume_change", "volume_ma_ratio", "volatility_24h", "obv")
SENTIMENT = (
    *TECHNICAL, "avg_sentiment", "sentiment_std", "bull_bear_ratio", "mention_volume", "weighted_volume", "sentiment_momentum", "sentiment_acceleration",
    "high_confidence_ratio", "pos_count", "neg_count", "neu_count", "sentiment_available", "sentiment_imputed",
)
FULL = (*SENTIMENT, "earnings_today", "earnings_tomorrow", "rsi_x_sentiment", "macd_x_sentiment", "vol_x_sentiment", "sentiment_x_earnings_tomorrow")
VERSIONS = {"v1_baseline": PRICE, "v2_technical": TECHNICAL, "v3_sentiment": SENTIMENT, "v4_full": FULL}


def available(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose features are all there and finite."""
    good = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(good)


def scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, from the training rows only."""
    row = train.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def scale(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / (s or 1.0) for c, (m, s) in fit.items()})


def scale_native(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """The same in one plan: the statistics are one row that is joined to all."""
    stats = df.where(train).agg(*[f(c).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = df.join(F.broadcast(stats))
    s = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return j.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / s(c) for c in cols}).select(*df.columns)


def boosted_trees(train: DataFrame, cols: list[str], rounds: int = 400, depth: int = 6, rate: float = 0.05, val: Column | None = None) -> PipelineModel:
    """Gradient boosted trees; with ``val`` marking validation rows the rounds stop early."""
    t = train.withColumn("_val", val) if val is not None else train
    extra = {"validationIndicatorCol": "_val"} if val is not None else {}
    gbt = GBTClassifier(labelCol="target", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42, **extra)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip"), gbt]).fit(t)


def probability_up(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    p = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return p.select(*df.columns, out)


def sequences(df: DataFrame, cols: list[str], steps: int = STEPS, keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """``seq``: the ``steps`` rows before each row of a ticker as arrays of features; shorter histories go.

    ``keys=[]`` interleaves all tickers in time order, which needs one window over everything: for small tables only.
    """
    w = Window.partitionBy(*(["ticker"] if keys is None else keys)).orderBy(ts, "ticker").rowsBetween(-steps, -1)
    return df.withColumn("seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w)).where(F.size("seq") == steps)


def sequence_network(df: DataFrame, width: int, hidden: int = 64, rounds: int = 50) -> PipelineModel:
    """A feed-forward network over flattened sequences, in place of a recurrent one."""
    net = MultilayerPerceptronClassifier(layers=[width, hidden, hidden, 2], labelCol="target", featuresCol="features", maxIter=rounds, seed=42)
    return Pipeline(stages=[net]).fit(df.withColumn("features", array_to_vector(F.flatten("seq"))))


def sequence_probability(d: DataFrame, cols: list[str], out: str, steps: int = STEPS) -> DataFrame:
    """Test rows that have a whole sequence in their split, with the probability of the network trained on the training rows."""
    part = lambda s: sequences(d.where(F.col("split") == s), cols, steps)
    net = sequence_network(part("train"), steps * len(cols))
    test = part("test").withColumn("features", array_to_vector(F.flatten("seq")))
    return probability_up(net, test, out).drop("features", "seq")


def recurrent_probability(d: DataFrame, cols: list[str], out: str, steps: int = STEPS, **how) -> DataFrame:
    """Test rows that have a whole sequence in their split, with the probability of the recurrent model trained on the training rows
    and stopped by the validation rows."""
    from . import recurrent

    part = lambda s: sequences(d.where(F.col("split") == s), cols, steps)
    net = recurrent.train(part("train"), part("val"), **how)
    return recurrent.probability(part("test"), net, out).drop("seq")


def ensemble(p1: Column, p2: Column, up: float = UP, down: float = DOWN, weights=WEIGHTS) -> dict[str, Column]:
    """Mean probability and 1 up, 0 down, -1 no answer."""
    if not (0 < down < up < 1):
        up, down = UP, DOWN
    p = p1 * weights[0] + p2 * weights[1]
    return {"prob_up": p, "prediction": F.when(p > up, 1).when(p < down, 0).otherwise(-1)}


def confusion(df: DataFrame, y: str, pred: str, *keys: str) -> DataFrame:
    """Accuracy and weighted F1 from the four counts."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b)).cast("double")
    return rated(df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn")))


def rated(g: DataFrame) -> DataFrame:
    """n, accuracy and weighted F1 beside the four counts."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    f1 = lambda a: F.coalesce(F.try_divide(2 * F.col(a), 2 * F.col(a) + F.col("fp") + F.col("fn")), F.lit(0.0))
    weighted = (f1("tp") * (F.col("tp") + F.col("fn")) + f1("tn") * (F.col("tn") + F.col("fp"))) / total
    return g.withColumn("n", total.cast("long")).withColumn("accuracy", (F.col("tp") + F.col("tn")) / total).withColumn("f1_weighted", weighted)


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then their plain and weighted means."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cells = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    sides = cells.select(F.col("y").alias("label"), (F.col("n") * (F.col("y") == F.col("p")).cast("int")).alias("hit"), F.col("n").alias("own"), F.lit(0.0).alias("said"))
    sides = sides.unionByName(cells.select(F.col("p").alias("label"), F.lit(0.0).alias("hit"), F.lit(0.0).alias("own"), F.col("n").alias("said")))
    c = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("hit", "own", "said")])
    c = c.withColumns({"precision": share(F.col("hit"), F.col("said")), "recall": share(F.col("hit"), F.col("own"))})
    c = c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    c = c.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", F.col("own").alias("support"))
    names = ("precision", "recall", "f1")
    plain = c.agg(F.lit("macro avg").alias("label"), *[F.avg(x).alias(x) for x in names], F.sum("support").alias("support"))
    by = c.agg(F.lit("weighted avg").alias("label"), *[share(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in names], F.sum("support").alias("support"))
    return c.unionByName(plain).unionByName(by).withColumn("support", F.col("support").cast("long"))


def sharpe(r: Column, periods: int = 8760) -> Column:
    s = F.stddev_pop(r)
    return F.when(s > 0, F.avg(r) / s * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def best_threshold(df: DataFrame, prob: str = "prob_up", y: str = "target", low: float = 0.35, high: float = 0.65, n: int = 31) -> DataFrame:
    """The threshold with the best accuracy, then weighted F1, then the smallest. Each row counts once, at the number of steps
    that its probability reaches; running sums over the steps give the four counts of each."""
    t = [low + i * ((high - low) / (n - 1)) for i in range(n)]
    reached = reduce(lambda a, b: a + b, [(F.col(prob) >= x).cast("int") for x in t])
    c = df.where(F.col(prob).isNotNull()).groupBy(reached.alias("reached")).agg(*[F.count_if(F.col(y) == k).alias(f"y{k}") for k in (0, 1)])
    steps = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(t)], "step int, t double")
    over = F.col("reached") > F.col("step")
    s = lambda k, at: F.coalesce(F.sum(F.when(at, F.col(f"y{k}"))), F.lit(0)).cast("double")
    m = steps.join(F.broadcast(c)).groupBy("step", "t").agg(s(1, over).alias("tp"), s(0, ~over).alias("tn"), s(0, over).alias("fp"), s(1, ~over).alias("fn"))
    m = rated(m)
    return m.select("t", "accuracy", "f1_weighted", "step").orderBy(F.desc("accuracy"), F.desc("f1_weighted"), "step").limit(1).drop("step")


def ablation(splits: DataFrame, rounds: int = 20, depth: int = 4, versions=VERSIONS, rate: float = 0.05) -> list[dict]:
    """Accuracy and F1 of each feature set on the test rows; ``splits`` has columns split and target. Rounds stop early by the
    validation rows."""
    from .fuse import quality_filter

    out = []
    splits = splits.cache()
    for name, names in versions.items():
        cols = available(splits, names)
        d = quality_filter(splits) if name in ("v3_sentiment", "v4_full") else splits
        d = finite(d.where("target IS NOT NULL"), cols).cache()
        fit = scaler(d.where("split = 'train'"), cols)
        model = boosted_trees(scale(d.where("split <> 'test'"), fit), cols, rounds, depth, rate, val=F.col("split") == "val")
        val = probability_up(model, scale(d.where("split = 'val'"), fit), "prob_up")
        best = best_threshold(val).first()
        t = best["t"] if best else 0.5
        test = probability_up(model, scale(d.where("split = 'test'"), fit), "prob_up")
        m = confusion(test.withColumn("pred", (F.col("prob_up") >= t).cast("int")), "target", "pred").first()
        d.unpersist()
        out.append({"version": name, "n_features": len(cols), "n_samples": int(m["n"]), "accuracy": m["accuracy"], "f1_weighted": m["f1_weighted"], "decision_threshold": t})
    splits.unpersist()
    return sorted(out, key=lambda r: -(r["accuracy"] or 0.0))


def walk_forward_trees(df: DataFrame, cols: list[str], folds: int = 6, rounds: int = 400, depth: int = 6, rate: float = 0.05, ts: str = "ts") -> list[dict]:
    """Accuracy and F1 of trees trained on each expanding window and judged on the part after it, by which their rounds stop early.
    Folds are cut over all rows; rows without a target or with a gap are dropped inside each. Folds whose training rows have one
    class, or whose validation part is empty, are left out."""
    from .market import walk_forward

    out = []
    parts = finite(walk_forward(df, folds, ts).where("target IS NOT NULL"), cols).cache()
    for k in range(1, folds + 1):
        d = parts.where(F.col("fold") == k)
        seen = d.agg(F.countDistinct(F.when(F.col("part") == "train", F.col("target"))).alias("classes"), F.count_if(F.col("part") == "val").alias("val")).first()
        if seen["classes"] < 2 or not seen["val"]:
            continue
        fit = scaler(d.where("part = 'train'"), cols)
        trees = boosted_trees(scale(d, fit), cols, rounds, depth, rate, val=F.col("part") == "val")
        said = probability_up(trees, scale(d.where("part = 'val'"), fit), "prob_up").withColumn("pred", (F.col("prob_up") > 0.5).cast("int"))
        m = confusion(said, "target", "pred").first()
        out.append({"fold": k, "n": int(m["n"]), "accuracy": m["accuracy"], "f1_weighted": m["f1_weighted"]})
    parts.unpersist()
    return out


def latest(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The last row of each ticker."""
    return df.groupBy("ticker").agg(F.max_by(F.struct(*df.columns), ts).alias("r")).select("r.*")


def overlay_latest(df: DataFrame, sentiment: DataFrame, ts: str = "ts") -> DataFrame:
    """Each ticker's last row with fresh sentiment laid over it where there is any: what a served model is asked about."""
    cols = [c for c in sentiment.columns if c != "ticker"]
    s = sentiment.select("ticker", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(1).alias("_there"))
    j = latest(df, ts).join(s, "ticker", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in cols}
    if "sentiment_available" in df.columns:
        new["sentiment_available"] = F.coalesce("_there", "sentiment_available")
    return j.withColumns(new).select(*df.columns)


def score_latest(df: DataFrame, sentiment: DataFrame, trees: PipelineModel, cols: list[str], fit: dict[str, tuple[float, float]], up: float = UP, down: float = DOWN, ts: str = "ts") -> DataFrame:
    """Each ticker's last row with fresh sentiment over it, scored by trained trees: (ticker, prob_up, prediction)."""
    rows = scale(overlay_latest(df, sentiment, ts).na.fill(0.0), fit)
    p = probability_up(trees, rows, "_p")
    return p.withColumns(ensemble(F.col("_p"), F.col("_p"), up, down)).select("ticker", ts, "prob_up", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
